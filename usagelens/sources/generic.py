"""Generic sources: conversations of any shape, CSV and JSON documents, SQL, adapters by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usagelens.config import RuleConfig
from usagelens.functions.text import block_text, drop_nul, line_separators_to_space, model_family, parse_iso
from usagelens.sources.files import file_name, file_stem
from usagelens.sources.splitting import csv_records, json_groups, json_items

Reader = Callable[..., DataFrame]
_READERS: dict[str, Reader] = {}
#: Quotes are doubled inside quotes, and a quoted field may hold line breaks.
CSV = {"header": True, "inferSchema": False, "quote": '"', "escape": '"', "multiLine": True}


def register_reader(kind: str, reader: Reader) -> None:
    """Make a reader known under a kind or a file suffix such as `.csv`."""
    _READERS[kind.lower()] = reader


def reader_for(name: str) -> Reader:
    """The reader of a kind, or of a path's suffix."""
    lower = name.lower()
    key = lower if lower in _READERS else "." + lower.rsplit(".", 1)[-1]
    if key not in _READERS:
        raise ValueError(f"unsupported source {name!r}; known: {sorted(_READERS)}")
    return _READERS[key]


# -------------------------------------------------------------- conversations
def _first(entry: str, *keys: str) -> Column:
    return F.coalesce(*[F.nullif(F.try_variant_get(entry, f"$.{k}", "string"), F.lit("")) for k in keys])


def conversations(items: DataFrame) -> DataFrame:
    """Conversation records of JSON exports (path, index, item); conversations without messages are dropped."""
    rows = items.select("path", F.col("index").alias("entry_index"), F.col("item").alias("e"))
    stem = file_stem(F.col("path"))
    lists = F.coalesce(F.try_variant_get("e", "$.messages", "array<variant>"),
                       F.try_variant_get("e", "$.conversation", "array<variant>"))
    objects = F.filter(lists, lambda m: F.schema_of_variant(m).startswith("OBJECT"))
    rows = rows.withColumns({"stem": stem, "objects": objects})
    body = F.transform("objects", lambda m, i: F.struct(
        m.alias("m"), i.alias("i"), _message_text(m).alias("content")))
    kept = F.transform(F.filter(body, lambda s: s["content"] != ""), lambda s: F.struct(
        F.coalesce(_of(s["m"], "id"), _of(s["m"], "turn_identifier"), F.substring(F.sha1(F.concat_ws(
            "|", F.col("stem"), F.col("entry_index").cast("string"), s["i"].cast("string"),
            F.substring(s["content"], 1, 32))), 1, 16)).alias("id"),
        F.coalesce(_of(s["m"], "author"), _of(s["m"], "role"), _of(s["m"], "speaker"), F.lit("unknown")).alias("author"),
        s["content"].alias("content")))
    fallback = F.concat_ws("-", "stem", F.col("entry_index").cast("string"))
    return rows.select(
        F.coalesce(_first("e", "conversation_hash", "conversation_id", "url"), fallback).alias("conversation_id"),
        model_family(F.coalesce(_first("e", "author", "model", "provider"), F.split_part(
            F.col("stem"), F.lit("_"), F.lit(1)))).alias("provider"),
        F.coalesce(_first("e", "title", "name"), "stem").alias("title"),
        parse_iso(_first("e", "date", "timestamp", "created_at")).alias("exported_at"),
        kept.alias("messages")).filter(F.size("messages") > 0)


def _of(message: Column, key: str) -> Column:
    return F.nullif(F.try_variant_get(message, f"$.{key}", "string"), F.lit(""))


def _message_text(message: Column) -> Column:
    content = F.try_variant_get(message, "$.content", "variant")
    kind = F.schema_of_variant(content)
    other = F.coalesce(*[F.when(F.schema_of_variant(F.try_variant_get(message, f"$.{k}", "variant")) == "STRING",
                                F.try_variant_get(message, f"$.{k}", "string")) for k in ("text", "message", "prompt")])
    known = (kind == "STRING") | kind.startswith("ARRAY") | kind.startswith("OBJECT")
    return drop_nul(F.when(known, block_text(content)).otherwise(F.coalesce(other, F.lit(""))))


def read_conversations(spark: SparkSession, folder: str, glob: str = "*.json") -> DataFrame:
    groups = json_groups(spark, folder, glob, stored=True)
    return conversations(json_items(spark, folder, "VARIANT", groups=groups, keep=lambda v: F.schema_of_variant(v).startswith("OBJECT")))


# ------------------------------------------------------------------ documents
def _csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, content, fits) of CSV rows as JSON objects of strings, numbered from 0 within their file.

    Files are cut into records by many tasks. The first file names the columns,
    each file's first record is its header; `fits` tells rows of the header's width.
    """
    names = spark.read.options(**CSV).csv(path).columns
    schema = ", ".join([f"c{i} STRING" for i in range(len(names))] + ["bad STRING"])
    options = {**{k: str(v) for k, v in CSV.items() if k in ("quote", "escape", "multiLine")}, "columnNameOfCorruptRecord": "bad"}
    rows = csv_records(spark, path).filter("record > 0").select("path", (F.col("record") - 1).cast("int").alias("row"), F.from_csv("text", schema, options).alias("r"))
    content = F.struct(*[F.coalesce(F.col(f"r.c{i}"), F.lit("")).alias(name) for i, name in enumerate(names)])
    return rows.select("path", "row", F.to_json(content).alias("content"), F.col("r.bad").isNull().alias("fits"))


def read_csv_documents(spark: SparkSession, path: str) -> DataFrame:
    """Each CSV row as a document {source, content (JSON), metadata}."""
    return _csv_rows(spark, path).select(
        F.concat("path", F.lit(":row_"), F.col("row").cast("string")).alias("source"), "content",
        F.to_json(F.struct(F.lit("csv").alias("type"), file_name(F.col("path")).alias("filename"), "row")).alias("metadata"))


def read_json_documents(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """JSON files as documents: one per array item, or one per file."""
    name = file_name(F.col("path"))
    return json_items(spark, path, "VARIANT", groups=json_groups(spark, path, glob, stored=True)).filter(F.col("item").isNotNull()).select(
        F.when(F.col("is_list"), F.concat("path", F.lit(":item_"), F.col("index").cast("string"))).otherwise(
            F.col("path")).alias("source"),
        F.to_json("item").alias("content"),
        F.to_json(F.struct(F.lit("json").alias("type"), name.alias("filename"), F.when(
            F.col("is_list"), F.col("index")).alias("index"))).alias("metadata"))


def csv_to_json(spark: SparkSession, path: str) -> DataFrame:
    """CSV rows as JSON objects of strings; rows of another width than the header are skipped."""
    return _csv_rows(spark, path).filter("fits").select(F.col("content").alias("row"))


def records_from_json(landed: DataFrame, column: str, source: str, source_type: str = "api") -> DataFrame:
    """Landed responses (an array or one object each) as generic records."""
    text = F.trim(F.col(column))
    items = F.when(text.startswith("["), F.from_json(text, "ARRAY<VARIANT>")).otherwise(F.array(F.try_parse_json(text)))
    each = landed.select(F.explode(items).alias("raw")).filter(F.col("raw").isNotNull())
    return each.select(
        F.lit(source).alias("source"), F.lit(source_type).alias("source_type"), "raw",
        F.try_variant_get("raw", "$", "map<string,string>").alias("record"))


def records_from_query(spark: SparkSession, query: str, params: dict | None = None, source: str = "sql") -> DataFrame:
    """The rows of a query as generic records."""
    rows = spark.sql(query, args=params or {})
    pairs = [x for c in rows.columns for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]
    return rows.select(F.lit(source).alias("source"), F.lit("database").alias("source_type"),
                       F.create_map(*pairs).alias("record"))


def read_jdbc(spark: SparkSession, url: str, query: str, partition: tuple[str, int, int, int] | None = None,
              **options: str) -> DataFrame:
    """An external query; give (column, lower, upper, parts) to read in parallel."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if partition is None:
        return reader.option("query", query).load()
    column, low, high, parts = partition
    return reader.option("dbtable", f"({query}) q").option("partitionColumn", column).option(
        "lowerBound", low).option("upperBound", high).option("numPartitions", parts).load()


def read_only_sql(spark: SparkSession, query: str, params: dict | None = None) -> DataFrame:
    """Run one SELECT statement with bound parameters; each row as JSON."""
    text = query.strip().rstrip(";").strip()
    if not text.lower().startswith("select") or ";" in text:
        raise ValueError("only a single SELECT statement is allowed")
    rows = spark.sql(text, args=params or {})
    return rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("row"))


def configured_tables(spark: SparkSession, rules: RuleConfig, database: str | None = None) -> dict[str, DataFrame]:
    """The configured company tables that exist."""
    full = {name: f"{database}.{name}" if database else name for name in rules.table_fields}
    return {name: spark.table(path) for name, path in full.items() if spark.catalog.tableExists(path)}


def ordered_messages(chats: DataFrame) -> DataFrame:
    """The rule scan's message list in conversation order."""
    return chats.select(
        "source_file", "conversation_key", "conversation_title", "provider", "model_name", "message_id",
        "message_timestamp", "author", "role", "user_text_clean").orderBy(
        F.asc_nulls_last("conversation_timestamp"), "message_index", "conversation_key", "message_id")


def sample_rows(rows: DataFrame, n: int = 2000) -> DataFrame:
    """The first n rows with line-separator characters replaced in all strings, nested ones too."""
    cut = rows.limit(n)
    return cut.select(*[_clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in cut.schema])


def _clean(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return line_separators_to_space(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda v: _clean(v, kind.elementType))
    if isinstance(kind, T.StructType):
        inner = F.struct(*[_clean(value[f.name], f.dataType).alias(f.name) for f in kind])
        return F.when(value.isNotNull(), inner)
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda k, v: _clean(v, kind.valueType))
    return value


register_reader(".csv", read_csv_documents)
register_reader(".json", read_json_documents)
register_reader("conversations", read_conversations)
register_reader("sql", records_from_query)
