"""CSV and JSON files cut into records by many tasks.

A reader that knows quotes needs a file's beginning, so one task reads a file of
any size. Here the file is read in pieces (lines of CSV, text between two `},` of
JSON) by its splits. What a piece does to the reader's state is worked out for
every state it may begin in; states then follow per split by a window and over
splits by a prefix of one small row each. Records begin where the state says so,
and only those that reach over a split's end meet in a second step.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from usagelens.session import materialise
from usagelens.sources.files import block_window, plain_path

#: Between two of these in JSON text lies at most the end of one object and the beginning of the next.
JSON_CUT = "},"
_BEFORE = Window.unboundedPreceding, -1


def pieces(spark: SparkSession, root: str, separator: str, glob: str | None = None, recursive: bool = False) -> DataFrame:
    """(path, block, place, text): the text between separators, with its file split and its place in it."""
    reader = spark.read.option("lineSep", separator).option("recursiveFileLookup", str(recursive).lower())
    rows = (reader.option("pathGlobFilter", glob) if glob else reader).text(root)
    return rows.select(plain_path(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.file_block_start").alias("block"),
                       F.monotonically_increasing_id().alias("place"), F.col("value").alias("text"))


def _over_blocks() -> Window:
    return Window.partitionBy("path").orderBy("block")


def joined(rows: DataFrame, separator: str) -> DataFrame:
    """(path, block, record, text, last) from pieces (path, block, place, text, starts), where `starts` says that a record begins.

    Records are numbered within their file, `block` is the split they begin in,
    and `last` marks the file's last one. A split's first pieces may end a record
    of an earlier split; those and the last record of each split are the only
    ones that travel once more.
    """
    inside = rows.withColumn("_r", F.sum(F.col("starts").cast("int")).over(block_window()))
    blocks = rows.groupBy("path", "block").agg(F.sum(F.col("starts").cast("int")).alias("_n"))
    blocks = blocks.select("path", "block", "_n", F.coalesce(F.sum("_n").over(_over_blocks().rowsBetween(*_BEFORE)), F.lit(0)).alias("_base"),
                           F.sum("_n").over(Window.partitionBy("path")).alias("_all"))
    said = F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda p: p["text"])
    parts = inside.groupBy("path", "block", "_r").agg(F.array_join(said, separator).alias("text")).join(blocks, ["path", "block"])
    parts = parts.withColumn("record", F.col("_base") + F.col("_r") - 1).withColumn("last", F.col("record") == F.col("_all") - 1)
    at_edge = (F.col("_r") == 0) | (F.col("_r") == F.col("_n"))
    whole = parts.filter(~at_edge).select("path", "block", "record", "text", "last")
    over = F.transform(F.sort_array(F.collect_list(F.struct("block", "text"))), lambda p: p["text"])
    edges = parts.filter(at_edge).groupBy("path", "record").agg(
        F.min("block").alias("block"), F.array_join(over, separator).alias("text"), F.first("last").alias("last"))
    return whole.unionByName(edges).filter("record >= 0")


# ------------------------------------------------------------------------ CSV
def _after(text: Column, state: int) -> Column:
    """The state behind a line that begins outside (0) or inside (1) a quoted field.

    A quote opens a field only at its beginning. Inside, a quote closes the field
    unless another one follows at once; 2 stands for a quote inside that may still be either.
    """
    parts = F.split(text, '"', -1)

    def step(acc: Column, part: Column) -> Column:
        first, was = acc["first"], acc["state"]
        opens = F.when(part == "", first).otherwise(part.endswith(","))  # the field begins at this quote
        now = F.when(was == 1, 2).when((was == 2) & (part == ""), 1).when(opens, 1).otherwise(0)
        return F.struct(F.lit(False).alias("first"), now.alias("state"))

    begin = F.struct(F.lit(state == 0).alias("first"), F.lit(state).alias("state"))
    # One step per quote, with the text before it.
    last = F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), begin, step)["state"]
    return F.when(F.contains(text, F.lit('"')), (last == 1).cast("int")).otherwise(state)


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, record, text, last) of every CSV record, line breaks in quoted fields included; empty lines are none.

    Quotes are doubled inside quotes. A line leaves the state alone, flips it, or
    sets it whatever it was, so the state before a line is what the last setting
    line said, flipped as often as lines flip since then.
    """
    lines = pieces(spark, path, "\n")
    lines = lines.withColumn("_0", _after(F.col("text"), 0)).withColumn("_1", _after(F.col("text"), 1))
    flips = ((F.col("_0") == 1) & (F.col("_1") == 0)).cast("int")
    lines = lines.withColumn("_flips", F.sum(flips).over(block_window()))
    # What a setting line says, as seen from the block's beginning; null for the others.
    lines = lines.withColumn("_set", F.when(F.col("_0") == F.col("_1"), (F.col("_0") + F.col("_flips")) % 2))
    before = block_window().rowsBetween(*_BEFORE)
    lines = lines.withColumns({"_said": F.last("_set", ignorenulls=True).over(before), "_turned": F.coalesce(F.lag("_flips").over(block_window()), F.lit(0))})
    blocks = lines.groupBy("path", "block").agg(F.max("_flips").alias("_f"), F.max_by("_set", F.when(F.col("_set").isNotNull(), F.col("place"))).alias("_s"))
    # The same over blocks: a block ends with `_s` flipped `_f` times, or with what it began with, flipped as often.
    turned = F.sum("_f").over(_over_blocks())
    blocks = blocks.withColumn("_turns", turned).withColumn("_sets", (F.col("_s") + F.col("_f") + F.col("_turns")) % 2)
    earlier = _over_blocks().rowsBetween(*_BEFORE)
    begin = (F.coalesce(F.last("_sets", ignorenulls=True).over(earlier), F.lit(0)) + F.coalesce(F.sum("_f").over(earlier), F.lit(0))) % 2
    blocks = blocks.select("path", "block", begin.alias("_begin"))
    state = (F.coalesce("_said", "_begin") + F.col("_turned")) % 2
    placed = lines.join(blocks, ["path", "block"]).withColumn("starts", state == 0)
    kept = placed.filter(~(F.col("starts") & F.col("text").isin("", "\r")))
    out = joined(kept.select("path", "block", "place", "text", "starts"), "\n")
    return out.withColumn("text", F.regexp_replace("text", "\r$", ""))


# ----------------------------------------------------------------------- JSON
def _depth(text: Column) -> Column:
    """Brackets opened less brackets closed."""
    return F.length(F.regexp_replace(text, r"[^\[{]", "")) - F.length(F.regexp_replace(text, r"[^\]}]", ""))


def json_groups(spark: SparkSession, root: str, glob: str = "*.json", recursive: bool = False, stored: bool = False) -> DataFrame:
    """(path, block, record, is_list, text, whole): what the files hold, cut at the top level of arrays.

    `text` is JSON: for a file that is an array, an array of some consecutive
    elements of it (one, where elements are objects without space before the
    comma); for any other file all of it. `whole` is false where an array does
    not end. Strings hold no line breaks in JSON, but may hold brackets and
    commas, so what a piece opens depends on the quotes before it. With `stored`
    the files are read once and all steps read their pieces as a table: for
    folders of many small files, which cost more to open than to read.
    """
    rows = pieces(spark, root, JSON_CUT, glob, recursive)
    bare = F.split(F.regexp_replace("text", r"(?s)\\.", ""), '"', -1)
    rows = rows.withColumn("_bare", bare).withColumns({
        "_q": (F.size("_bare") - 1) % 2,
        "_d0": _depth(F.array_join(F.filter("_bare", lambda s, i: i % 2 == 0), "")),
        "_d1": _depth(F.array_join(F.filter("_bare", lambda s, i: i % 2 == 1), ""))}).drop("_bare")
    rows = materialise(rows, "json-pieces") if stored else rows
    rows = rows.withColumn("_q0", F.coalesce(F.sum("_q").over(block_window().rowsBetween(*_BEFORE)), F.lit(0)) % 2)
    # The cut itself closes a bracket, unless it stands in a string. Seen from a block that begins outside (a) or inside (b) a string.
    for name, begins in (("_a", 0), ("_b", 1)):
        inside = (F.col("_q0") + begins) % 2
        closes = F.when((inside + F.col("_q")) % 2 == 0, 1).otherwise(0)
        rows = rows.withColumn(name, F.when(inside == 0, F.col("_d0")).otherwise(F.col("_d1")) - closes)
    before = block_window().rowsBetween(*_BEFORE)
    rows = rows.withColumns({f"{c}before": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("_a", "_b")})
    lead = F.substring(F.ltrim(F.min_by("text", "place"), F.lit(" \t\r\n\ufeff")), 1, 1)
    blocks = rows.groupBy("path", "block").agg(F.sum("_q").alias("_q"), F.sum("_a").alias("_a"), F.sum("_b").alias("_b"), lead.alias("_lead"))
    earlier = _over_blocks().rowsBetween(*_BEFORE)
    blocks = blocks.withColumn("_in", F.coalesce(F.sum("_q").over(earlier), F.lit(0)) % 2)
    blocks = blocks.withColumn("_gain", F.when(F.col("_in") == 0, F.col("_a")).otherwise(F.col("_b")))
    blocks = blocks.select(
        "path", "block", "_in", F.coalesce(F.sum("_gain").over(earlier), F.lit(0)).alias("_depth"),
        (F.first("_lead").over(_over_blocks()) == "[").alias("is_list"), F.min("block").over(Window.partitionBy("path")).alias("_first"))
    placed = rows.select("path", "block", "place", "text", "_q0", "_abefore", "_bbefore").join(blocks, ["path", "block"])
    depth = F.col("_depth") + F.when(F.col("_in") == 0, F.col("_abefore")).otherwise(F.col("_bbefore"))
    opening = (F.col("block") == F.col("_first")) & (F.row_number().over(block_window()) == 1)
    starts = opening | (F.col("is_list") & ((F.col("_in") + F.col("_q0")) % 2 == 0) & (depth == 1))
    out = joined(placed.select("path", "block", "place", "text", starts.alias("starts")), JSON_CUT)
    lists = blocks.filter(F.col("block") == F.col("_first")).select("path", "is_list")
    text = F.when(F.col("last"), F.col("text")).otherwise(F.concat("text", F.lit("}")))
    begun = F.when(F.col("record") == 0, F.col("text")).otherwise(F.concat(F.lit("["), "text"))
    ended = F.when(F.col("last"), F.col("text")).otherwise(F.concat("text", F.lit("]")))
    return out.join(lists, "path").withColumn("text", text).withColumn("text", F.when(F.col("is_list"), begun).otherwise(F.col("text"))).withColumn(
        "text", F.when(F.col("is_list"), ended).otherwise(F.col("text"))).select(
        "path", "block", "record", "is_list", "text", (~F.col("is_list") | F.rtrim("text", F.lit(" \t\r\n")).endswith("]")).alias("whole"))


def json_items(spark: SparkSession, root: str, schema: str, glob: str = "*.json", recursive: bool = False, lists_only: bool = False,
               keep: Callable[[Column], Column] | None = None, groups: DataFrame | None = None) -> DataFrame:
    """(path, is_list, index, item): elements of arrays with their place in the file, or the one value of a file.

    `schema` is the type of an item; items that `keep` refuses are not counted.
    A file with a part that is no JSON gives no rows at all. Give the `groups` of
    files that are read already.
    """
    groups = json_groups(spark, root, glob, recursive) if groups is None else groups
    if lists_only:
        groups = groups.filter("is_list")
    as_list = F.when(F.col("is_list"), F.from_json("text", f"ARRAY<{schema}>"))
    one = F.try_parse_json("text") if schema == "VARIANT" else F.from_json("text", schema)
    items = F.when(F.col("is_list"), as_list).otherwise(F.array(one))
    bad = F.col("items").isNull() | ~F.col("whole") | (~F.col("is_list") & F.get("items", F.lit(0)).isNull())
    read = groups.select("path", "block", "record", "is_list", items.alias("items"), "whole").withColumn("bad", bad)
    if keep is not None:
        read = read.withColumn("items", F.filter("items", keep))
    numbered = Window.partitionBy("path", "block").orderBy("record")
    sizes = read.groupBy("path", "block").agg(F.sum(F.coalesce(F.size("items"), F.lit(0))).alias("_n"), F.max("bad").alias("_bad"))
    sizes = sizes.select("path", "block", F.coalesce(F.sum("_n").over(_over_blocks().rowsBetween(*_BEFORE)), F.lit(0)).alias("_base"),
                         F.max("_bad").over(Window.partitionBy("path")).alias("_bad")).filter("not _bad")
    inside = F.coalesce(F.sum(F.size("items")).over(numbered.rowsBetween(*_BEFORE)), F.lit(0))
    placed = read.withColumn("_i", inside).join(sizes, ["path", "block"])
    return placed.select("path", "is_list", (F.col("_base") + F.col("_i")).alias("_at"), F.posexplode("items").alias("_k", "item")).select(
        "path", "is_list", (F.col("_at") + F.col("_k")).cast("int").alias("index"), "item")
