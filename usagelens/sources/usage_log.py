"""Usage logs as JSON lines: strict and lenient readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.functions.text import is_blank, parse_iso, usage_word_count
from usagelens.schemas import USAGE_RAW


def with_defaults(raw: DataFrame, as_of: Column, line: Column | None = None) -> DataFrame:
    """Fill absent fields: `unknown`, 0, the given time; add the word count."""
    def text(name: str, default: str | None) -> Column:
        return F.coalesce(F.nullif(name, F.lit("")), F.lit(default))

    tokens = F.coalesce("token_count", F.lit(0))
    digest = F.substring(F.sha1(line), 1, 16) if line is not None else F.lit(None).cast("string")
    stamp = lambda c: F.coalesce(parse_iso(F.col(c)), as_of)
    rows = raw.select(
        F.coalesce(F.nullif("id", F.lit("")), digest).alias("id"), text("user_id_hash", "").alias("user_id_hash"),
        text("department_id", "unknown").alias("department_id"), text("tool_name", "unknown").alias("tool_name"),
        text("model_name", "unknown").alias("model_name"), stamp("usage_start").alias("usage_start"),
        stamp("usage_end").alias("usage_end"), tokens.alias("token_count"), F.coalesce("cost", F.lit(0.0)).alias("cost"),
        text("purpose", "").alias("purpose"), F.nullif("region", F.lit("")).alias("region"))
    return rows.withColumn("word_count", usage_word_count(F.col("purpose"), F.col("token_count")))


def read_strict(spark: SparkSession, path: str, as_of: Column) -> DataFrame:
    """Blank lines are skipped; a line that is no valid record fails the job."""
    lines = spark.read.text(path).filter(~is_blank(F.col("value")))
    parsed = lines.select(F.trim("value").alias("line"), F.from_json("value", USAGE_RAW, {"mode": "FAILFAST"}).alias("r"))
    return with_defaults(parsed.select("line", "r.*"), as_of, F.col("line"))


def _lenient(lines: DataFrame) -> DataFrame:
    schema = USAGE_RAW + ", _bad STRING"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    return lines.filter(~is_blank(F.col("text"))).withColumn("r", F.from_json("text", schema, options))


def read_lenient(lines: DataFrame, as_of: Column) -> DataFrame:
    """Lines (see `files.text_lines`) that parse; bad ones are left out."""
    good = _lenient(lines).filter(F.col("r").isNotNull() & F.col("r._bad").isNull())
    return with_defaults(good.select(F.trim("text").alias("line"), "r.*"), as_of, F.col("line"))


def bad_lines(numbered: DataFrame) -> DataFrame:
    """The lines the lenient reader leaves out, with their one-based numbers."""
    bad = _lenient(numbered).filter(F.col("r").isNull() | F.col("r._bad").isNotNull())
    return bad.select("path", (F.col("line") + 1).alias("line"), "text")
