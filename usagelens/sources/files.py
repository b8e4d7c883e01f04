"""File helpers: paths, names, and line numbers for files of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def plain_path(uri: Column) -> Column:
    """A file URI as a readable path."""
    decoded = F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, r"^file:/+", "/")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def parent_name(path: Column) -> Column:
    return F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-2)), F.lit(""))


def whole_files(spark: SparkSession, root: str, glob: str, recursive: bool = False) -> DataFrame:
    """(path, text) of each file; for formats that are one document per file."""
    reader = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
    return reader.text(root, wholetext=True).select(
        plain_path(F.col("_metadata.file_path")).alias("path"), F.col("value").alias("text"))


def text_lines(spark: SparkSession, root: str, glob: str = "*.jsonl", recursive: bool = True) -> DataFrame:
    """(path, block, place, text): lines with their file split and their place in it.

    Files stay splittable, so a huge log is read by many tasks. Line numbers are
    added by `number_lines` without sorting a file as a whole.
    """
    reader = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
    return reader.text(root).select(
        plain_path(F.col("_metadata.file_path")).alias("path"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"),
        F.col("value").alias("text"))


def block_window():
    """Rows of one file split in order: bounded by the split size, unlike a whole file."""
    return Window.partitionBy("path", "block").orderBy("place")


def _earlier_blocks():
    return Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)


def number_lines(lines: DataFrame, name: str = "line") -> DataFrame:
    """Add the zero-based number of each row within its file.

    Per split: the row's number in it; per file: the sum of earlier splits'
    counts, a window over one small row per split. Only counts cross from one
    scan to the other, so both may be planned differently.
    """
    inside = lines.withColumn("_i", F.row_number().over(block_window()) - 1)
    blocks = lines.groupBy("path", "block").agg(F.count("*").alias("_n"))
    base = blocks.withColumn("_base", F.coalesce(F.sum("_n").over(_earlier_blocks()), F.lit(0))).drop("_n")
    return inside.join(base, ["path", "block"]).withColumn(name, (F.col("_base") + F.col("_i")).cast("int")).drop("_base", "_i")


def running_count(rows: DataFrame, name: str) -> DataFrame:
    """Add the zero-based running number of the rows left in each file."""
    inside = rows.withColumn("_i", F.row_number().over(block_window()) - 1)
    blocks = rows.groupBy("path", "block").agg(F.count("*").alias("_n"))
    base = blocks.withColumn("_base", F.coalesce(F.sum("_n").over(_earlier_blocks()), F.lit(0))).drop("_n")
    return inside.join(base, ["path", "block"]).withColumn(name, (F.col("_base") + F.col("_i")).cast("int")).drop(
        "_i", "_base")


def carry_forward(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """Add the last non-null `value` of the earlier rows of the file (null before the first)."""
    held = rows.withColumn("_v", value)
    before = block_window().rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("_inside", F.last("_v", ignorenulls=True).over(before))
    blocks = held.filter(F.col("_v").isNotNull()).groupBy("path", "block").agg(
        F.max_by("_v", "place").alias("_end"))
    all_blocks = held.select("path", "block").distinct().join(blocks, ["path", "block"], "left")
    carried = all_blocks.select("path", "block", F.last("_end", ignorenulls=True).over(_earlier_blocks()).alias("_from"))
    return held.join(carried, ["path", "block"]).withColumn(name, F.coalesce("_inside", "_from")).drop(
        "_v", "_inside", "_from")
