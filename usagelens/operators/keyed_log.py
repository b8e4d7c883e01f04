"""Tables that only grow, read by the buckets of a batch alone."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from usagelens.session import materialise


class KeyedLog:
    """Plain Parquet in partition folders by a hash of `bucket_by` (the keys, or some of the columns that fix them).

    `append_new` adds the rows whose key is not stored yet, each key once. Of the
    history it reads the key columns in the folders that its own rows fall in, and
    lists no other folder, so growth elsewhere costs a batch nothing. A replayed
    batch finds its rows stored and adds nothing, also where the first attempt was
    lost half way. Null keys are equal. One writer at a time.

    `buckets` is part of the layout: opening a table with another number is an
    error. A batch brings at most that many numbers to the driver. Give so many
    that a bucket's keys stay within some hundred megabytes.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, keys: tuple[str, ...],
                 bucket_by: tuple[str, ...] = (), buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.schema = spark.createDataFrame([], schema).schema
        self.keys, self.bucket_by = tuple(keys), tuple(bucket_by or keys)
        self.folder = f"bucket_of_{buckets}"

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(c).cast(self.schema[c].dataType) for c in self.bucket_by]), F.lit(self.buckets)).cast("int")

    def _files(self, pattern: str) -> DataFrame:
        """The rows, with their bucket, of the folders that `pattern` names; none where there are none."""
        try:
            rows = self.spark.read.schema(self.schema).option("basePath", self.path).parquet(pattern)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = self.spark.createDataFrame([], self.schema)
        other = [c for c in rows.columns if c.startswith("bucket_of_") and c != self.folder]
        if other:
            raise ValueError(f"{self.path} was made with {other[0]}, not {self.folder}")
        return rows if self.folder in rows.columns else rows.withColumn(self.folder, self._bucket())

    def read(self) -> DataFrame:
        return self._files(self.path).drop(self.folder)

    def near(self, rows: DataFrame) -> DataFrame:
        """What is stored in the buckets of `rows`, which need the columns of `bucket_by`."""
        own = sorted(r[0] for r in rows.select(self._bucket()).distinct().collect())
        if not own:
            return self.spark.createDataFrame([], self.schema)
        found = self._files(f"{self.path}/{self.folder}={{{','.join(map(str, own))}}}")
        if not found.inputFiles():
            self.read()  # refuses a table of another layout
        return found.drop(self.folder)

    def append_new(self, rows: DataFrame) -> None:
        """Add the rows with new keys; columns by name, absent ones null. `rows` is worked out twice."""
        have = set(rows.columns)
        typed = rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema])
        stored = self.near(typed).select(*[F.col(k).alias(f"_stored_{k}") for k in self.keys])
        same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_stored_{k}")) for k in self.keys])
        fresh = typed.dropDuplicates(list(self.keys)).join(stored, same, "left_anti")
        self._write(fresh.withColumn(self.folder, self._bucket()), "append")

    def _write(self, rows: DataFrame, mode: str) -> None:
        # One file per bucket where it is small; a large bucket is split.
        rows.hint("rebalance", self.folder).write.mode(mode).option(
            "partitionOverwriteMode", "dynamic").partitionBy(self.folder).parquet(self.path)

    def compact(self) -> None:
        """Put the files of each bucket together; the rows are stored elsewhere before a folder is replaced."""
        self._write(materialise(self._files(self.path), "log-compact"), "overwrite")

    def wipe(self) -> int:
        """Remove all rows; returns how many there were."""
        before = self.read().count()
        empty = self.spark.createDataFrame([], self.schema).withColumn(self.folder, F.lit(0))
        empty.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(self.folder).parquet(self.path)
        return before
