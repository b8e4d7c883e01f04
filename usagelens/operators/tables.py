"""Keyed writes without a table format: upserts, idempotent appends, versioned tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


# ------------------------------------------------------------------- upserts
def upsert(target: DataFrame, updates: DataFrame, keys: list[str], order: list[str] | None = None,
           keep_first: tuple[str, ...] = ()) -> DataFrame:
    """`target` with the rows of `updates` put in place by key.

    Updates win over stored rows and, among themselves, the greatest `order`
    wins. Columns in `keep_first` (a creation time) keep the stored value. The
    winner is an aggregate, so rows fold on the map side and a key with very
    many versions is no single-task sort.
    """
    both = target.withColumn("_new", F.lit(0)).unionByName(
        updates.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    out = _folded(both, "_new", keys, order or (), keep_first)
    return out.select(*target.columns, *[c for c in out.columns if c not in target.columns])


def _folded(rows: DataFrame, age: str, keys, order=(), keep_first=()) -> DataFrame:
    """One row per key: the greatest by (`age`, `order`), with the stored value of `keep_first` columns."""
    rank = F.struct(F.col(age), *[F.col(c) for c in order])
    columns = [c for c in rows.columns if c not in (*keys, age)]
    if not columns:
        return rows.select(*keys).distinct()
    # One buffer per key where every column can be compared; maps and variants cannot.
    if all(_orderable(rows, c) for c in columns):
        winner = F.max(F.struct(rank.alias("_rank"), *columns))
    else:
        winner = F.max_by(F.struct(*columns), F.struct(rank, *[c for c in columns if _orderable(rows, c)]))
    firsts = [F.min_by(c, F.struct(age, *order)).alias(f"_first_{c}") for c in keep_first]
    out = rows.groupBy(*keys).agg(winner.alias("_w"), *firsts)
    picked = [F.coalesce(f"_first_{c}", f"_w.{c}").alias(c) if c in keep_first else F.col(f"_w.{c}") for c in columns]
    return out.select(*keys, *picked)


def _orderable(frame: DataFrame, column: str) -> bool:
    kind = frame.schema[column].dataType.simpleString()
    return not any(word in kind for word in ("map", "variant"))


def upsert_columns(target: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Stored rows take only `columns` from an update; unknown keys are inserted whole."""
    u = updates.select(F.col(key), F.struct(*[c for c in updates.columns if c != key]).alias("_u"))
    t = target.select(F.col(key), F.struct(*[c for c in target.columns if c != key]).alias("_t"))
    joined = t.join(u, key, "full_outer")
    have = F.col("_t").isNotNull() & F.col("_u").isNotNull()
    out = []
    for c in target.columns:
        if c == key:
            out.append(F.col(key))
            continue
        stored, new = F.col(f"_t.{c}"), F.col(f"_u.{c}") if c in updates.columns else F.lit(None)
        mixed = new if c in columns else stored
        out.append(F.when(have, mixed).when(F.col("_t").isNull(), new).otherwise(stored).alias(c))
    return joined.select(*out)


def new_rows(existing: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not stored yet, each key once: what an idempotent append adds."""
    return rows.dropDuplicates(keys).join(existing.select(*keys).distinct(), keys, "left_anti")


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    columns = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_w")).select(*keys, "_w.*")


def keep_last(rows: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The last n entries of a log."""
    return rows.orderBy(*[F.desc(c) for c in order]).limit(n)


def keep_last_per_key(rows: DataFrame, keys: list[str], n: int, order: list[str]) -> DataFrame:
    """The last n entries per key.

    A row number with an upper bound is planned as a group limit: every task
    keeps at most n rows per key before the shuffle, so a hot key stays small.
    """
    window = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") <= n).drop("_rn")


def checked_insights(insights: DataFrame) -> DataFrame:
    """Rows that satisfy the table's check: the risk score lies in 0..100."""
    return insights.filter(F.col("risk_score").between(0, 100))


def swap_recommendations(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Active rows become historical; the new ones are active."""
    old = stored.withColumn("status", F.when(F.col("status") == "active", "historical").otherwise(F.col("status")))
    return old.unionByName(fresh.withColumn("status", F.lit("active")), allowMissingColumns=True)


def active_recommendations(stored: DataFrame) -> DataFrame:
    return stored.filter(F.col("status") == "active").orderBy(F.desc("impact_score"), F.desc("created_at"), "title")


def run_row(spark: SparkSession, run_id: str, messages: Column, rules: Column, matches: Column, as_of: Column,
            notes: str | None = None) -> DataFrame:
    """The one-row run log entry of a completed run."""
    return spark.range(1).select(
        F.lit(run_id).alias("id"), messages.cast("bigint").alias("source_message_count"),
        rules.cast("bigint").alias("rule_count"), matches.cast("bigint").alias("match_count"),
        F.lit("completed").alias("status"), F.lit(notes).cast("string").alias("notes"), as_of.alias("created_at"),
        as_of.alias("completed_at"))


def has_completed_run(runs: DataFrame) -> bool:
    return not runs.filter(F.col("status") == "completed").limit(1).isEmpty()


# ---------------------------------------------------------- versioned tables
class VersionedTable:
    """A table as numbered Parquet folders: whole versions (`v=`), rows added since (`_new=`) and rows upserted since (`_put=`).

    `append_new` writes the new rows only, whatever the table holds, and so does
    `upsert` where the table was opened with its `keys`: a read folds what was
    upserted over the newest whole version, and `compact` stores that as a new
    one. A folder counts once it carries its success marker, so a lost writer
    leaves the table as it was. One writer at a time. The last two whole
    versions and what follows them stay, older folders are deleted.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, keys: tuple[str, ...] = (), order: tuple[str, ...] = ()):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.keys, self.order = tuple(keys), tuple(order)

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path, jvm.org.apache.hadoop.fs.Path

    def _folders(self) -> dict[int, str]:
        """The kind of each complete folder, by its number."""
        files, root, path = self._files()
        if not files.exists(root):
            return {}
        parts = [s.getPath().getName().partition("=") for s in files.listStatus(root)]
        return {int(n): kind for kind, _, n in parts if kind in ("v", "_new", "_put") and n.isdigit()
                and files.exists(path(f"{self.path}/{kind}={n}/_SUCCESS"))}

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], self.schema)

    def versions(self) -> list[int]:
        return sorted(self._folders())

    def read(self, version: int | None = None) -> DataFrame:
        """The rows as of a version, or the newest."""
        folders = {n: kind for n, kind in self._folders().items() if version is None or n <= version}
        whole = max((n for n, kind in folders.items() if kind == "v"), default=0)
        empty = self._empty()
        rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/v={whole}") if whole else empty
        rows = rows.withColumn("_age", F.lit(0))
        for kind in ("_new", "_put"):
            if paths := [f"{self.path}/{kind}={n}" for n in sorted(folders) if n > whole and folders[n] == kind]:
                reader = self.spark.read.schema(self._empty().schema.add(kind, "integer")).option("basePath", self.path)
                rows = rows.unionByName(reader.parquet(*paths).withColumnRenamed(kind, "_age"))
        if not any(n > whole and kind == "_put" for n, kind in folders.items()):
            return rows.drop("_age")
        if not self.keys:
            raise ValueError(f"{self.path} was upserted by key: open it with its keys")
        return _folded(rows, "_age", self.keys, self.order).select(*empty.columns)

    def _store(self, rows: DataFrame, kind: str, partition_by: tuple[str, ...] = ()) -> int:
        number = (self.versions() or [0])[-1] + 1
        writer = rows.write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.path}/{kind}={number}")
        return number

    def _typed(self, rows: DataFrame) -> DataFrame:
        have = set(rows.columns)
        return rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
                             for f in self._empty().schema])

    def write(self, rows: DataFrame, partition_by: tuple[str, ...] = ()) -> int:
        """A new whole version; returns its number."""
        number = self._store(rows, "v", partition_by)
        folders = self._folders()
        oldest = sorted(n for n, kind in folders.items() if kind == "v")[-2:][0]
        files, _, path = self._files()
        for n in [n for n in folders if n < oldest]:
            files.delete(path(f"{self.path}/{folders[n]}={n}"), True)
        return number

    def upsert(self, updates: DataFrame, keys: list[str], order: list[str] | None = None,
               keep_first: tuple[str, ...] = ()) -> int:
        """Put rows in place by key. Without declared keys, or to keep first values, the whole table is written anew."""
        if self.keys and (self.keys != tuple(keys) or tuple(order or ()) != self.order):
            raise ValueError(f"the table is keyed by {self.keys}, ordered by {self.order}")
        if self.keys and not keep_first:
            return self._store(self._typed(updates), "_put")
        return self.write(upsert(self.read(), updates, keys, order, keep_first))

    def append_new(self, rows: DataFrame, keys: list[str]) -> int:
        """Add the rows whose key is not stored yet; only they are written."""
        return self._store(self._typed(new_rows(self.read(), rows, keys)), "_new")

    def compact(self) -> int:
        """Fold all changes into a new whole version."""
        return self.write(self.read())

    def wipe(self) -> int:
        """Replace the content by nothing; returns how many rows there were."""
        before = self.read().count()
        self.write(self._empty())
        return before


def write_json_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_views(views: dict[str, DataFrame], tables: dict[str, VersionedTable]) -> dict[str, int]:
    """Refresh each view's table; returns the new version numbers."""
    return {name: tables[name].write(frame) for name, frame in views.items() if name in tables}
