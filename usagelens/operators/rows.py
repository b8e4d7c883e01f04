"""Generic row work: named steps, operation strings, de-duplication, comparison, extraction to documents."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.functions.text import strip
from usagelens.session import materialise


# ------------------------------------------------------------ record cleaning
def lowercase_columns(frame: DataFrame) -> DataFrame:
    return frame.toDF(*[c.lower() for c in frame.columns])


def strip_strings(frame: DataFrame) -> DataFrame:
    return frame.withColumns({c: strip(F.col(c)) for c, t in frame.dtypes if t == "string"})


def clean_map(record: Column) -> Column:
    """Lower-case keys, stripped values, no nulls."""
    kept = F.map_filter(record, lambda k, v: v.isNotNull())
    return F.transform_keys(F.transform_values(kept, lambda k, v: strip(v)), lambda k, v: F.lower(k))


def to_map(frame: DataFrame, name: str = "record") -> DataFrame:
    """Each row as a map of its non-null values."""
    pairs = [x for c in frame.columns for x in (F.lit(c), F.col(c).cast("string"))]
    return frame.select(F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()).alias(name))


@dataclass
class Steps:
    """A named chain of frame transformations, applied in the order added."""

    steps: list[tuple[str, Callable[[DataFrame], DataFrame]]] = field(default_factory=list)

    def add(self, name: str, step: Callable[[DataFrame], DataFrame]) -> "Steps":
        self.steps.append((name, step))
        return self

    def run(self, frame: DataFrame) -> DataFrame:
        return reduce(lambda f, s: f.transform(s[1]), self.steps, frame)


# ----------------------------------------------------------- operation strings
def apply_operations(frame: DataFrame, operations: list[str]) -> tuple[DataFrame, list[str]]:
    """Apply `sort:field`, `filter:field:value` and `limit:n` in order; others are skipped.

    Values compare as text; sorting puts numbers first, by value, then the rest
    by text, with a missing field as the empty text. A later sort keeps the order
    of the earlier ones among its equals.
    """
    applied = []
    order: list[Column] = []
    for operation in operations:
        kind, _, rest = operation.partition(":")
        if kind == "sort" and rest:
            name = rest.split(":", 1)[0]
            text = F.coalesce(F.col(name).cast("string"), F.lit("")) if name in frame.columns else F.lit("")
            number = text.try_cast("double")
            order = [number.isNull(), number, text, *order]
            frame = frame.orderBy(*order)
            applied.append(f"sort:{name}")
        elif kind == "filter" and ":" in rest:
            name, value = rest.split(":", 1)
            frame = frame.filter(F.col(name).cast("string") == value if name in frame.columns else F.lit(False))
            applied.append(f"filter:{name}:{value}")
        elif kind == "limit" and rest.isdigit():
            frame = frame.limit(int(rest))
            applied.append(f"limit:{rest}")
    return frame, applied


# -------------------------------------------------------------- duplicates
def duplicate_counts(frame: DataFrame) -> DataFrame:
    """One row: distinct rows, and how many rows repeat an earlier one."""
    small = frame.groupBy(*frame.columns).agg(F.count("*").alias("_n"))
    return small.agg(F.count("*").alias("unique_rows"),
                     (F.coalesce(F.sum("_n"), F.lit(0)) - F.count("*")).alias("duplicates_removed"))


def count_by_first(frame: DataFrame) -> DataFrame:
    return frame.groupBy(F.col(frame.columns[0]).alias("key")).agg(F.count("*").alias("row_count"))


# ------------------------------------------------------------- comparison
#: Buckets of each step; a table of so many numbers is sent to every task.
BUCKETS = 1 << 16


def compare_rows(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: only in a, only in b, equal or changed, and which columns changed."""
    columns = [c for c in a.columns if c in b.columns and c not in keys]
    left = a.select(*keys, F.struct(*columns).alias("_a"))
    right = b.select(*keys, F.struct(*columns).alias("_b"))
    changed = F.array_compact(F.array(*[
        F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), c) for c in columns]))
    joined = left.join(right, keys, "full_outer")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return joined.select(
        *keys, F.when(F.col("_b").isNull(), "only_a").when(F.col("_a").isNull(), "only_b")
        .when(F.size(changed) > 0, "changed").otherwise("same").alias("status"),
        F.when(both, changed).otherwise(F.array().cast("array<string>")).alias("changed_columns"))


def compare_counts(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return compare_rows(a, b, keys).groupBy("status").agg(F.count("*").alias("row_count"))


def _hashed(frame: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows with a coarse and a fine bucket of their key and two hashes of all they hold; nulls count by place."""
    key = F.xxhash64(*keys)
    flags = [F.col(c).isNull() for c in (*keys, *columns)]
    held = [F.col(c) for c in (*keys, *columns)]
    return frame.select(*keys, *columns, F.pmod(key, F.lit(BUCKETS)).cast("int").alias("_coarse"),
                        F.pmod(F.shiftright(key, 20), F.lit(BUCKETS)).cast("int").alias("_fine"),
                        F.xxhash64(*held, *flags).alias("_x"), F.xxhash64(F.lit(1), *flags, *held).alias("_y"))


def _differing(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Buckets in which the rows of the two sides differ: their number, or their hashes added up."""
    digest = [F.count("*").alias("_n"), F.bit_xor("_x").alias("_d"), F.sum(F.col("_y").cast("decimal(38,0)")).alias("_s")]
    left, right = (side.groupBy(*by).agg(F.struct(*digest).alias(name)) for side, name in ((a, "_l"), (b, "_r")))
    return left.join(right, by, "full_outer").filter(~F.col("_l").eqNullSafe(F.col("_r"))).select(*by)


def differing_rows(a: DataFrame, b: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of both sides that lie in buckets with a difference, found by digests in two steps.

    Coarse digests are one row per bucket (at most BUCKETS); only rows of coarse
    buckets that differ are digested by fine ones, so of two tables that are nearly
    equal nearly nothing moves. Equal digests of different rows need two 64-bit hashes to agree.
    """
    columns = [c for c in a.columns if c in b.columns and c not in keys]
    left, right = (_hashed(side, keys, columns) for side in (a, b))
    coarse = F.broadcast(materialise(_differing(left, right, ["_coarse"]), "diff-coarse"))
    left, right = (side.join(coarse, "_coarse", "left_semi") for side in (left, right))
    fine = materialise(_differing(left, right, ["_coarse", "_fine"]), "diff-fine")
    return tuple(side.join(fine, ["_coarse", "_fine"], "left_semi").select(*keys, *columns) for side in (left, right))


def compare_changes(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """`compare_rows` without the rows that are the same; only rows of differing buckets are joined."""
    return compare_rows(*differing_rows(a, b, keys), keys).filter("status <> 'same'")


def compare_maps(a: Column, b: Column) -> Column:
    """Key sets of two maps: only in a, only in b, shared, and shared with other values."""
    ka, kb = F.map_keys(a), F.map_keys(b)
    shared = F.array_intersect(ka, kb)
    changed = F.filter(shared, lambda k: ~F.element_at(a, k).eqNullSafe(F.element_at(b, k)))
    return F.struct(
        F.array_sort(F.array_except(ka, kb)).alias("only_a"), F.array_sort(F.array_except(kb, ka)).alias("only_b"),
        F.array_sort(shared).alias("shared"), F.array_sort(changed).alias("changed"))


def row_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a that b does not hold as often."""
    return a.exceptAll(b)


def row_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)
