"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SALTS = 16


def text_of(column: Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(column.cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character left alone.

    `lower` knows all scripts, so it is used only where a text is all ASCII.
    """
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def held_out(id_column: Column) -> Column:
    """Rows kept for evaluation: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def salt_of(*columns: Column, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int")


def semi_by_id(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of `docs` whose doc_id is (or with left_anti: is not) in the one column of `ids`; null ids are equal. Names can't clash."""
    other = unused(docs, "_wanted")
    return docs.join(ids.toDF(other), F.col("doc_id").eqNullSafe(F.col(other)), how)


def unused(df: DataFrame, name: str) -> str:
    """`name`, made longer until `df` has no such column."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def attach_by_key(rows: DataFrame, table: DataFrame, key: str, row_id: str, salts: int = SALTS) -> DataFrame:
    """Join `table` (one row per `key`) to `rows` where one key may hold a large share of the rows.

    The rows of a key are dealt over `salts` joins. The table is repeated only
    for the salts that its key has, which a distinct (folded before the
    shuffle) finds, so rare keys are not multiplied. A null key joins null.
    """
    salted = rows.withColumn("_salt", salt_of(F.col(row_id), salts=salts))
    seen = salted.select(F.col(key).alias("_key"), F.col("_salt").alias("_part")).distinct()
    spread = seen.join(table, F.col("_key").eqNullSafe(F.col(key)), "inner").drop(key)
    return salted.join(spread, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_salt") == F.col("_part")), "inner").drop(
        "_salt", "_key", "_part")


def prefix_before(pieces: DataFrame, group: list[str], order: str, value: str, name: str) -> DataFrame:
    """For each piece the sum of `value` over the pieces before it in its group.

    For tables of pieces (range partitions, blocks), never of rows.
    """
    before = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return pieces.withColumn(name, F.coalesce(F.sum(value).over(before), F.lit(0)))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows at most, for work that keeps something of every row of a batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def whole_groups(batches: Iterator[pa.RecordBatch], key: int = 0) -> Iterator[pa.RecordBatch]:
    """Batches cut so that all rows of a key are in one of them; rows come sorted by the key column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        others = np.flatnonzero(keys != keys[-1])
        cut = int(others[-1]) + 1 if len(others) else 0
        if cut or (held and held[-1].column(key)[-1].as_py() != keys[0]):
            yield pa.concat_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.concat_batches(held)
