"""Labelled samples for fitting classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import held_out, text_of


def labelled(docs: DataFrame, labels: DataFrame, column: str, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """At most about `rows` labelled documents to learn from: (key, label, t, rest), rest 0-9 for a split.

    Only ids outside the held-out third count. The ids are chosen by hash, so
    the choice is the same in every run; the chosen id list, at most `rows`
    numbers, is broadcast and the texts are never sorted. Several labels of one
    id count as their largest, null labels as none.
    """
    ids = labels.filter(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        F.max(F.col(column)).cast("int").alias("label"))
    key = F.xxhash64(F.col("doc_id"), F.lit("sample"))
    chosen = ids.withColumn("key", key).orderBy("key").limit(rows).withColumnRenamed("doc_id", "_id")
    return docs.select(F.col(id_col).cast("long").alias("_id"), text_of(F.col(text_col)).alias("t")).join(
        F.broadcast(chosen), "_id").select("key", "label", "t", F.pmod(F.col("key"), F.lit(10)).alias("rest"))


def sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))
