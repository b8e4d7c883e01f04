"""Connected components of a graph given as edges, by Spark joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import attach_by_key
from usagelens.session import materialise


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", label: str = "cc", file_rows: int | None = None) -> DataFrame:
    """(v, label) of every vertex with an edge; the label is the smallest vertex reachable.

    Each round takes the smallest label among the neighbours and then jumps to
    the label's own label, so paths shorten by more than half a round. Rounds
    are written to the shared folder, which cuts the lineage. Hubs (a label that
    most vertices carry) are dealt over salts. With `file_rows` a round is written
    as one file for each so many edges at most; else as many as the shuffle has partitions.
    """

    def few(rows: DataFrame) -> DataFrame:
        return rows if file_rows is None else rows.coalesce(files)

    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    both = materialise(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{label}-edges")
    files = 1 if file_rows is None else both.count() // file_rows + 1
    labels = materialise(few(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "v")), f"{label}-labels")
    while not labels.isEmpty():
        near = attach_by_key(both, labels.select(F.col("v").alias("b"), "label"), "b", "a").groupBy("a").agg(F.min("label").alias("_near"))
        least = labels.join(near, F.col("v") == F.col("a")).select("v", F.col("label").alias("_old"), F.least("label", "_near").alias("label"))
        least = materialise(few(least), f"{label}-least")
        jump = attach_by_key(least, least.select(F.col("v").alias("label"), F.col("label").alias("_far")), "label", "v")
        labels = materialise(few(jump.select("v", "_old", F.least("label", "_far").alias("label"))), f"{label}-labels")
        if labels.filter("label <> _old").isEmpty():
            break
    return labels.select("v", "label")
