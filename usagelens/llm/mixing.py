"""Mixing sources to target weights by systematic sampling.

Sizes and orders stay distributed: rows are laid out by range of (source, size,
id), each range knows its first place in every source from a prefix over ranges
(a table of ranges x sources), and a window numbers the rows within a range. A
source with a third of all rows is spread over a third of the ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagelens.llm.common import prefix_before, text_of, unused
from usagelens.session import materialise

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2.0


def word_count(text: Column) -> Column:
    """Number of words between ASCII white space; 0 for null."""
    parts = F.split(text_of(text), "[\\x20\\x09-\\x0D]+")
    return (F.size(parts) - (F.element_at(parts, 1) == "").cast("int") - ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")).cast("long")


def offset_of(source: Column, seed: str) -> Column:
    """The source's one random offset in [0, 1), from a digest, so that reruns agree."""
    digest = F.md5(F.concat(F.lit(seed), F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target of a table (source, size).

    Sources by code point, null last, take the weights in turn and divide
    `share` x all sizes by them. A target stops at `most` x its source's size;
    the excess is dealt again by weight until no target is above. The rounds are
    aggregates over the source table; only sums come to the driver. A total of 0
    gives targets of 0.
    """
    by_source = materialise(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    ranked = by_source.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("_range", F.spark_partition_id())
    ranked = materialise(ranked, "mix-ranked")
    before = prefix_before(ranked.groupBy("_range").agg(F.count("*").alias("_n")).withColumn("_all", F.lit(0)), ["_all"], "_range", "_n", "_before")
    place = F.row_number().over(Window.partitionBy("_range").orderBy(F.col("source").isNull(), "source")) + F.col("_before") - 1
    turn = F.array(*[F.lit(float(w)) for w in weights])
    weighed = materialise(ranked.join(before.select("_range", "_before"), "_range").select(
        "source", "source_size", F.element_at(turn, (F.pmod(place, F.lit(len(weights))) + 1).cast("int")).alias("_weight"),
        (F.lit(float(most)) * F.col("source_size")).alias("_cap")), "mix-weighed")
    total = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * share
    level, capped = None, -1
    while True:
        above = F.lit(False) if level is None else F.col("_cap") < F.col("_weight") * F.lit(level)
        number, held, weight = weighed.agg(
            F.count_if(above), F.coalesce(F.sum(F.when(above, F.col("_cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, F.col("_weight"))), F.lit(0.0))).first()
        if number == capped or not weight:
            break
        capped, level = number, (total - held) / weight
    target = F.least(F.col("_cap"), F.col("_weight") * F.lit(level if level is not None else 0.0))
    return weighed.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = "mix",
        id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken.

    Every document of a source expects target / source_size copies. Documents in
    the order (size, id) add up their expected copies, one random offset is
    added, and a document is emitted once per integer boundary that its stretch
    crosses: at most `most` times (rounded up), and neighbours of like size make
    up for each other, so a source's taken words come within about one document
    of its target. The prefix sum of equal expectations is place x expectation,
    free of summing error. Null text: size 0. Null source: a source of its own,
    last. A source of size 0 expects nothing. Repeated rows take places of their own.
    """
    sizes = materialise(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                                    word_count(F.col(text_col)).alias("size")), "mix-sizes")
    order = [F.col("source").isNull(), F.col("source"), F.col("size"), F.col("doc_id")]
    laid = materialise(sizes.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "mix-laid")
    ranges = prefix_before(laid.groupBy("_range", "source").agg(F.count("*").alias("_n")), ["source"], "_range", "_n", "_before")
    facts = targets(sizes, weights, share, most).withColumnRenamed("source", "_source")
    facts = ranges.join(facts, F.col("source").eqNullSafe(F.col("_source"))).select(
        F.col("_range").alias("_r"), "_source", "_before", "source_size", "target")
    rows = laid.withColumn("_place", F.row_number().over(Window.partitionBy("_range", "source").orderBy("size", "doc_id")))
    rows = rows.join(facts, (F.col("_range") == F.col("_r")) & F.col("source").eqNullSafe(F.col("_source")))
    expected = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    place, start = F.col("_place") + F.col("_before"), offset_of(F.col("source"), seed)
    copies = (F.floor(place * expected + start) - F.floor((place - 1) * expected + start)).cast("long")
    return rows.withColumn("copies", copies).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it was emitted, with its own columns.

    Repeated rows of one id are told apart by nothing, so each takes the largest
    number of copies among them.
    """
    wanted, copies, copy = (unused(docs, c) for c in ("_wanted", "_copies", "_copy"))
    taken = mix(docs, **options).groupBy(F.col("doc_id").alias(wanted)).agg(F.max("copies").alias(copies)).filter(F.col(copies) > 0)
    return docs.join(taken, F.col("doc_id").eqNullSafe(F.col(wanted)), "inner").withColumn(
        copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).drop(wanted, copies, copy)
