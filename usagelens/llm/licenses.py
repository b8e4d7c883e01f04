"""License scans by diagonal voting.

Every run of K words of a text is hashed and joined to the same runs of license
templates. A hit votes for its diagonal, text position minus template offset; a
passage that repeats a template votes for one diagonal again and again, and a
word put in or left out moves the rest to a neighbouring one. Diagonals at most
GAP apart merge into a span, which counts if enough of the template is covered.

The hits are checked word by word in the join, so a diagonal that holds all runs
of a template is an exact occurrence. Templates are a list in the call, at most
MOST_RUNS runs, so their broadcast is bounded. Offsets are kept as bits of one
number, so votes fold on the map side; what is shuffled are hits only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from usagelens.llm.common import lower_ascii, text_of
from usagelens.session import materialise

K, GAP, COVER = 3, 3, 0.8
MOST_RUNS, MOST_WORDS = 100_000, 60
BREAKS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


@dataclass(frozen=True)
class Template:
    words: str
    label: str
    base: bool = False


#: Fixed by contract: phrases whose places are counted.
BASE = (Template("under the mit license", "mit", True), Template("apache license version 2", "apache-2", True),
        Template("cc by nc", "cc-by-nc", True))
#: Openings of well-known license notices, and short names; labels of the method itself.
NOTICES = (
    Template("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    Template("the software is provided as is without warranty of any kind express or implied", "mit"),
    Template("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2"),
    Template("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    Template("licensed under the gnu general public license", "gpl"),
    Template("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    Template("under the terms of the gnu lesser general public license", "lgpl"),
    Template("this source code form is subject to the terms of the mozilla public license", "mpl"),
    Template("creative commons attribution noncommercial", "cc-by-nc"),
    Template("creative commons attribution sharealike", "cc-by-sa"),
    Template("licensed under cc by sa", "cc-by-sa"),
    Template("all rights reserved", "reserved"),
)


def words_of(text: Column) -> Column:
    """Words of ASCII letters, digits and any other character beyond ASCII, A-Z lower-cased."""
    return F.array_remove(F.split(lower_ascii(text_of(text)), BREAKS), "")


def _runs(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """(t, label, base, runs, at, _run, _hash): every run of K words of the templates, which are literals of the query."""
    sizes = [len(t.words.split()) for t in templates]
    for t, n in zip(templates, sizes):
        if not K <= n <= MOST_WORDS:
            raise ValueError(f"a template needs {K} to {MOST_WORDS} words: {t.words}")
    if not templates or sum(n - K + 1 for n in sizes) > MOST_RUNS:
        raise ValueError(f"between 1 and {MOST_RUNS} template runs are needed")
    listed = [F.struct(F.lit(n).alias("t"), F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), F.lit(" ".join(t.words.split())).alias("words"))
              for n, t in enumerate(templates)]
    rows = spark.range(1).select(F.inline(F.array(*listed))).withColumn("w", F.split("words", " "))
    runs = F.transform(F.sequence(F.lit(0), F.size("w") - K), lambda i: F.slice("w", i + 1, K))
    rows = rows.select("t", "label", "base", (F.size("w") - K + 1).alias("runs"), F.posexplode(runs).alias("at", "_run"))
    return rows.withColumn("_hash", F.xxhash64(*[F.col("_run")[i] for i in range(K)]))


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_of(F.col(text_col))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("_text"), words_of(F.col(text_col)).alias("_words"))


def votes(docs: DataFrame, templates: tuple[Template, ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, _text, t, label, base, runs, diagonal, offsets): offsets has one bit per run found on the diagonal."""
    runs = _runs(docs.sparkSession, templates)
    known = [r["_hash"] for r in runs.select("_hash").distinct().collect()]  # of the templates, at most MOST_RUNS
    n, w = F.size("_words"), F.col("_words")
    rolled = F.transform(F.sequence(F.lit(0), n - K), lambda i: F.struct(i.alias("at"), F.xxhash64(*[F.get(w, i + j) for j in range(K)]).alias("own")))
    # Only runs whose hash a template has leave the text, each with its own words, so that a text is copied once however long it is.
    met = F.transform(F.filter(rolled, lambda r: r["own"].isin(known)), lambda r: F.struct(
        r["at"].alias("_at"), r["own"].alias("_own"), F.slice(w, r["at"] + 1, K).alias("_got")))
    places = _source(docs, id_col, text_col).filter(n >= K).select("doc_id", "_text", F.inline(met))
    hits = places.join(F.broadcast(runs), (F.col("_own") == F.col("_hash")) & (F.col("_got") == F.col("_run")))
    return hits.groupBy("doc_id", "_text", "t", "label", "base", "runs", (F.col("_at") - F.col("at")).alias("diagonal")).agg(
        F.bit_or(F.expr("shiftleft(1L, at)")).alias("offsets"))


def spans(voted: DataFrame, gap: int = GAP, cover: float = COVER) -> DataFrame:
    """Verified spans: neighbouring diagonals merged, `coverage` of the template's runs at least `cover`."""
    order = Window.partitionBy("doc_id", "_text", "t").orderBy("diagonal")
    opens = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > gap).cast("int"), F.lit(1))
    band = voted.withColumn("_opens", opens).withColumn("_band", F.sum("_opens").over(order))
    merged = band.groupBy("doc_id", "_text", "t", "label", "_band").agg(
        (F.bit_count(F.expr("bit_or(offsets)")) / F.first("runs")).alias("coverage"), F.min("diagonal").alias("start"), F.max("diagonal").alias("last"))
    return merged.filter(F.col("coverage") >= cover).drop("_band")


def scan(docs: DataFrame, templates: tuple[Template, ...] = BASE + NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts every place where a base template stands word by word;
    first_word and last_word are the smallest and largest of their first words
    (from 0). labels adds those of verified spans; score is the largest coverage
    of a span, 1 for an exact occurrence, 0 without any. Null and empty texts
    have no words and no labels. Repeated rows get equal results, each of its own.
    """
    voted = materialise(votes(docs, templates, id_col, text_col), "license-votes")  # hits only; read by both ways below
    exact = F.col("base") & (F.bit_count("offsets") == F.col("runs"))
    places = voted.filter(exact).select("doc_id", "_text", "label", F.col("diagonal").alias("start"), F.lit(1.0).alias("coverage"), F.lit(True).alias("base"))
    found = places.unionByName(spans(voted).select("doc_id", "_text", "label", "start", "coverage", F.lit(False).alias("base")))
    sorted_labels = lambda when: F.concat_ws(",", F.array_sort(F.collect_set(when)))
    facts = found.groupBy(F.col("doc_id").alias("_id"), F.col("_text").alias("_of")).agg(
        F.count_if("base").alias("n_base"), F.min(F.when(F.col("base"), F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start"))).cast("long").alias("last_word"),
        sorted_labels(F.when(F.col("base"), F.col("label"))).alias("base_labels"), sorted_labels(F.col("label")).alias("labels"), F.max("coverage").alias("score"))
    counted = _source(docs, id_col, text_col).select("doc_id", "_text", F.size("_words").cast("long").alias("n_words"))
    joined = counted.join(facts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_of")), "left")
    return joined.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
                         F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
                         F.coalesce("score", F.lit(0.0)).alias("score"))
