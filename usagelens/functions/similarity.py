"""Name and text similarity.

Edit distances over candidate pairs run as vectorised Arrow functions: the
dynamic programme walks the character grid once per batch, for all pairs of
the batch at the same time.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.session import once

# The Arrow functions below travel to the workers by value, so that workers need
# no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def tokenize(name: Column) -> Column:
    """Lower-case word parts of a package name."""
    return F.filter(F.split(F.lower(name), r"(?U)[-_.\s\x1c-\x1f]+"), lambda t: t != "")


def osa_batch(left: list[str], right: list[str]) -> np.ndarray:
    """Optimal-string-alignment distance of each (left[i], right[i]).

    Insertions, deletions, substitutions and swaps of neighbours cost 1; no
    further edit may touch a swapped pair.
    """
    if not left:
        return np.zeros(0, dtype=np.int32)
    a, len_a = _code_points(left)
    b, len_b = _code_points(right)
    rows, width = a.shape[1], b.shape[1]
    count = len(left)
    before = None
    last = np.broadcast_to(np.arange(width + 1, dtype=np.int32), (count, width + 1)).copy()
    result = np.where(len_a == 0, len_b, 0).astype(np.int32)
    for i in range(1, rows + 1):
        current = np.empty_like(last)
        current[:, 0] = i
        for j in range(1, width + 1):
            cost = (a[:, i - 1] != b[:, j - 1]).astype(np.int32)
            best = np.minimum(np.minimum(last[:, j], current[:, j - 1]) + 1, last[:, j - 1] + cost)
            if i > 1 and j > 1:
                swapped = (a[:, i - 1] == b[:, j - 2]) & (a[:, i - 2] == b[:, j - 1])
                best = np.where(swapped, np.minimum(best, before[:, j - 2] + cost), best)
            current[:, j] = best
        done = len_a == i
        if done.any():
            result[done] = current[done, len_b[done]]
        before, last = last, current
    return result


def _code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter((len(w) for w in words), dtype=np.int32, count=len(words))
    width = max(1, int(lengths.max()))
    grid = np.array([w.ljust(width, "\0") for w in words], dtype=f"<U{width}")
    return grid.view(np.uint32).reshape(len(words), width), lengths


def osa_distance():
    """Arrow function (string, string) -> int: optimal-string-alignment distance."""

    @F.pandas_udf("int")
    def osa(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(osa_batch(a.tolist(), b.tolist()), dtype="int32")

    return osa


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether the alignment distance is at most 1, with built-in functions only.

    That is a plain distance of at most 1, or one swap of neighbours: a plain
    distance of 2 between equally long texts.
    """
    swapped = F.exists(
        F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))),
        lambda i: F.concat(F.substring(a, 1, i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)),
                           F.substring(a, i + 2, F.length(a))) == b)
    plain = F.levenshtein(a, b, 2)
    return F.when(F.abs(F.length(a) - F.length(b)) > 1, False).when(plain.isin(0, 1), True).otherwise(
        (plain == 2) & (F.length(a) == F.length(b)) & swapped)


def with_fuzzy_jaccard(pairs: DataFrame, tokens_a: str, tokens_b: str, name: str = "jaccard") -> DataFrame:
    """Add the fuzzy Jaccard of two token arrays: tokens match within one edit.

    The intersection is the mean of both directions. The two counts come out of
    a generator, so that they are worked out once per pair however often the
    similarity is used afterwards.
    """
    a, b = F.col(tokens_a), F.col(tokens_b)
    counts = F.struct(
        F.size(F.filter(a, lambda x: F.exists(b, lambda y: within_one_edit(x, y)))).alias("_from_a"),
        F.size(F.filter(b, lambda y: F.exists(a, lambda x: within_one_edit(x, y)))).alias("_from_b"))
    counted = pairs.select("*", F.size(a).alias("_size_a"), F.size(b).alias("_size_b"), F.inline(F.array(counts)))
    hits = (F.col("_from_a") + F.col("_from_b")) / 2.0
    union = F.col("_size_a") + F.col("_size_b") - hits
    empty_a, empty_b = F.col("_size_a") == 0, F.col("_size_b") == 0
    value = (F.when(empty_a & empty_b, 1.0).when(empty_a | empty_b, 0.0).when(union <= 0, 1.0).otherwise(hits / union))
    return counted.withColumn(name, value).drop("_size_a", "_size_b", "_from_a", "_from_b")


def deletion_keys(text: Column, edits: int) -> Column:
    """All strings that up to `edits` character deletions make of `text`.

    Two strings within `edits` alignments share at least one such string: each
    edit, a swap included, is undone by at most one deletion on either side.
    """
    reached = F.array(text)
    frontier = F.array(text)
    for _ in range(edits):
        frontier = F.array_distinct(F.flatten(F.transform(frontier, _without_one_character)))
        reached = F.concat(reached, frontier)
    return F.array_distinct(reached)


def _without_one_character(text: Column) -> Column:
    positions = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(
        F.array().cast("array<int>"))
    return F.transform(
        positions, lambda i: F.concat(F.substring(text, 1, i - 1), F.substring(text, i + 1, F.length(text))))


def char_ngrams(text: Column, n: int) -> Column:
    """Character n-grams in order; a shorter text is one gram by itself."""
    return F.when(F.length(text) < n, F.array(text)).otherwise(
        F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, n)))


def ngram_cosine(pairs: DataFrame, keys: list[str], text_a: str, text_b: str, n: int = 3) -> DataFrame:
    """Cosine of character n-gram counts for each given pair of texts.

    Grams are counted per pair before anything is multiplied, so a pair of long
    texts spreads over the shuffle by (pair, gram); `n = 0` means 3.
    """
    size = n or 3
    long = pairs.select(*keys, F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col(text_a).alias("text")),
        F.struct(F.lit(1).alias("side"), F.col(text_b).alias("text")))).alias("s"))
    # Cut each text into characters once; a gram is then a slice, wherever it lies. Finished grams are exploded, not the text.
    cut = once(long.select(*keys, "s.side", "s.text"), _chars=F.split("text", ""), _n=F.length("text"))
    slices = F.transform(F.sequence(F.lit(1), F.greatest(F.col("_n") - (size - 1), F.lit(1))),
                         lambda i: F.array_join(F.slice("_chars", i, F.lit(size)), ""))
    grams = cut.select(*keys, "side", F.explode(slices).alias("gram"))
    counts = grams.groupBy(*keys, "gram").agg(
        F.count_if(F.col("side") == 0).cast("double").alias("x"),
        F.count_if(F.col("side") == 1).cast("double").alias("y"))
    sums = counts.groupBy(*keys).agg(
        F.sum(F.col("x") * F.col("y")).alias("dot"),
        F.sum(F.col("x") * F.col("x")).alias("xx"),
        F.sum(F.col("y") * F.col("y")).alias("yy"))
    norm = F.sqrt("xx") * F.sqrt("yy")
    return sums.select(*keys, F.when(norm == 0, F.lit(0.0)).otherwise(
        F.round(F.col("dot") / norm, 3)).alias("similarity"))
