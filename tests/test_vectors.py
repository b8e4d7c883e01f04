"""Vector lists beside all distances."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from usagelens.operators import vectors
from usagelens.session import scratch_path


def plain(table, queries, k, others_only):
    out = {}
    ids, v = np.array([i for i, _ in table]), np.array([x for _, x in table])
    for q, x in queries:
        d = np.square(v - np.array(x)).sum(axis=1)
        order = [n for n in np.lexsort((ids, d.round(9))) if not (others_only and ids[n] == q)][:k]
        out[q] = [(int(ids[n]), round(float(d[n]), 6)) for n in order]
    return out


def found(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: r["rank"]):
        out.setdefault(r.query_id, []).append((r.vec_id, round(r.distance, 6)))
    return out


@pytest.fixture(scope="module")
def table():
    rng = np.random.RandomState(6)
    spread = rng.randn(12, 5)[rng.randint(0, 12, 700)] * 5 + rng.randn(700, 5) * 0.3
    spread[100:160] = spread[100]  # one hot place
    return [(i, [float(x) for x in row]) for i, row in enumerate(spread)]


@pytest.mark.parametrize("others_only,k", [(True, 4), (False, 1), (False, 90)])
def test_lists_against_all_distances(spark, table, others_only, k, monkeypatch):
    monkeypatch.setattr(vectors, "LIST_PART", 40)
    monkeypatch.setattr(vectors, "QUERY_PART", 30)
    odd = [(9000, None), (9001, [1.0]), (9002, [float("nan")] * 5), (9003, [None] * 5), (None, [0.0] * 5), (9004, []), (9005, [float("inf")] * 5)]
    frame = spark.createDataFrame(table[::2] + odd, "vec_id long, embedding array<double>").repartition(5)
    lists = vectors.VectorLists.build(frame, scratch_path(spark, "lists"), lists=15)
    lists.add(spark.createDataFrame(table + odd, "vec_id long, embedding array<double>"))
    assert lists.members().count() == len(table) == lists.members().select("id").distinct().count()
    asked = [(i, x) for i, x in table[::7]] + [(8000, [50.0] * 5)]
    queries = spark.createDataFrame(asked + odd, "query_id long, query array<double>")
    assert found(lists.nearest(queries, k, others_only=others_only)) == plain(table, asked, k, others_only)


def test_far_lists_are_not_visited(spark, table, monkeypatch):
    frame = spark.createDataFrame(table, "vec_id long, embedding array<double>")
    lists = vectors.VectorLists.build(frame, scratch_path(spark, "lists"), lists=12)
    seen, kept = [], vectors.materialise
    monkeypatch.setattr(vectors, "materialise", lambda df, label: seen.append((label, kept(df, label))) or seen[-1][1])
    got = lists.nearest(frame.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 3)
    assert got.count() == 3 * len(table)
    visits = sum(df.count() for label, df in seen if label == "vector-visits")
    assert len(table) <= visits < 4 * len(table)  # of 12 lists each


def test_lists_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    lists = vectors.VectorLists.build(none, scratch_path(spark, "lists"))
    asked = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, query array<double>")
    assert lists.nearest(asked, 3).collect() == [] and lists.members().count() == 0
    few = vectors.VectorLists.build(spark.createDataFrame([(5, [1.0, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>"), scratch_path(spark, "lists"))
    assert found(few.nearest(asked, 3)) == {1: [(3, 1.0), (5, 1.0)]}


def sphere(n):
    rows = np.random.RandomState(n).randn(n, 24)
    return [(i, [float(x) for x in row]) for i, row in enumerate(rows / np.linalg.norm(rows, axis=1)[:, None])]


def test_what_moves_grows_with_the_table_only(spark, monkeypatch):
    """Vectors that no bound keeps apart: each query meets all members, but goes to a shelf once."""
    table = sphere(600)
    frame = spark.createDataFrame(table, "vec_id long, embedding array<double>")
    lists = vectors.VectorLists.build(frame, scratch_path(spark, "lists"), lists=32)
    seen, kept = [], vectors.materialise
    monkeypatch.setattr(vectors, "materialise", lambda df, label: seen.append((label, kept(df, label))) or seen[-1][1])
    queries = frame.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    assert found(lists.nearest(queries, 5, others_only=True)) == plain(table, table, 5, True)
    assert sum(df.count() for label, df in seen if label == "vector-visits") <= vectors.SHELVES * len(table)


def test_shelves_and_parts_stay_while_tables_grow():
    for n in (10_000, 100_000, 600_000):
        first, parts = vectors.shelves(np.full(32, n // 32))
        assert parts.tolist() == [1] * 32 and np.bincount(first).tolist() == [4] * 8
        assert vectors.query_parts(n) == vectors.SHELVES
    first, parts = vectors.shelves(np.array([0, 10, 500_000, 0, 499_990]))  # long lists are dealt over shelves
    assert parts.tolist() == [1, 1, 4, 1, 4] and (first + parts).max() <= 9
    assert vectors.query_parts(0) == 0 and vectors.query_parts(1) == 1
    for n in (10**7, 10**8):  # beyond that, what a task holds stays
        first, parts = vectors.shelves(np.full(32, n // 32))
        dealt = np.zeros((first + parts).max())
        for at, of in zip(first, parts):
            dealt[at:at + of] += n // 32 / of
        assert dealt.max() <= 2 * vectors.LIST_PART and n / vectors.query_parts(n) <= vectors.LIST_PART


def test_many_copies_of_one_vector(spark):
    """Copies beyond the k smallest ids never meet a query."""
    table = [(i, [0.5] * 8) for i in range(2_000)] + [(5_000 + i, [float(x) for x in row]) for i, row in enumerate(np.random.RandomState(1).randn(60, 8))]
    frame = spark.createDataFrame(table, "vec_id long, embedding array<double>")
    lists = vectors.VectorLists.build(frame, scratch_path(spark, "lists"), lists=6)
    queries = [table[1_500], table[3], table[2_005]]
    asked = spark.createDataFrame(queries, "query_id long, query array<double>")
    assert found(lists.nearest(asked, 3, others_only=True)) == plain(table, queries, 3, True)
    kept = vectors._few_copies(pa.table({"list": pa.array([0] * 9, pa.int32()), "id": [8, 7, 6, 5, 4, 3, 2, 1, 0], "v": [[1.0]] * 8 + [[2.0]], "away": [0.0] * 9}), 3)
    assert sorted(kept.column("id").to_pylist()) == [0, 1, 2, 3]
