"""Comparison by digests beside the full one."""

from usagelens.operators import rows


def test_changes_equal_the_full_comparison(spark):
    kind = "k int, part string, v string, n double"
    a = spark.createDataFrame([(i, "x", f"v{i}", float(i)) for i in range(3000)] + [(1, None, "null part", None)], kind)
    b = spark.createDataFrame([(i, "x", f"v{i}" if i % 500 else None if i else "v0", float(i)) for i in range(10, 3010)] + [(1, None, None, None)], kind)
    whole = rows.compare_rows(a, b, ["k", "part"]).filter("status <> 'same'")
    got = rows.compare_changes(a, b, ["k", "part"])
    assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect())) and got.count() == 27
    left, right = rows.differing_rows(a, b, ["k", "part"])
    assert left.count() < 60 and right.count() < 60  # of 3,000
    assert rows.compare_changes(a, a, ["k", "part"]).collect() == [] and rows.compare_changes(a.limit(0), a.limit(0), ["k", "part"]).collect() == []


def test_nulls_that_change_places_and_repeated_rows(spark):
    a = spark.createDataFrame([(1, None, "x"), (2, "y", "y"), (2, "y", "y")], "k int, v string, w string")
    b = spark.createDataFrame([(1, "x", None), (2, "y", "y")], "k int, v string, w string")
    left, right = rows.differing_rows(a, b, ["k"])
    assert (left.count(), right.count()) == (3, 2)
    assert [tuple(r) for r in rows.compare_changes(a, b, ["k"]).collect()] == [(1, "changed", ["v", "w"])]
