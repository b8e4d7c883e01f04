import os
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from usagelens.operators.keyed_log import KeyedLog

SCHEMA = "id string, part int, v string"


def some(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def log(spark, path, buckets=16):
    return KeyedLog(spark, str(path), SCHEMA, ("id", "part"), ("id",), buckets)


def content(table):
    return sorted(map(tuple, table.read().collect()), key=repr)


def test_rows_come_once(spark, tmp_path):
    table = log(spark, tmp_path / "t")
    assert content(table) == [] and table.near(some(spark, ("a", 1, "x"))).count() == 0
    table.append_new(some(spark))
    assert content(table) == []
    table.append_new(some(spark, ("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), ("b", 1, "z"), (None, None, None)))
    table.append_new(some(spark, ("a", 1, "other"), ("c", 1, "n"), (None, None, "again"), (None, 1, "m")))
    want = sorted([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), ("c", 1, "n"), (None, None, None), (None, 1, "m")], key=repr)
    assert content(table) == want
    extra = some(spark, ("d", 1, "e")).withColumnRenamed("v", "_stored_id").withColumn("bucket_of_16", F.lit(99))
    table.append_new(extra)  # names like the helper columns; an absent column is null
    assert content(table) == sorted([*want, ("d", 1, None)], key=repr)
    before = content(table)
    table.compact()
    assert content(table) == before and log(spark, tmp_path / "t").near(some(spark, ("c", 1, ""))).filter("id = 'c'").count() == 1
    with pytest.raises(ValueError):
        log(spark, tmp_path / "t", 8).append_new(some(spark, ("e", 1, "x")))
    assert table.wipe() == len(before) and content(table) == []
    table.append_new(some(spark, ("a", 1, "new")))
    assert content(table) == [("a", 1, "new")]


def test_a_lost_writer_is_made_good(spark, tmp_path):
    table, rows = log(spark, tmp_path / "t"), some(spark, *[(f"k{i}", 1, "v") for i in range(50)])
    table.append_new(rows)
    lost = [f for f in (tmp_path / "t").rglob("*.parquet")][::2]
    for f in lost:
        f.rename(tmp_path / f.name)  # as if the first attempt had brought half of its files
    assert table.read().count() < 50
    table.append_new(rows)
    assert content(table) == sorted((f"k{i}", 1, "v") for i in range(50))


def test_a_batch_reads_its_own_buckets(spark, tmp_path):
    table, batch = log(spark, tmp_path / "t", 32), some(spark, ("7", 1, "new"))
    size = lambda: sum(os.path.getsize(urlparse(f).path) for f in table.near(batch).inputFiles())
    history = spark.range(20_000).selectExpr("CAST(id AS STRING) AS id", "0 AS part", "uuid() AS v")
    table.append_new(history)
    files = table.near(batch).inputFiles()
    assert len({f.split("bucket_of_32=")[1].split("/")[0] for f in files}) == 1
    whole = sum(f.stat().st_size for f in (tmp_path / "t").rglob("*.parquet"))
    before = size()
    assert before < whole / 20
    own = table.near(batch).first()["id"]
    bucket = F.expr("pmod(xxhash64(id), 32)")
    mine = some(spark, (own, 0, "")).select(bucket).first()[0]
    table.append_new(spark.range(20_000, 90_000).selectExpr("CAST(id AS STRING) AS id", "0 AS part", "uuid() AS v").filter(bucket != mine))
    assert size() == before and table.read().count() > 80_000
