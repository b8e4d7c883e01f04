import json
import os
import time

import pytest

from usagelens.sources import chat_exports
from usagelens.sources.export_source import ExportFile, register, shares
from usagelens.sources.files import whole_files


def put(folder, name, *texts, age=10):
    file = folder / name
    file.write_text(json.dumps({"title": name, "author": "ChatGPT", "url": f"https://x/{name}", "date": 1700000000000,
                                "messages": [{"author": "user", "content": t} for t in texts]}))
    os.utime(file, (time.time() - age,) * 2)


def test_shares():
    files = [ExportFile(p, n, 0) for p, n in (("c", 5), ("a", 3), ("b", 4), ("d", 50), ("e", 1))]
    assert [s.paths for s in shares(files, 7)] == [("a", "b"), ("c",), ("d",), ("e",)] and shares([], 7) == []


def test_rows_equal_those_of_whole_files(spark, tmp_path):
    register(spark)
    for i in range(9):
        put(tmp_path, f"chatgpt_{i} é+%.json", f"hello {i}", "", "mail a@b.example")
    (tmp_path / "other.txt").write_text("{}")
    (tmp_path / "_hidden.json").write_text("{}")
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "broken.json").write_bytes(b'{"messages": [\xff')
    files = spark.read.format("chat_exports").option("taskBytes", 400).load(str(tmp_path))
    assert files.rdd.getNumPartitions() > 3
    got, want = (chat_exports.standard_export(f).collect() for f in (files, whole_files(spark, str(tmp_path), "*.json")))
    assert len(got) == 18 and sorted(got, key=str) == sorted(want, key=str)


def test_folders(spark, tmp_path):
    register(spark)
    source = spark.read.format("chat_exports")
    assert source.load(str(tmp_path)).count() == 0
    (tmp_path / "in").mkdir()
    put(tmp_path / "in", "a.json", "x")
    assert source.load(str(tmp_path)).count() == 0
    assert source.option("recursive", "true").load(f"file://{tmp_path}").count() == 1
    with pytest.raises(Exception, match="needs a path"):
        spark.read.format("chat_exports").load().count()


def test_stream(spark, tmp_path):
    """New files come once each, also over a restart; a file that is just being written waits."""
    register(spark)
    folder = tmp_path / "in"
    folder.mkdir()

    def cycle():
        files = spark.readStream.format("chat_exports").option("settle", 5).load(str(folder))
        stream = chat_exports.standard_export(files).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        stream.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r["user_text"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    put(folder, "b.json", "one", age=60)
    put(folder, "c.json", "two", age=50)
    put(folder, "d.json", "late", age=-100)
    assert cycle() == ["one", "two"]
    assert cycle() == ["one", "two"]
    put(folder, "a.json", "three", age=40)
    os.utime(folder / "d.json", (time.time() - 30,) * 2)
    assert cycle() == ["late", "one", "three", "two"]
