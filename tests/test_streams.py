"""Streams whose results hang on state, beside plain loops."""

import datetime as dt
import random

from usagelens.session import materialise, scratch_path
from usagelens.streaming import streams

START = dt.datetime(2024, 5, 1)
SCHEMA = "id string, user_id_hash string, usage_start timestamp"


def run(spark, batches, **options):
    """Each batch lands and the stream runs over it, from its checkpoint."""
    landed, out, checkpoint = (scratch_path(spark, f"limit-{part}") for part in ("landed", "out", "checkpoint"))
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).repartition(2).write.mode("append").parquet(landed)
        judged = streams.limited_requests(spark.readStream.schema(SCHEMA).parquet(landed), **options)
        judged.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return {r.id: r.accepted for r in spark.read.schema(judged.schema).parquet(out).collect()}


def plain(batches, limit, seconds):
    kept, out = {}, {}
    for rows in batches:
        for i, user, at in sorted((r for r in rows if r[2]), key=lambda r: (r[2], r[0])):
            window = [t for t in kept.get(user, []) if (at - t).total_seconds() < seconds]
            out[i] = len(window) < limit
            kept[user] = window + [at] if out[i] else window
    return out


def test_limiter_against_a_loop(spark):
    rng = random.Random(4)
    times = sorted(rng.uniform(0, 900) for _ in range(600))
    rows = [(f"r{n:03d}", rng.choice(["a", "a", "a", "b", None]), START + dt.timedelta(seconds=int(t) if n % 3 else t)) for n, t in enumerate(times)]
    batches = [rows[:200], rows[200:420] + [("none", "a", None)], rows[420:]]
    got, want = run(spark, batches, limit=5, seconds=30), plain(batches, 5, 30)
    assert got == want and 100 < sum(want.values()) < 500


def test_refused_requests_do_not_count_and_the_border_is_open(spark):
    rows = [(str(n), "u", START + dt.timedelta(seconds=s)) for n, s in enumerate((0, 1, 2, 59, 60, 60, 61))]
    assert run(spark, [rows], limit=2, seconds=60) == {"0": True, "1": True, "2": False, "3": False, "4": True, "5": False, "6": True}


def usage(spark):
    rng = random.Random(8)
    rows = [(f"u{rng.randint(0, 9)}-hash", START + dt.timedelta(minutes=rng.randint(0, 3000)), n, 0.5, "d") for n in range(500)]
    frame = spark.createDataFrame(rows, "user_id_hash string, usage_start timestamp, token_count int, cost double, department_id string")
    path = scratch_path(spark, "usage")
    frame.write.parquet(path)
    return spark.readStream.schema(frame.schema).parquet(path), frame


def test_streams_to_their_end(spark):
    """What the stream closes and what the closing step adds make the whole, neither twice."""
    for build, end, width, of in ((streams.daily_usage, "window_end", "1 day", None),
                                  (lambda u: streams.usage_sessions(u, "2 hours"), "session_end", "2 hours", "user_id_hash")):
        stream, rows = usage(spark)
        got = streams.run_to_end(build, stream, rows, "1 hour", end, "whole", width, of)
        whole = materialise(build(rows), "whole")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect())) and got.count() > 2
        closed = streams.run_available(build(stream), "closed").count()
        assert 0 < closed < whole.count()


def test_a_table_is_streamed_from_a_file_and_from_a_folder(spark, folder, tmp_path):
    whole = spark.read.parquet(f"{folder}/documents.parquet")
    whole.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    for place in (folder, str(tmp_path)):
        got = streams.run_available(streams.file_stream(spark, place, "documents.parquet").select("doc_id"), "table")
        assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in whole.collect())
