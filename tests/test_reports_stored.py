"""Daily sketches and analyzers that SQL calls."""

import datetime as dt
import random

from pyspark.sql import functions as F

from usagelens.operators import verdicts
from usagelens.plans import sketches


def test_sketches_of_batches_count_like_one_of_all(spark):
    rng = random.Random(1)
    rows = [(f"u{rng.randint(0, 4000)}" if n % 50 else None, dt.datetime(2024, 1, 1 + n % 20), f"d{n % 2}") for n in range(20_000)]
    events = spark.createDataFrame(rows, "user string, at timestamp, dep string")
    stored = None
    for n in range(3):
        fresh = sketches.daily_sketches(events.filter(F.pmod(F.xxhash64("user", "at"), F.lit(3)) == n), F.col("at"), ["dep"], ["user"])
        stored = fresh if stored is None else sketches.merged_days(stored, fresh, ["dep"], ["user"])
    whole = sketches.daily_sketches(events, F.col("at"), ["dep"], ["user"])
    for first, last in ((None, None), ("2024-01-03", "2024-01-09"), ("2024-01-15", None), ("2030-01-01", None)):
        got, want = (sorted(map(tuple, sketches.distinct_counts(t, ["dep"], ["user"], first, last).collect())) for t in (stored, whole))
        assert [g[:2] for g in got] == [w[:2] for w in want]
        low, high = dt.datetime.fromisoformat(first or "0001-01-01"), dt.datetime.fromisoformat(last or "9999-12-31")
        for dep, events_, users in got + want:
            exact = {u for u, at, d in rows if d == dep and u and low <= at <= high}
            assert events_ == sum(d == dep and low <= at <= high for _, at, d in rows)
            assert abs(users - len(exact)) <= max(1, 5 * sketches.standard_error() * len(exact))


def test_batch_analyzer_sees_batches_in_order(spark):
    def first_of_batch(messages):
        return [{"chat_id": messages[0]["chat_id"], "detail": ",".join(str(m["chat_id"]) for m in messages), "confidence": 0.5}] if messages[0]["user_text"] else []

    over = verdicts.register_batch_analyzer(spark, "first_of_batch", first_of_batch)
    rows = [(n, n % 5, 100 - n, "x" if n % 5 else None) for n in range(40)] + [(99, None, 1, "alone")]
    messages = spark.createDataFrame(rows, "chat_id long, batch_id long, position long, user_text string").repartition(4)
    got = {r.chat_id: r for r in over(messages).collect()}
    assert {i: r.detail for i, r in got.items()} == {**{35 + b: ",".join(str(n) for n in range(35 + b, -1, -5)) for b in range(1, 5)}, 99: "99"}
    assert {(r.analyzer, r.severity, r.confidence) for r in got.values()} == {("first_of_batch", None, 0.5)}
    messages.createOrReplaceTempView("some_messages")
    by_sql = spark.sql("SELECT m.user_text, f.detail FROM first_of_batch(TABLE(some_messages) PARTITION BY batch_id ORDER BY position) f JOIN some_messages m USING (chat_id)")
    assert by_sql.count() == 5 and over(messages.limit(0)).collect() == []
    assert verdicts.run_analyzers(messages, ["first_of_batch"]).count() == 5


def test_entry_without_the_text_operators():
    import __spark_entry__ as entry

    assert entry.imported("usagelens.no_such_module") is None and entry.imported("json") is not None
