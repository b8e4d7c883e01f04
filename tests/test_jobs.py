import json

import pytest
from pyspark.sql import functions as F

from usagelens import schemas
from usagelens.operators import compliance, graph, rows, tables, vectors, verdicts
from usagelens.plans import security, usage as u
from usagelens.plans.jobs import Store, analysis_cycle, refresh_detector_views
from usagelens.streaming import streams


def as_of():
    return F.lit("2026-01-01 00:00:00").cast("timestamp")


def usage(spark):
    base = []
    for day in range(1, 8):
        base.append((f"a{day}", "u1-hash", "dept-a", "CodeAssist", "gpt-4o", f"2026-01-0{day} 09:00:00", 400,
                     100.0 if day == 7 else 1.0, "What is the weather", "eu"))
        base.append((f"b{day}", "u2-hash", "dept-b", "DocAnalyzer", "mistral-large", f"2026-01-0{day} 10:00:00", 0, 2.0, "", None))
    base.append(("c1", "u3-hash", "dept-c", "DocAnalyzer", "odd-model", "2026-01-01 11:00:00", 700, 3.0, "Travel loan", "us"))
    return spark.createDataFrame(base, "id string, user_id_hash string, department_id string, tool_name string, model_name string, "
                                 "usage_start string, token_count long, cost double, purpose string, region string").withColumns({
                                     "usage_start": F.col("usage_start").cast("timestamp"),
                                     "usage_end": F.col("usage_start").cast("timestamp") + F.expr("INTERVAL 5 MINUTES")})


def test_usage_reports(spark):
    frame = usage(spark)
    alert = u.anomalies(frame).collect()
    assert [(a["department"], a["z_score"], a["observed_value"], a["severity"]) for a in alert] == [("dept-a", 2.45, 100.0, "high")]
    cost = {r["key"]: r for r in u.cost_analytics(frame).collect()}
    assert cost["dept-a"]["trivial_percentage"] == 100.0 and cost["dept-c"]["private_percentage"] == 100.0
    assert cost["dept-b"]["cost_per_token"] == 14.0
    checks = {r["check"]: r["percentage"] for r in u.compliance_checks(frame).collect()}
    assert checks == {"purpose_logged": 53, "region_logged": 53, "model_name_logged": 100, "department_attributed": 100,
                      "user_pseudonymized": 100}
    assert tuple(u.compliance_overall(frame).first()) == (81, "compliant")
    assert u.legislation_score(frame).first()["score"] == 81
    assert tuple(u.compliance_overall(frame.limit(0)).first()) == (0, "non_compliant")
    flow = {r["provider"]: r["event_count"] for r in u.provider_flow(frame).collect()}
    assert flow == {"OpenAI": 7, "Mistral": 7, "Unknown": 1}
    assert [r["id"] for r in u.non_eu_transfers(frame).collect()] == ["c1"]
    assert u.code_index_risks(frame).count() == 7


def test_upserts(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id int, v string, at int")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "id int, v string, at int")
    once = tables.upsert(old, new, ["id"], ["at"], keep_first=("at",))
    assert sorted(map(tuple, once.collect())) == [(1, "a", 0), (2, "y", 0), (3, "z", 1)]
    assert sorted(map(tuple, tables.upsert(once, new, ["id"], ["at"], keep_first=("at",)).collect())) == sorted(map(tuple, once.collect()))

    table = tables.VersionedTable(spark, str(tmp_path / "t"), "id int, v string, at int")
    assert table.read().count() == 0
    table.upsert(new, ["id"], ["at"])
    assert sorted(map(tuple, table.read().collect())) == [(2, "y", 2), (3, "z", 1)]
    assert table.append_new(new, ["id"]) == 2 and table.read().count() == 2
    assert table.versions() == [1, 2] and table.wipe() == 2 and table.read().count() == 0
    both = spark.createDataFrame([("k", 1), ("k", 2), ("k", 3), ("l", 1)], "k string, at int")
    assert sorted(map(tuple, tables.keep_last_per_key(both, ["k"], 2, ["at"]).collect())) == [("k", 2), ("k", 3), ("l", 1)]
    fresh = spark.createDataFrame([("t", 5)], "title string, impact_score int")
    stored = spark.createDataFrame([("o", 1, "active"), ("p", 2, "draft")], "title string, impact_score int, status string")
    swapped = {r["title"]: r["status"] for r in tables.swap_recommendations(stored, fresh).collect()}
    assert swapped == {"o": "historical", "p": "draft", "t": "active"}


def test_writes_cost_what_they_bring(spark, tmp_path):
    schema, rows = "id int, v string, at int", lambda *r: spark.createDataFrame(list(r), "id int, v string, at int")
    root = tmp_path / "t"
    table = tables.VersionedTable(spark, str(root), schema, ("id",), ("at",))
    table.write(spark.range(20_000).selectExpr("CAST(id AS INT) AS id", "uuid() AS v", "0 AS at"))
    for turn in range(3):
        table.upsert(rows((1, f"a{turn}", turn), (1, "old", turn - 1), (30_000 + turn, "n", 0)), ["id"], ["at"])
    assert table.append_new(rows((1, "seen", 9), (50_000, "x", 9)), ["id"]) == 5
    size = lambda folder: sum(f.stat().st_size for f in folder.glob("*.parquet"))
    assert size(root / "v=1") > 500_000 and all(size(root / f) < 20_000 for f in ("_put=2", "_put=3", "_put=4", "_new=5"))
    now = {r["id"]: r["v"] for r in table.read().filter("id = 1 OR id >= 20000").collect()}
    assert now == {1: "a2", 30_000: "n", 30_001: "n", 30_002: "n", 50_000: "x"} and table.read().count() == 20_004
    assert table.read(2).filter("id = 1").first()["v"] == "a0"
    with pytest.raises(ValueError):
        tables.VersionedTable(spark, str(root), schema).read()
    with pytest.raises(ValueError):
        table.upsert(rows((1, "b", 1)), ["v"])
    assert table.compact() == 6 and table.versions() == [1, 2, 3, 4, 5, 6] and table.read().count() == 20_004
    assert table.compact() == 7 and table.versions() == [6, 7] and not (root / "v=1").exists()
    (root / "_put=8").mkdir()  # a lost writer
    assert table.read().count() == 20_004 and table.upsert(rows((2, "z", 1)), ["id"], ["at"]) == 8
    assert table.read().filter("id = 2").first()["v"] == "z"


def test_create_tables(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS lens LOCATION '{tmp_path}/lens'")
    assert len(schemas.create_tables(spark, "lens")) == len(schemas.TABLES)
    schemas.create_tables(spark, "lens")
    assert spark.table("lens.chats").columns[0] == "source_file"
    spark.sql("DROP DATABASE lens CASCADE")


CHATS = [("1", "user", "mail a@b.co and postgres://x:y@z/w"), ("2", "user", "clean"), ("3", "model", "c@d.io"), ("4", "user", "e@f.io")]


def chats(spark):
    return spark.createDataFrame(CHATS, "chat_id string, author string, user_text string").withColumns({
        "conversation_key": F.lit("k"), "provider": F.lit("chatgpt"), "model_name": F.lit("gpt-4"),
        "conversation_title": F.lit("t"), "conversation_timestamp": as_of(), "user_text_clean": F.col("user_text")})


def test_cycle_is_idempotent(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    first = analysis_cycle(store, chats(spark), "r1", as_of())
    assert first == {"messages": 3, "findings": 3}
    assert analysis_cycle(store, chats(spark), "r2", as_of()) == {"messages": 0, "findings": 0}
    assert store.log("findings").read().count() == 3
    insight = {r["chat_id"]: (r["risk_score"], r["risk_factors"]) for r in store.log("conversation_insights").read().collect()}
    assert insight == {"1": (60, ["content_leak", "security_leak"]), "4": (20, ["content_leak"])}
    views = refresh_detector_views(store, chats(spark), as_of())
    over = views["overview"].first()
    assert (over["total_messages"], over["total_findings"], over["analyzed_messages"], over["average_risk_score"]) == (4, 3, 2, 40.0)
    refresh_detector_views(store, chats(spark), as_of())
    status = [r["status"] for r in store.table("system_recommendations").read().collect()]
    assert status.count("active") == status.count("historical") > 0


def test_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    event = lambda i, minute, **k: json.dumps({
        "id": i, "user_id_hash": "u", "department_id": "d", "usage_start": f"2026-01-01T10:{minute:02d}:00Z", "cost": 1, **k})
    (folder / "1.jsonl").write_text("\n".join([event("a", 0), event("a", 0), "{bad", event("b", 5), event("c", 50)]) + "\n")
    log = streams.usage_log_stream(spark, str(folder), as_of())
    assert sorted(r["id"] for r in streams.run_available(log, "t").collect()) == ["a", "a", "b", "c"]
    out = streams.run_available(streams.distinct_events(streams.usage_log_stream(spark, str(folder), as_of())), "t")
    assert sorted(r["id"] for r in out.collect()) == ["a", "b", "c"]
    sessions = streams.usage_sessions(streams.usage_log_stream(spark, str(folder), as_of()), "10 minutes", "1 minute")
    assert [(r["events"], str(r["session_start"])) for r in streams.run_available(sessions, "t").collect()] == [(3, "2026-01-01 10:00:00")]
    table = tables.VersionedTable(spark, str(tmp_path / "sum"), "department_id string, n long", ("department_id",))
    counts = streams.usage_log_stream(spark, str(folder), as_of()).groupBy("department_id").agg(F.count("*").alias("n"))
    for text in (None, event("d", 55)):
        if text:
            (folder / "2.jsonl").write_text(text + "\n")
        streams.upsert_sink(counts, table, ["department_id"], str(tmp_path / "ck")).awaitTermination()
    assert [tuple(r) for r in table.read().collect()] == [("d", 5)]
    good = streams.parsed_messages(spark.createDataFrame([('{"x": 1}',), ("nope",)], "value string"), "x INT")
    assert [r["x"] for r in good.collect()] == [1]


def test_record_checks(spark):
    records = spark.createDataFrame([
        ("1", "u-hash", "d", "t", "m", "s", "e", "5", "1.0", "call +49151234567 now"),
        ("2", "Jane Doe", "d", "t", "m", "s", "e", "-1", "abc", "[REDACTED]"),
        ("3", "u", None, "t", "x@y.zz", "s", "e", "200000", "101", "DE44500105175407324931")],
        "id string, user_id_hash string, department_id string, tool_name string, model_name string, usage_start string, "
        "usage_end string, token_count string, cost string, purpose string")
    got = {(r["id"], r["rule"], r["field"]) for r in compliance.record_issues(records).collect()}
    assert got == {("1", "pii_phone_de", "purpose"), ("2", "unhashed_user", "user_id_hash"), ("2", "tokens_negative", "token_count"),
                   ("2", "cost_invalid", "cost"), ("3", "missing_field", "department_id"), ("3", "pii_email", "model_name"),
                   ("3", "tokens_high", "token_count"), ("3", "cost_high", "cost"), ("3", "pii_iban", "purpose"),
                   ("3", "pii_phone_de", "purpose")}
    message = compliance.record_issues(records, F.lit(7)).filter("rule = 'tokens_negative'").first()["message"]
    assert message == "Line 7: token_count is negative (-1)"
    assert tuple(compliance.check_result(compliance.record_issues(records)).first()) == (10, False)


def test_anonymize(spark, tmp_path):
    frame = spark.createDataFrame([("1", "bob", "text", "x")], "id string, username string, purpose string, extra string")
    got = compliance.anonymize(frame).first().asDict()
    assert got["purpose"] == got["extra"] == "[REDACTED]" and got["id"] == "1"
    assert got["user_id_hash"] == "81b637d8fcd2-hash" and "username" not in got
    assert compliance.write_anonymized(frame, str(tmp_path / "out")) == 1


def test_row_operations(spark):
    frame = spark.createDataFrame([("b", "10"), ("a", "9"), ("c", "x"), ("d", None)], "k string, v string")
    out, applied = rows.apply_operations(frame, ["sort:v", "nope", "limit:3"])
    assert [r["k"] for r in out.collect()] == ["a", "b", "d"] and applied == ["sort:v", "limit:3"]
    assert rows.apply_operations(frame, ["filter:k:c"])[0].count() == 1
    assert rows.apply_operations(frame, ["filter:zz:c"])[0].count() == 0
    assert tuple(rows.duplicate_counts(frame.unionAll(frame)).first()) == (4, 4)


def test_a_later_sort_keeps_the_order_of_equals(spark):
    """Keys far above the steps between prices, as in a part table of any size."""
    pairs = [(n * 7919 % 50_000, float(n % 5) / 100) for n in range(500)]
    frame = spark.createDataFrame(pairs, "k long, price double").repartition(7)
    out, applied = rows.apply_operations(frame, ["sort:k", "sort:price", "limit:120"])
    assert list(map(tuple, out.collect())) == sorted(pairs, key=lambda r: (r[1], r[0]))[:120] and applied[1] == "sort:price"



def test_graph_and_verdicts(spark):
    answers = spark.createDataFrame([("doc", '```json\n{"people": ["Ann", "Bob"], "dates": "none"}\n```'), ("bad", "oops")],
                                    "source string, answer string")
    found = graph.parse_entities(answers, "source", "answer")
    assert {tuple(r) for r in graph.edges(found).collect()} == {("doc", "CONTAINS", "People", "Ann"), ("doc", "CONTAINS", "People", "Bob")}
    assert ("Source", "doc") in {tuple(r) for r in graph.nodes(found).collect()}
    batch = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (1, 2, "z")], "batch_id int, position int, chat_id string")
    lists = spark.createDataFrame([(1, '[{"classification": "trivial"}, {"classification": "productive"}]')], "batch_id int, answers string")
    parsed = verdicts.parse_verdicts(verdicts.answers_for_batch(batch, lists), verdicts.TRIVIAL)
    messages = spark.createDataFrame([("x", "t"), ("y", "t")], "chat_id string, user_text string")
    got = verdicts.trivial_findings(parsed, messages).collect()
    assert [(r["chat_id"], r["confidence"], r["severity"]) for r in got] == [("x", 0.8, "low")]
    verdicts.register_analyzer("keywords", lambda m: verdicts.trivial_findings(
        verdicts.parse_verdicts(verdicts.keyword_verdicts(m), verdicts.TRIVIAL), m))
    asked = spark.createDataFrame([("p", "tell me a joke"), ("q", "prove a theorem")], "chat_id string, user_text string")
    assert [r["chat_id"] for r in verdicts.run_analyzers(asked, ["keywords"]).collect()] == ["p"]


def test_feed_and_status(spark):
    feed = spark.createDataFrame([("a", 1), ("b", 2)], "id string, timestamp int")
    arrivals = spark.createDataFrame([("b", 9), ("c", 3)], "id string, timestamp int")
    assert [tuple(r) for r in security.merge_feed(feed, arrivals, 2).collect()] == [("c", 3), ("b", 2)]


def test_nearest(spark):
    table = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(10)], "vec_id int, embedding array<float>")
    asked = spark.createDataFrame([(1, [3.2, 0.0])], "query_id int, query array<float>")
    assert [r["vec_id"] for r in vectors.nearest(asked, table, 3).orderBy("rank").collect()] == [3, 4, 2]
    assert [r["vec_id"] for r in vectors.nearest(asked, table, 1, metric="dot").collect()] == [9]
    many = spark.range(1500).selectExpr("id AS query_id", "array(CAST(id AS DOUBLE) / 150, 0D) AS query")  # two blocks of queries
    got = {r["query_id"]: r["vec_id"] for r in vectors.nearest(many, table, 1).collect()}
    assert len(got) == 1500 and got[0] == 0 and got[760] == 5 and got[1499] == 9
    assert vectors.nearest(many.limit(0), table, 1).count() == 0
