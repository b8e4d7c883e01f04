"""Stored tables, runs, analyzer plug-ins and small look-ups over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from usagelens import schemas
from usagelens.catalog import projections as p
from usagelens.catalog import security_queries  # noqa: F401  (its statements are used again)
from usagelens.catalog.oracle_parts import CHATS, FINDINGS, MATCHES, USAGE
from usagelens.catalog.registry import ORACLES, query
from usagelens.config import RuleConfig
from usagelens.operators import packages, tables, vectors, verdicts
from usagelens.operators.rules import build_all_rules
from usagelens.plans import security
from usagelens.plans.jobs import Store, analysis_cycle, ensure_rule_scan, refresh_detector_views
from usagelens.plans.view_states import ViewStates
from usagelens.session import materialise, scratch_path
from usagelens.sources import generic
from usagelens.streaming import streams

_F = f"WITH {FINDINGS} "
_C = f"WITH {CHATS} "


def _as_of():
    return F.lit(p.AS_OF).cast("timestamp")


def _store(spark, label):
    return Store(spark, scratch_path(spark, label))


@query("scan_messages_in_order", _C + """SELECT conversation_key, message_id, conversation_title, provider, model_name, author,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS message_timestamp, user_text_clean FROM chats""")
def scan_messages_in_order(spark, folder):
    return generic.ordered_messages(p.chat_context(spark, folder)).select(
        "conversation_key", "message_id", "conversation_title", "provider", "model_name", "author", "message_timestamp", "user_text_clean")


@query("rule_scan_run", f"WITH {MATCHES} " + """SELECT 'run-1' AS id, 'completed' AS status, (SELECT count(*) FROM chats) AS source_message_count,
  (SELECT count(*) FROM rules) AS rule_count, (SELECT count(*) FROM matches) AS match_count,
  (SELECT count(DISTINCT conversation_key) FROM matches) AS summaries, true AS ran_once""")
def rule_scan_run(spark, folder):
    """A full rule scan into stored tables; a second call finds the completed run and does nothing."""
    store, chats = _store(spark, "rule-run"), p.chat_context(spark, folder)
    ensure_rule_scan(store, chats, p.rules(spark, folder), p.RUN_ID, _as_of(), rule_config=p.COMPANY_RULES)
    again = ensure_rule_scan(store, chats, p.rules(spark, folder), "run-2", _as_of(), rule_config=p.COMPANY_RULES)
    runs = store.table("analysis_runs").read()
    summaries = store.table("conversation_summaries").read().agg(F.count("*").alias("n")).scalar()
    return runs.select("id", "status", "source_message_count", "rule_count", "match_count", summaries.alias("summaries"), F.lit(again is None).alias("ran_once"))


@query("stored_rules", """SELECT 'customers:' || c_custkey || ':company_name' AS rule_id, CASE WHEN c_custkey % 2 = 0 THEN c_name || ' AG' ELSE c_name END AS value,
  'high' AS severity FROM customer""")
def stored_rules(spark, folder):
    """Company rules upserted twice by id; half of the companies have a new name the second time."""
    config = RuleConfig(table_fields={"customers": {"company_name": "high"}})
    table = _store(spark, "stored-rules").table("company_rules")
    for name in ("c_name", "if(c_custkey % 2 = 0, concat(c_name, ' AG'), c_name)"):
        rows = p.table(spark, folder, "customer").selectExpr("CAST(c_custkey AS STRING) AS id", f"{name} AS company_name")
        made = build_all_rules({"customers": rows}, config)
        names = [f.split(" ")[0] for f in schemas.RULES.split(", ")]
        table.upsert(made.select(*[c for c in names if c in made.columns]), ["rule_id"])
    return table.read().select("rule_id", "value", "severity")


@query("configured_rules", """SELECT 'customers:' || c_custkey || ':company_name' AS rule_id, 'pii' AS category, 'low' AS severity FROM customer
  UNION ALL SELECT 'customers:' || c_custkey || ':segment', 'secret', 'critical' FROM customer""")
def configured_rules(spark, folder):
    """Rules whose classification comes from a configuration document."""
    config = RuleConfig.from_mapping({
        "category_rules": {"by_table": {"customers": "secret"}, "by_field": {"company_name": "pii"}},
        "severity_rules": {"by_table_field": {"customers": {"company_name": "low", "segment": "low"}}, "by_field": {"segment": "critical"}, "default": "high"}})
    made = build_all_rules({"customers": p.company_tables(spark, folder)["customers"]}, config)
    return made.select("rule_id", "category", "severity")


@query("package_seed", """SELECT p_partkey % 3 || '-' || lower(p_brand) AS name, 'pypi' AS ecosystem, CAST(max(p_size) + 100 AS BIGINT) AS downloads,
  max(p_partkey) AS dependent_packages_count FROM part GROUP BY 1""")
def package_seed(spark, folder):
    """Registry items seeded twice by (ecosystem, name): the second delivery wins, counts default to 0."""
    items = p.table(spark, folder, "part").selectExpr("concat(p_partkey % 3, '-', lower(p_brand)) AS name", "p_size", "p_partkey").groupBy("name").agg(
        F.max("p_size").alias("downloads"), F.max("p_partkey").alias("dependent_packages_count")).withColumns(
        {"description": F.lit("d"), "repository_url": F.lit(None).cast("string")})
    table = _store(spark, "seed").table("popular_packages")
    for more in (0, 100):
        made = packages.from_registry_feed(items.withColumn("downloads", F.col("downloads") + more), "pypi")
        table.upsert(made, ["ecosystem", "name"])
    return table.read().select("name", "ecosystem", "downloads", "dependent_packages_count")


@query("registry_feed", """SELECT p_name || p_partkey AS name, 'npm' AS ecosystem, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS BIGINT) ELSE 0 END AS downloads,
  0 AS dependent_packages_count, repeat(p_type, 60)[:500] AS description FROM part WHERE p_partkey % 5 <> 0""")
def registry_feed(spark, folder):
    """Landed registry items: nameless ones go, missing counts are 0; the listing cuts descriptions to 500."""
    items = p.table(spark, folder, "part").selectExpr(
        "if(p_partkey % 5 = 0, '', concat(p_name, p_partkey)) AS name", "if(p_partkey % 2 = 0, p_size, NULL) AS downloads",
        "CAST(NULL AS INT) AS dependent_packages_count", "repeat(p_type, 60) AS description", "CAST(NULL AS STRING) AS repository_url")
    return packages.listed(packages.from_registry_feed(items, "npm")).drop("repository_url")


@query("seeded_company_rows", """SELECT CAST(c_custkey AS VARCHAR) AS id, c_name || CASE WHEN c_custkey % 3 = 0 THEN '!' ELSE '' END AS company_name FROM customer""")
def seeded_company_rows(spark, folder):
    """Seed rows upserted over stored ones by id."""
    stored = p.table(spark, folder, "customer").selectExpr("CAST(c_custkey AS STRING) AS id", "c_name AS company_name")
    seed = stored.filter("CAST(id AS BIGINT) % 3 = 0").withColumn("company_name", F.concat("company_name", F.lit("!")))
    return tables.upsert(stored.filter("CAST(id AS BIGINT) % 2 = 1"), seed.unionByName(stored.filter("CAST(id AS BIGINT) % 2 = 0 AND CAST(id AS BIGINT) % 3 <> 0")), ["id"])


@query("refreshed_views", _F + """SELECT (SELECT count(*) FROM chats) AS total_messages, (SELECT count(*) FROM findings JOIN chats USING (chat_id) WHERE author = 'user') AS findings,
  (SELECT count(DISTINCT chat_id) FROM findings JOIN chats USING (chat_id) WHERE author = 'user') AS insights""")
def refreshed_views(spark, folder):
    """A cycle over all messages, then every view written and read back."""
    store = _store(spark, "views")
    analysis_cycle(store, p.message_columns(p.table(spark, folder, "documents")), "cycle", _as_of())
    views = refresh_detector_views(store, p.chat_context(spark, folder), _as_of())
    count = lambda name: store.log(name).read().agg(F.count("*").alias("n")).scalar()
    return views["overview"].select("total_messages", count("findings").alias("findings"), count("conversation_insights").alias("insights"))


def _view_by_batches(spark, folder, name):
    """A view from the states of three batches that overlap, the last of them delivered twice; older ones are added up before it."""
    states = ViewStates(_store(spark, "states"))
    chats, found, scored = p.chat_context(spark, folder), p.scored_findings(spark, folder), p.insight_rows(spark, folder)
    found, scored = materialise(found, "states-findings"), materialise(scored, "states-insights")
    for batch in (0, 1, 2, 2):
        part = F.col("chat_id") % 4
        states.add(batch, chats.filter((part == batch) | (part == batch + 1)), found, scored)
        if batch == 1:
            states.compact()
    return states.views()[name]


@query("overview_by_batches", ORACLES["overview"])
def overview_by_batches(spark, folder):
    return _view_by_batches(spark, folder, "overview")


@query("provider_stats_by_batches", ORACLES["provider_stats"])
def provider_stats_by_batches(spark, folder):
    return _view_by_batches(spark, folder, "provider_stats")


@query("insert_insights", """SELECT doc_id AS chat_id, doc_id % 150 - 20 AS risk_score FROM labels WHERE doc_id % 150 - 20 BETWEEN 0 AND 100""")
def insert_insights(spark, folder):
    """Insights outside 0..100 are refused; stored ones are not added again."""
    made = p.table(spark, folder, "labels").select(F.col("doc_id").alias("chat_id"), (F.col("doc_id") % 150 - 20).alias("risk_score"))
    stored = tables.checked_insights(made.filter("chat_id % 2 = 0"))
    return stored.unionByName(tables.new_rows(stored, tables.checked_insights(made), ["chat_id"]))


@query("wiped_findings", _F + "SELECT count(*) AS before, 0 AS after FROM findings")
def wiped_findings(spark, folder):
    table = _store(spark, "wipe").table("findings", p.findings(spark, folder).schema)
    table.write(p.findings(spark, folder))
    before = table.wipe()
    return table.read().agg(F.count("*").alias("after")).select(F.lit(before).cast("bigint").alias("before"), "after")


@query("json_report", f"WITH {USAGE} SELECT tool_name, count(*) AS events, CAST(sum(token_count) AS BIGINT) AS tokens FROM usage GROUP BY 1")
def json_report(spark, folder):
    """A report written as JSON lines and read back."""
    path = scratch_path(spark, "report")
    tables.write_json_report(p.usage(spark, folder).groupBy("tool_name").agg(F.count("*").alias("events"), F.sum("token_count").alias("tokens")), path)
    return spark.read.schema("tool_name STRING, events BIGINT, tokens BIGINT").json(path)


@query("added_vectors", "SELECT vec_id, label + CASE WHEN vec_id % 2 = 0 THEN 0 ELSE 100 END AS label, embedding[1]::DOUBLE AS first FROM embeddings")
def added_vectors(spark, folder):
    """Vectors whose id is stored stay as they are; the others are added."""
    table = p.table(spark, folder, "embeddings")
    out = vectors.add_vectors(table.filter("vec_id % 2 = 0"), table.withColumn("label", F.col("label") + 100))
    return out.select("vec_id", "label", F.col("embedding")[0].alias("first"))


@query("created_tables", _F + "SELECT analyzer, count(*) AS finding_count FROM findings GROUP BY 1")
def created_tables(spark, folder):
    """All tables created twice under one root, then findings stored in theirs."""
    store = _store(spark, "schema")
    for _ in range(2):
        for name in schemas.TABLES:
            if not store.table(name).versions():
                store.table(name).write(spark.createDataFrame([], schemas.TABLES[name]))
    found = p.findings(spark, folder).withColumn("chat_id", F.col("chat_id").cast("string"))
    empty = store.table("findings").read()
    store.table("findings").append_new(found.select(*[F.col(f.name).cast(f.dataType) for f in empty.schema]), ["finding_id"])
    return store.table("findings").read().groupBy("analyzer").agg(F.count("*").alias("finding_count"))


@query("active_recommendations", """SELECT 'r' || doc_id AS title, quality * 10 + toxic AS impact_score FROM labels WHERE doc_id % 3 = 0""")
def active_recommendations(spark, folder):
    stored = p.table(spark, folder, "labels").selectExpr(
        "concat('r', doc_id) AS title", "CAST(quality * 10 + toxic AS BIGINT) AS impact_score",
        "if(doc_id % 3 = 0, 'active', 'historical') AS status", "TIMESTAMP '2024-01-01' AS created_at")
    return tables.active_recommendations(stored).select("title", "impact_score")


@query("finding_detail", _F + """SELECT finding_id AS id, type, severity, matched_text AS match_value, 1 AS duplicate_count FROM findings
  WHERE finding_id = (SELECT max(finding_id) FROM findings)""")
def finding_detail(spark, folder):
    rows = p.report_rows(spark, folder)
    return security.finding_detail(rows, rows.agg(F.max("id")).first()[0]).select("id", "type", "severity", "match_value", "duplicate_count")


@query("sorted_findings", _F + "SELECT finding_id AS id, severity, type, model FROM report WHERE severity IN ('critical', 'high')")
def sorted_findings(spark, folder):
    rows = p.report_rows(spark, folder).filter(F.col("severity").isin("critical", "high"))
    return security.sort_findings(rows, "severity").select("id", "severity", "type", "model")


@query("analyzer_plugins", """SELECT doc_id AS chat_id, 'llm_trivial' AS analyzer, 'low' AS severity FROM labels WHERE quality = 0
  UNION ALL SELECT doc_id, 'llm_complexity', 'info' FROM labels""")
def analyzer_plugins(spark, folder):
    """Two registered analyzers over the same answers, run by name."""
    answers = p.answers(spark, folder)
    known = p.table(spark, folder, "documents").selectExpr("doc_id AS chat_id", "text AS user_text")
    verdicts.register_analyzer("llm_trivial", lambda a: verdicts.trivial_findings(verdicts.parse_verdicts(a, verdicts.TRIVIAL, "trivial"), known))
    verdicts.register_analyzer("llm_complexity", lambda a: verdicts.complexity_findings(verdicts.parse_verdicts(a, verdicts.COMPLEXITY, "complexity")).withColumn(
        "analyzer", F.lit("llm_complexity")))
    return verdicts.run_analyzers(answers, ["llm_trivial", "llm_complexity"]).select("chat_id", "analyzer", "severity")


@query("batch_analyzer", """WITH m AS (SELECT doc_id, doc_id // 20 AS b, length(text) AS n FROM documents),
  s AS (SELECT *, sum(n) OVER (PARTITION BY b ORDER BY doc_id) AS total FROM m)
  SELECT doc_id AS chat_id, 'context_overflow' AS analyzer, 'context' AS category, CASE WHEN total > 40000 THEN 'high' ELSE 'medium' END AS severity,
    CAST(total AS VARCHAR) AS detail FROM s WHERE total > 20000""")
def batch_analyzer(spark, folder):
    """An analyzer of batches as a table function in SQL: messages at which the running length of their batch passes a limit."""
    def overflow(messages):
        total, out = 0, []
        for m in messages:
            total += len(m["user_text"])
            if total > 20_000:
                out.append({"chat_id": m["chat_id"], "category": "context", "severity": "high" if total > 40_000 else "medium", "detail": str(total)})
        return out

    verdicts.register_batch_analyzer(spark, "context_overflow", overflow)
    messages = p.table(spark, folder, "documents").selectExpr("doc_id AS chat_id", "doc_id DIV 20 AS batch_id", "doc_id AS position", "text AS user_text")
    return verdicts.run_analyzers(messages, ["context_overflow"]).select("chat_id", "analyzer", "category", "severity", "detail")


@query("batch_answers", """WITH b AS (SELECT doc_id, doc_id // 20 AS batch_id, row_number() OVER (PARTITION BY doc_id // 20 ORDER BY doc_id) - 1 AS position, quality FROM labels)
  SELECT doc_id AS chat_id, CASE quality WHEN 0 THEN 'trivial' ELSE 'productive' END AS classification FROM b WHERE position < 15""")
def batch_answers(spark, folder):
    """Positional answers of scored batches: at most fifteen come back per batch, wrapped in a code fence."""
    labels = p.table(spark, folder, "labels").withColumn("batch_id", F.expr("doc_id DIV 20"))
    batch = labels.withColumn("position", (F.row_number().over(Window.partitionBy("batch_id").orderBy("doc_id")) - 1).cast("int"))
    answer = F.struct("position", F.struct(F.when(F.col("quality") == 0, "trivial").otherwise("productive").alias("classification")).alias("a"))
    packed = batch.filter("position < 15").groupBy("batch_id").agg(F.concat(F.lit("```json\n"), F.to_json(F.transform(
        F.array_sort(F.collect_list(answer)), lambda x: x["a"])), F.lit("\n```")).alias("answers"))
    got = verdicts.answers_for_batch(batch.select("batch_id", "position", F.col("doc_id").alias("chat_id")), packed)
    return got.select("chat_id", F.get_json_object("answer", "$.classification").alias("classification"))


@query("event_log_replay", "SELECT event_id AS id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 25")
def event_log_replay(spark, folder):
    """Events appended to a log by a stream; the newest 25 replayed from it."""
    path = scratch_path(spark, "event-log")
    events = streams.file_stream(spark, folder, "events.parquet").selectExpr("event_id AS id", "event_type", "ts")
    streams.append_log(events, path, scratch_path(spark, "event-log-checkpoint")).awaitTermination()
    return tables.keep_last(spark.read.parquet(path), 25, ["ts", "id"]).select("id", "event_type")


@query("recent_points", """SELECT event_id AS id, value FROM events WHERE event_id % 4 <> 0 ORDER BY event_id DESC LIMIT 100""")
def recent_points(spark, folder):
    """A stream of JSON points, every fourth broken: the last 100 that parse."""
    raw = streams.file_stream(spark, folder, "events.parquet").selectExpr(
        "if(event_id % 4 = 0, '{\"id\": ', to_json(named_struct('id', event_id, 'value', value))) AS value")
    points = streams.run_available(streams.parsed_messages(raw, "id BIGINT, value DOUBLE"), "points")
    return tables.keep_last(points, 100, ["id"])
