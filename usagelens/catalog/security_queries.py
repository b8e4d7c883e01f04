"""Detectors, reports over findings, and the detector views, over `documents`."""

from __future__ import annotations

from pyspark.sql import functions as F

from usagelens.catalog import projections as p
from usagelens.catalog.oracle_parts import CHATS, FINDINGS, REDACTED, SCORED, USAGE
from usagelens.catalog.registry import query
from usagelens.config import DETECTORS
from usagelens.operators import detect, verdicts
from usagelens.plans import security as s
from usagelens.plans import views
from usagelens.plans.filters import ReportFilters

_F = f"WITH {FINDINGS} "
_C = f"WITH {CHATS} "


def _detector_query(analyzer: str) -> None:
    @query(f"{analyzer}_findings", _F + f"""SELECT finding_id, chat_id, analyzer, pattern, category, severity, title, start,
      matched_text, confidence FROM findings WHERE analyzer = '{analyzer}'""")
    def run(spark, folder):
        chosen = [d for d in DETECTORS if d.analyzer == analyzer]
        return detect.detect(p.chats(spark, folder), detectors=chosen).select(
            "finding_id", "chat_id", "analyzer", "pattern", "category", "severity", "title", "start", "matched_text",
            "confidence")


for _name in ("secrets", "pii", "slopsquatting"):
    _detector_query(_name)


@query("finding_snippets", _F + """SELECT finding_id, trim(substr(user_text, greatest(start - 80, 0) + 1,
  start + length(match) + 80 - greatest(start - 80, 0)), ' \n\t\r') AS snippet FROM findings""")
def finding_snippets(spark, folder):
    return p.findings(spark, folder).select("finding_id", "snippet")


@query("redacted_text_findings", f"WITH {REDACTED} " + """SELECT analyzer, pattern, CAST(sum(len(ms)) AS BIGINT) AS finding_count
  FROM hits GROUP BY 1, 2 HAVING sum(len(ms)) > 0""")
def redacted_text_findings(spark, folder):
    """The detectors on cleaned text: what redaction leaves behind."""
    found = detect.detect(p.chat_context(spark, folder), text_col="user_text_clean")
    return found.groupBy("analyzer", "pattern").agg(F.count("*").alias("finding_count"))


@query("findings_by_category", _F + """SELECT category, severity, analyzer, c.provider, c.model_name, count(*) AS finding_count
  FROM findings JOIN chats c USING (chat_id) GROUP BY ALL""")
def findings_by_category(spark, folder):
    return views.findings_by_category(p.chat_context(spark, folder), p.findings(spark, folder))


@query("findings_timeline", _F + """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, category, severity, count(*) AS finding_count
  FROM findings WHERE ts IS NOT NULL GROUP BY ALL""")
def findings_timeline(spark, folder):
    return views.findings_timeline(p.chat_context(spark, folder), p.findings(spark, folder))


@query("top_findings", _F + """SELECT finding_id, analyzer, f.category, severity, title, strftime(f.ts, '%Y-%m-%d %H:%M:%S') AS created_at,
    c.provider, c.model_name, c.conversation_title, c.author FROM findings f JOIN chats c USING (chat_id)
  WHERE severity IN ('critical', 'high') ORDER BY f.ts DESC NULLS LAST, finding_id LIMIT 100""")
def top_findings(spark, folder):
    return views.top_findings(p.chat_context(spark, folder), p.findings(spark, folder)).select(
        "finding_id", "analyzer", "category", "severity", "title", "created_at", "provider", "model_name",
        "conversation_title", "author")


@query("overview", f"WITH {SCORED}" + """ SELECT count(*) AS total_messages, count(DISTINCT conversation_key) AS total_conversations,
    count(DISTINCT provider) AS total_providers, CAST(coalesce(sum(p.n + CASE WHEN x.score IS NULL THEN 0 ELSE 0 END), 0) AS BIGINT)
      + (SELECT count(*) FROM complexity) AS total_findings,
    CAST(sum(critical) AS BIGINT) AS critical_findings, CAST(sum(high) AS BIGINT) AS high_findings,
    CAST(sum(medium) AS BIGINT) AS medium_findings, 0 AS low_findings,
    count(*) FILTER (p.n > 0 OR x.score IS NOT NULL) AS analyzed_messages,
    count(*) FILTER (p.n IS NULL AND x.score IS NULL) AS pending_messages, round(avg(risk), 4) AS average_risk_score
  FROM chats c LEFT JOIN per p USING (chat_id) LEFT JOIN insights i USING (chat_id) LEFT JOIN complexity x USING (chat_id)""")
def overview(spark, folder):
    return views.overview(p.chat_context(spark, folder), p.scored_findings(spark, folder), p.insight_rows(spark, folder))


@query("provider_stats", f"WITH {SCORED}" + """ SELECT provider, model_name, count(*) AS message_count,
    count(DISTINCT conversation_key) AS conversation_count, CAST(coalesce(sum(security_leaks), 0) AS BIGINT) AS security_leaks,
    CAST(coalesce(sum(content_leaks), 0) AS BIGINT) AS content_leaks,
    CAST(coalesce(sum(supply_chain), 0) AS BIGINT) AS supply_chain_findings, 0 AS trivial_usage,
    round(avg(score), 4) AS avg_complexity
  FROM chats LEFT JOIN per USING (chat_id) LEFT JOIN complexity USING (chat_id) GROUP BY 1, 2""")
def provider_stats(spark, folder):
    return views.provider_stats(p.chat_context(spark, folder), p.scored_findings(spark, folder))


@query("conversation_scatter", f"WITH {SCORED}" + """ SELECT conversation_key, provider, model_name, count(*) AS message_count,
    round(avg(score), 4) AS avg_complexity,
    CAST(coalesce(sum(security_leaks), 0) + coalesce(sum(content_leaks), 0) AS BIGINT) AS leak_count,
    CAST(sum(length(user_text_clean)) AS BIGINT) AS total_chars
  FROM chats LEFT JOIN per USING (chat_id) LEFT JOIN complexity USING (chat_id) GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def conversation_scatter(spark, folder):
    return views.conversation_scatter(p.chat_context(spark, folder), p.scored_findings(spark, folder))


@query("chat_stats", _C + """SELECT count(*) AS messages, count(DISTINCT conversation_key) AS conversations,
  count(DISTINCT provider) AS providers, count(DISTINCT model_name) AS models,
  strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS earliest, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest FROM chats""")
def chat_stats(spark, folder):
    return views.chat_stats(p.chat_context(spark, folder))


@query("severity_distribution", _F + """SELECT t.type, count(*) FILTER (severity = 'critical') AS critical,
  count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium,
  count(*) FILTER (severity = 'low') AS low FROM (VALUES ('secret'), ('pii'), ('slopsquat')) t(type)
  LEFT JOIN findings f USING (type) GROUP BY 1""")
def severity_distribution(spark, folder):
    return s.severity_distribution(p.report_rows(spark, folder))


@query("severity_totals", _F + """SELECT count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high,
  count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM findings""")
def severity_totals(spark, folder):
    return s.severity_totals(p.report_rows(spark, folder))


@query("leak_counts", _F + "SELECT model, type AS category, count(*) AS leak_count FROM report GROUP BY 1, 2")
def leak_counts(spark, folder):
    return s.leak_counts(p.report_rows(spark, folder))


@query("leak_counts_of_family", _F + "SELECT model, type AS category, count(*) AS leak_count FROM report WHERE model = 'anthropic' AND type = 'pii' GROUP BY 1, 2")
def leak_counts_of_family(spark, folder):
    return s.leak_counts(p.report_rows(spark, folder), ReportFilters(model="Anthropic", category="pii"))


def _slopsquat(dimension: str, key: str) -> None:
    @query(f"slopsquat_by_{dimension}", f"WITH {FINDINGS}, {USAGE} " + f"""SELECT {key} AS key, count(*) AS halluc_count,
      round(count(*) * 1000 / greatest((SELECT count(*) FROM usage), 1), 2) AS halluc_rate,
      count(*) FILTER (regexp_matches(lower(matched_text), 'pip|npm|package|install')) AS packages,
      count(*) FILTER (regexp_matches(lower(matched_text), 'http|endpoint')) AS endpoints,
      count(*) FILTER (regexp_matches(lower(matched_text), 'cmd|cli')) AS cli_tools,
      count(*) FILTER (regexp_matches(lower(matched_text), 'role|scope')) AS rbac_roles
      FROM report WHERE type = 'slopsquat' GROUP BY 1""")
    def run(spark, folder):
        return s.slopsquat_stats(p.report_rows(spark, folder), p.usage(spark, folder), dimension)


for _dim, _key in (("model", "model"), ("provider", "provider"), ("department", "coalesce(department, 'unknown')")):
    _slopsquat(_dim, _key)


@query("duplicate_secrets", _F + """SELECT match_hash AS secret_hash, 'security_leak' AS category,
    strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_detected, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_detected,
    count(DISTINCT provider) AS providers, count(DISTINCT conversation_id) AS affected_users,
    count(DISTINCT message_id) AS affected_sessions,
    coalesce(string_agg(DISTINCT department, ',' ORDER BY department), '') AS departments, 'critical' AS severity
  FROM report WHERE type = 'secret' GROUP BY 1 HAVING count(DISTINCT provider) >= 2""")
def duplicate_secrets(spark, folder):
    return s.duplicate_secrets(p.report_rows(spark, folder))


for _grain in ("hour", "day", "week"):
    def _series(spark, folder, grain=_grain):
        return s.findings_series(p.report_rows(spark, folder), grain)

    query(f"findings_per_{_grain}", _F + f"""SELECT strftime(date_trunc('{_grain}', ts), '%Y-%m-%d %H:%M:%S') AS bucket,
      CAST(count(*) AS DOUBLE) AS value FROM report GROUP BY 1""")(_series)


@query("hourly_pattern", _F + """SELECT hour(ts) AS hour, count(*) AS leak_count, count(*) FILTER (severity = 'critical') AS critical_count
  FROM report WHERE ts IS NOT NULL GROUP BY 1""")
def hourly_pattern(spark, folder):
    return s.hourly_pattern(p.report_rows(spark, folder).filter("timestamp IS NOT NULL"))


@query("weekday_pattern", _F + "SELECT dayname(ts) AS day_of_week, count(*) AS leak_count FROM report WHERE ts IS NOT NULL GROUP BY 1")
def weekday_pattern(spark, folder):
    return s.weekday_pattern(p.report_rows(spark, folder).filter("timestamp IS NOT NULL"))


_PAGE = """SELECT finding_id AS id, type, severity, model, strftime(ts, '%Y-%m-%d %H:%M:%S') AS detected_at, matched_text AS match_value
  FROM report WHERE department = 'finance' AND severity = 'high' AND type = 'secret' ORDER BY ts DESC NULLS LAST, finding_id LIMIT 20 OFFSET 10"""


@query("findings_page", _F + _PAGE)
def findings_page(spark, folder):
    wanted = ReportFilters(department="finance", severity="high", category="secret", limit=20, offset=10)
    page = s.finding_payload(s.findings_page(p.report_rows(spark, folder), wanted))
    return page.select("id", "type", "severity", "model", "detected_at", "match_value")


@query("findings_total", _F + "SELECT count(*) AS total FROM report WHERE provider = 'gemini' AND ts >= TIMESTAMP '2024-01-10'")
def findings_total(spark, folder):
    return s.findings_total(p.report_rows(spark, folder), ReportFilters(provider="Gemini", start="2024-01-10"))


@query("alerts", _F + """SELECT finding_id AS id, type, severity, upper(type[1]) || type[2:] || ' finding' AS title,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, coalesce(department, 'unknown') AS department, provider, conversation_id,
  'open' AS status, '/dashboard/findings/' || finding_id AS action_url FROM report ORDER BY ts DESC NULLS LAST, finding_id LIMIT 50""")
def alerts(spark, folder):
    return s.alerts(p.report_rows(spark, folder)).drop("message")


@query("recent_leaks", _F + """SELECT finding_id AS id, type, matched_text AS match_value FROM report WHERE type IN ('secret', 'pii')
  ORDER BY ts DESC NULLS LAST, finding_id LIMIT 20""")
def recent_leaks(spark, folder):
    return s.recent_leaks(p.report_rows(spark, folder)).select("id", "type", "match_value")


@query("findings_summary", _F + "SELECT analyzer, category, severity, count(*) AS finding_count FROM findings GROUP BY ALL")
def findings_summary(spark, folder):
    return s.findings_summary(p.findings(spark, folder))


@query("provider_risk", _F + """SELECT provider, count(*) AS total, count(*) FILTER (severity = 'critical') AS critical,
  count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium,
  count(*) FILTER (severity = 'low') AS low FROM report GROUP BY 1""")
def provider_risk(spark, folder):
    return s.provider_risk(p.report_rows(spark, folder))


@query("department_risk", _F + """SELECT department, count(*) AS total, count(*) FILTER (severity = 'critical') AS critical,
  count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium,
  count(*) FILTER (severity = 'low') AS low FROM report GROUP BY 1""")
def department_risk(spark, folder):
    return s.provider_risk(p.report_rows(spark, folder), "department")


_STATUS = """, log AS (SELECT finding_id, CASE hash_no % 3 WHEN 0 THEN 'acknowledged' WHEN 1 THEN 'resolved' ELSE 'open' END AS status
  FROM (SELECT finding_id, chat_id AS hash_no FROM findings WHERE analyzer = 'pii'))"""


def _status_log(spark, folder):
    """Two log entries per personal-data finding: seen first, then a later state."""
    base = p.findings(spark, folder).filter("analyzer = 'pii'").selectExpr(
        "finding_id", "explode(array(0, 1)) AS step", "chat_id")
    return base.selectExpr(
        "finding_id", "CASE WHEN step = 0 THEN 'seen' ELSE CASE chat_id % 3 WHEN 0 THEN 'acknowledged' "
        "WHEN 1 THEN 'resolved' ELSE 'open' END END AS status", "concat('step ', step) AS notes",
        "TIMESTAMP '2024-02-01 00:00:00' + make_dt_interval(0, step) AS changed_at")


@query("status_overlay", _F + _STATUS + """ SELECT r.finding_id AS id, coalesce(l.status, 'open') AS status,
  CASE WHEN l.finding_id IS NOT NULL THEN 'step 1' END AS notes FROM report r LEFT JOIN log l USING (finding_id)""")
def status_overlay(spark, folder):
    return s.with_status(p.report_rows(spark, folder), _status_log(spark, folder)).select("id", "status", "notes")


@query("alert_stats", _F + _STATUS + """ SELECT severity, coalesce(l.status, 'open') AS status, count(*) AS alert_count
  FROM report r LEFT JOIN log l USING (finding_id) GROUP BY 1, 2""")
def alert_stats(spark, folder):
    return s.alert_stats(s.with_status(p.report_rows(spark, folder), _status_log(spark, folder)))


@query("audit_trail", _F + """SELECT finding_id, status, notes FROM (
  SELECT finding_id, 'seen' AS status, 'step 0' AS notes FROM findings WHERE analyzer = 'pii' UNION ALL
  SELECT finding_id, CASE chat_id % 3 WHEN 0 THEN 'acknowledged' WHEN 1 THEN 'resolved' ELSE 'open' END, 'step 1' FROM findings
  WHERE analyzer = 'pii')""")
def audit_trail(spark, folder):
    return s.audit_trail(_status_log(spark, folder)).select("finding_id", "status", "notes")


@query("unanalysed", _F + """SELECT chat_id FROM chats WHERE author = 'user' AND chat_id % 4 NOT IN (0, 1)""")
def unanalysed(spark, folder):
    """Half of the messages are in the processed log of this analyzer, with and without findings; others only in another's."""
    chats = p.chat_context(spark, folder)
    log = detect.processed_log(chats.filter("chat_id % 4 IN (0, 1)"), ["secrets"]).unionByName(
        detect.processed_log(chats.filter("chat_id % 4 = 2"), ["pii"]))
    return detect.unanalysed(chats, log, "secrets").select("chat_id")


@query("pending_insights", _F + """SELECT DISTINCT chat_id FROM findings WHERE chat_id NOT IN (
  SELECT chat_id FROM findings WHERE severity = 'critical')""")
def pending_insights(spark, folder):
    found = p.findings(spark, folder)
    return verdicts.pending_insights(found, found.filter("severity = 'critical'"))


@query("insights", f"WITH {SCORED}" + """ SELECT chat_id, CAST(risk AS BIGINT) AS risk_score, factors AS risk_factors,
  n || ' findings: ' || replace(factors, ',', ', ') AS summary, '2024-02-01 00:00:00' AS created_at FROM insights""")
def insights(spark, folder):
    return p.insight_rows(spark, folder)


@query("findings_json", _F + """SELECT chat_id, count(*) AS n, min(start) AS first_start,
  'run-1' AS run_id FROM findings GROUP BY 1""")
def findings_json(spark, folder):
    packed = detect.findings_json(p.chat_context(spark, folder), p.findings(spark, folder))
    return packed.select("chat_id", F.json_array_length("findings").cast("bigint").alias("n"),
                         F.get_json_object("findings", "$[0].start").cast("bigint").alias("first_start"), "run_id")


# ------------------------------------------------------------------ verdicts
@query("trivial_verdicts", _C + """SELECT doc_id AS chat_id, 'llm_trivial' AS analyzer, 'usage_quality' AS category, 'low' AS severity,
  'Trivial AI usage detected' AS title, 'label 0' AS detail, substr(c.user_text, 1, 300) AS snippet,
  CAST(round(0.5 + 0.1 * (doc_id % 5), 3) AS DOUBLE) AS confidence FROM labels JOIN chats c ON doc_id = chat_id WHERE quality = 0""")
def trivial_verdicts(spark, folder):
    parsed = verdicts.parse_verdicts(p.answers(spark, folder), verdicts.TRIVIAL, "trivial")
    return verdicts.trivial_findings(parsed, p.chats(spark, folder)).drop("meta").withColumn(
        "confidence", F.round("confidence", 3))


@query("sensitivity_verdicts", _C + """, l AS (SELECT doc_id, ['critical', 'high', 'medium', 'low', 'none'][doc_id % 5 + 1] AS level
    FROM labels WHERE toxic = 1)
  SELECT doc_id AS chat_id, 'llm_sensitivity' AS analyzer, 'content_leak' AS category,
  CASE level WHEN 'none' THEN 'info' ELSE level END AS severity, 'Sensitive content detected (' || level || ')' AS title,
  'toxic: d' || (doc_id % 3) AS detail, substr(c.user_text, 1, 300) AS snippet, CAST(0.85 AS DOUBLE) AS confidence
  FROM l JOIN chats c ON doc_id = chat_id""")
def sensitivity_verdicts(spark, folder):
    parsed = verdicts.parse_verdicts(p.answers(spark, folder), verdicts.SENSITIVITY, "sensitivity")
    return verdicts.sensitivity_findings(parsed, p.chats(spark, folder)).drop("meta")


@query("complexity_verdicts", """SELECT doc_id AS chat_id, 'Complexity: ' || (doc_id % 10 + 1) || '/10 (analysis)' AS title,
  'quality ' || quality AS detail, 'info' AS severity FROM labels""")
def complexity_verdicts(spark, folder):
    parsed = verdicts.parse_verdicts(p.answers(spark, folder), verdicts.COMPLEXITY, "complexity")
    return verdicts.complexity_findings(parsed).select("chat_id", "title", "detail", "severity")


def _overview(spark, folder):
    return views.overview(p.chat_context(spark, folder), p.findings(spark, folder), p.insight_rows(spark, folder))


@query("recommendations", f"WITH {SCORED}" + """, o AS (SELECT count(*) AS m, sum(critical) / count(*) AS c, sum(high) / count(*) AS h,
    count(*) FILTER (p.n IS NULL) / count(*) AS pe, avg(risk) / 100 AS r FROM chats LEFT JOIN per p USING (chat_id) LEFT JOIN insights USING (chat_id))
  SELECT 'security' AS category, 'Rotate exposed credentials' AS title, 95 AS impact_score FROM o WHERE c > 0
  UNION ALL SELECT 'security', 'Train staff on secrets in prompts', 80 FROM o WHERE h > 0.01
  UNION ALL SELECT 'coverage', 'Analyse pending messages', 50 FROM o WHERE pe > 0.5
  UNION ALL SELECT 'quality', 'Review risky conversations', 60 FROM o WHERE r > 0.3""")
def recommendations(spark, folder):
    made = verdicts.recommendations(_overview(spark, folder), F.lit(p.AS_OF).cast("timestamp"))
    return made.select("category", "title", "impact_score")


@query("statistics_json", _F + """SELECT (SELECT count(*) FROM chats) AS total_messages,
  least(10, (SELECT count(*) FROM (SELECT DISTINCT category, severity, analyzer, c.provider, c.model_name FROM findings
    JOIN chats c USING (chat_id)))) AS categories,
  least(10, (SELECT count(*) FROM (SELECT DISTINCT provider, model_name FROM chats))) AS providers""")
def statistics_json(spark, folder):
    context, found = p.chat_context(spark, folder), p.findings(spark, folder)
    packed = verdicts.statistics_json(_overview(spark, folder), views.findings_by_category(context, found),
                                      views.provider_stats(context, found))
    part = lambda path: F.get_json_object("statistics", path)
    return packed.select(part("$.overview.total_messages").cast("bigint").alias("total_messages"),
                         F.json_array_length(part("$.top_finding_categories")).alias("categories"),
                         F.json_array_length(part("$.provider_usage_and_leaks")).alias("providers"))


@query("conversation_explorer", f"WITH {SCORED}" + """ SELECT conversation_key, min(provider) AS provider, count(*) AS message_count,
  CAST(coalesce(sum(n), 0) AS BIGINT) AS finding_count, CASE WHEN sum(critical) > 0 THEN 'critical' WHEN sum(high) > 0 THEN 'high'
  WHEN sum(medium) > 0 THEN 'medium' ELSE 'info' END AS highest_severity, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started_at
  FROM chats LEFT JOIN per USING (chat_id) GROUP BY 1""")
def conversation_explorer(spark, folder):
    return views.conversation_explorer(p.chat_context(spark, folder), p.findings(spark, folder))


@query("conversation_detail", f"WITH {SCORED}" + """ SELECT message_id, message_index, coalesce(n, 0) AS findings FROM chats
  LEFT JOIN per USING (chat_id) WHERE conversation_key = 'conv-src7-0'""")
def conversation_detail(spark, folder):
    rows = views.conversation_detail(p.chat_context(spark, folder), p.findings(spark, folder), "conv-src7-0")
    return rows.select("message_id", "message_index", F.coalesce(F.size("findings"), F.lit(0)).alias("findings"))


@query("top_entities", _C + """, e AS (SELECT 'domain' AS kind, unnest(regexp_extract_all(user_text, '[\\w.-]+@([a-z0-9-]+\\.[a-z]+)', 1)) AS entity FROM chats
  UNION ALL SELECT 'package', unnest(regexp_extract_all(user_text, 'pip install ([\\w-]+)', 1)) FROM chats)
  SELECT kind, lower(entity) AS entity, count(*) AS mentions FROM e GROUP BY 1, 2 ORDER BY mentions DESC, kind, entity LIMIT 20""")
def top_entities(spark, folder):
    return s.top_entities(p.chats(spark, folder), "user_text", {
        "domain": r"[\w.-]+@([a-z0-9-]+\.[a-z]+)", "package": r"pip install ([\w-]+)"})


@query("context_exposure", _C + r""", f AS (SELECT conversation_key, unnest(regexp_extract_all(lower(user_text), '[a-z0-9_-]+\.(cfg|py|csv)\b', 1)) AS e FROM chats)
  SELECT conversation_key, count(*) FILTER (e = 'cfg') AS cfg, count(*) FILTER (e = 'py') AS py, count(*) FILTER (e = 'csv') AS csv,
    count(*) FILTER (e = 'cfg') * 5 + count(*) FILTER (e = 'py') * 2 + count(*) FILTER (e = 'csv') * 3 AS score FROM f GROUP BY 1""")
def context_exposure(spark, folder):
    return s.context_exposure(p.chats(spark, folder), "conversation_key", "user_text", {"cfg": 5, "py": 2, "csv": 3})


@query("top_packages", _F + """SELECT lower(matched_text) AS package, count(*) AS mentions FROM report WHERE type = 'slopsquat'
  GROUP BY 1 ORDER BY mentions DESC, package LIMIT 10""")
def top_packages(spark, folder):
    return s.top_packages(p.report_rows(spark, folder))


@query("latest_detections", _F + "SELECT finding_id AS id, type, severity FROM report ORDER BY ts DESC NULLS LAST, finding_id LIMIT 6")
def latest_detections(spark, folder):
    return s.findings_page(p.report_rows(spark, folder), ReportFilters(limit=6)).select("id", "type", "severity")
