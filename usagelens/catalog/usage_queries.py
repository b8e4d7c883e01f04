"""Usage reports over `events`."""

from __future__ import annotations

from pyspark.sql import functions as F

from usagelens import config
from usagelens.catalog import projections as p
from usagelens.catalog.oracle_parts import FINDINGS, USAGE
from usagelens.catalog.registry import query
from usagelens.operators import compliance
from usagelens.plans import sketches
from usagelens.plans import usage as u
from usagelens.plans.filters import ReportFilters, filter_usage
from usagelens.session import materialise, spread

_KEYS = {"department": "department_id", "model": "model_name", "tool": "tool_name",
         "region": "coalesce(region, 'unknown')", "timespan": "strftime(usage_start, '%Y-%m-%d')"}


def _cost_sql(key: str) -> str:
    return f"""WITH {USAGE} SELECT {key} AS key, round(sum(cost), 4) AS cost, count(*) AS sessions,
      round(sum(cost) / count(*), 4) AS avg_cost_per_session, CAST(sum(token_count) AS BIGINT) AS tokens,
      round(sum(cost) / greatest(sum(token_count), 1), 6) AS cost_per_token,
      round(count(*) FILTER (trivial) / count(*) * 100, 2) AS trivial_percentage,
      round(count(*) FILTER (private) / count(*) * 100, 2) AS private_percentage FROM flagged GROUP BY 1"""


def _register_dimension(dimension: str, key: str) -> None:
    @query(f"cost_by_{dimension}", _cost_sql(key))
    def cost(spark, folder):
        return u.cost_analytics(p.usage(spark, folder), dimension)

    @query(f"usage_by_{dimension}", f"""WITH {USAGE}, words AS (
      SELECT *, greatest(len(regexp_extract_all(purpose, '\\b[\\w''-]+\\b')), greatest(1, token_count // 4)) AS w FROM flagged)
      SELECT {key} AS key, count(*) AS events, CAST(sum(token_count) AS BIGINT) AS tokens,
        round(sum(token_count) / count(*), 2) AS average_tokens, round(sum(w) / count(*), 2) AS average_words
      FROM words GROUP BY 1""")
    def volume(spark, folder):
        return u.usage_analytics(p.usage(spark, folder), dimension)

    @query(f"cost_share_by_{dimension}", f"""WITH {USAGE} SELECT {key} AS key, round(sum(cost), 4) AS cost,
      round(sum(cost) / (SELECT sum(cost) FROM usage) * 100, 2) AS share FROM usage GROUP BY 1""")
    def share(spark, folder):
        return u.cost_shares(p.usage(spark, folder), dimension)


for _dimension, _key in _KEYS.items():
    _register_dimension(_dimension, _key)


@query("rollup_by_purpose", f"""WITH {USAGE} SELECT purpose AS key, count(*) AS events, CAST(sum(token_count) AS BIGINT) AS tokens,
  round(sum(cost), 4) AS cost, count(*) FILTER (trivial_wide) AS trivial, count(*) FILTER (private_wide) AS private
  FROM flagged GROUP BY 1""")
def rollup_by_purpose(spark, folder):
    return u.rollup_by(p.usage(spark, folder), "purpose")


@query("usage_totals", f"""WITH {USAGE} SELECT round(sum(cost), 4) AS total_cost, count(*) AS total_events,
  CAST(sum(token_count) AS BIGINT) AS total_tokens, count(DISTINCT department_id) AS total_departments,
  count(DISTINCT model_name) AS total_models FROM usage""")
def usage_totals(spark, folder):
    return u.usage_totals(p.usage(spark, folder))


@query("top_departments", f"""WITH {USAGE} SELECT department_id AS department, round(sum(cost), 4) AS cost, count(*) AS events
  FROM usage GROUP BY 1 ORDER BY events DESC, department LIMIT 5""")
def top_departments(spark, folder):
    return u.top_departments(p.usage(spark, folder))


_COVERAGE = f"""WITH {USAGE}, c AS (
  SELECT count(*) AS total, count(*) FILTER (purpose <> '') AS purpose_logged, count(*) FILTER (region <> '') AS region_logged,
    count(*) FILTER (model_name <> '') AS model_name_logged, count(*) FILTER (department_id <> '') AS department_attributed,
    count(*) FILTER (user_id_hash <> '') AS user_pseudonymized FROM usage),
l AS (SELECT total, unnest(['purpose_logged', 'region_logged', 'model_name_logged', 'department_attributed',
    'user_pseudonymized']) AS "check", unnest([purpose_logged, region_logged, model_name_logged, department_attributed,
    user_pseudonymized]) AS covered FROM c),
s AS (SELECT "check", covered, total, CAST(floor(covered / total * 100) AS BIGINT) AS percentage FROM l)"""


@query("compliance_checks", _COVERAGE + ' SELECT * FROM s')
def compliance_checks(spark, folder):
    return u.compliance_checks(p.usage(spark, folder))


@query("compliance_score", _COVERAGE + """ SELECT CAST(round_even(avg(percentage), 0) AS BIGINT) AS overall_score,
  CASE WHEN round_even(avg(percentage), 0) >= 80 THEN 'compliant' WHEN round_even(avg(percentage), 0) >= 50 THEN 'partial'
  ELSE 'non_compliant' END AS status FROM s""")
def compliance_score(spark, folder):
    return u.compliance_overall(p.usage(spark, folder))


@query("legislation_score", _COVERAGE + " SELECT CAST(floor(sum(percentage) / count(*)) AS BIGINT) AS score FROM s")
def legislation_score(spark, folder):
    return u.legislation_score(p.usage(spark, folder))


for _metric, _value in (("cost", "sum(cost)"), ("events", "CAST(count(*) AS DOUBLE)"), ("tokens", "CAST(sum(token_count) AS DOUBLE)")):
    for _grain in ("hour", "day", "week"):
        def _series(spark, folder, metric=_metric, grain=_grain):
            return u.time_series(p.usage(spark, folder), metric, grain)

        query(f"{_metric}_per_{_grain}", f"""WITH {USAGE}
          SELECT strftime(date_trunc('{_grain}', usage_start), '%Y-%m-%d %H:%M:%S') AS bucket, round({_value}, 2) AS value
          FROM usage GROUP BY 1""")(_series)


@query("recent_cost_points", f"""WITH {USAGE}, d AS (SELECT date_trunc('day', usage_start) AS b, round(sum(cost), 2) AS value
  FROM usage GROUP BY 1) SELECT strftime(b, '%Y-%m-%d %H:%M:%S') AS bucket, value FROM d ORDER BY b DESC LIMIT 30""")
def recent_cost_points(spark, folder):
    return u.last_points(u.time_series(p.usage(spark, folder)))


@query("daily_department_summary", f"""WITH {USAGE} SELECT CAST(CAST(usage_start AS DATE) AS VARCHAR) AS day, department_id, tool_name,
  model_name, count(*) AS event_count, CAST(sum(token_count) AS BIGINT) AS total_tokens, round(sum(cost), 4) AS total_cost
  FROM usage GROUP BY 1, 2, 3, 4""")
def daily_department_summary(spark, folder):
    return u.daily_summary(p.usage(spark, folder))


_ANOMALY = """, daily AS (SELECT department_id, CAST(usage_start AS DATE) AS day, sum(cost) AS cost FROM usage GROUP BY 1, 2),
stats AS (SELECT department_id, count(*) AS days, avg(cost) AS mean, stddev_pop(cost) AS dev, max(day) AS period,
  arg_max(cost, day) AS observed FROM daily GROUP BY 1),
scored AS (SELECT *, (observed - mean) / CASE WHEN dev = 0 THEN 1 ELSE dev END AS z FROM stats WHERE days >= 2)
SELECT department_id AS department, CAST(period AS VARCHAR) AS period, 'cost' AS metric, round(mean, 4) AS baseline_value,
  round(observed, 4) AS observed_value, round(z, 2) AS z_score, CASE WHEN z > 0 THEN 'high' ELSE 'low' END AS severity,
  department_id || ' cost deviated from baseline' AS explanation FROM scored WHERE abs(z) >= """


_SPIKE = USAGE.replace("value AS cost", "value * CASE WHEN user_id % 10 = 3 AND ts >= TIMESTAMP '2024-01-30' THEN 40 ELSE 1 END AS cost")


@query("cost_anomalies", f"WITH {_SPIKE}{_ANOMALY} 2")
def cost_anomalies(spark, folder):
    """One department's last day costs forty times as much."""
    spike = (F.col("department_id") == "dept-3") & (F.col("usage_start") >= F.lit("2024-01-30").cast("timestamp"))
    return u.anomalies(p.usage(spark, folder).withColumn("cost", F.when(spike, F.col("cost") * 40).otherwise(F.col("cost"))))


@query("cost_deviations", f"WITH {USAGE}{_ANOMALY} 0.5")
def cost_deviations(spark, folder):
    return u.anomalies(p.usage(spark, folder), 0.5)


@query("provider_flow", f"""WITH {USAGE} SELECT provider, count(*) AS event_count, CAST(sum(token_count) AS BIGINT) AS total_tokens,
  round(sum(cost), 4) AS total_cost, string_agg(DISTINCT tool_name, ',' ORDER BY tool_name) AS tools,
  string_agg(DISTINCT department_id, ',' ORDER BY department_id) AS departments FROM flagged GROUP BY 1""")
def provider_flow(spark, folder):
    return u.provider_flow(p.usage(spark, folder))


@query("code_index_risks", f"""WITH {USAGE} SELECT id, tool_name AS tool, model_name AS model, provider, department_id AS department,
  'Agent may index codebase and send IP to non-EU provider' AS risk FROM flagged
  WHERE tool_name = 'CodeAssist' AND gdpr_risk = 'high'""")
def code_index_risks(spark, folder):
    return u.code_index_risks(p.usage(spark, folder))


@query("non_eu_transfers", f"""WITH {USAGE} SELECT id, tool_name AS tool, model_name AS model, provider, data_region,
  department_id AS department FROM flagged WHERE tool_name IN ('DocAnalyzer', 'DataSummarizer', 'TicketHelper')
  AND data_region NOT IN ('EU (Paris)', 'Local device')""")
def non_eu_transfers(spark, folder):
    return u.non_eu_transfers(p.usage(spark, folder))


@query("flow_edges", f"""WITH {USAGE}, e AS (
  SELECT 'department' AS source_kind, department_id AS source, 'tool' AS target_kind, tool_name AS target, token_count FROM usage
  UNION ALL SELECT 'tool', tool_name, 'model', model_name, token_count FROM usage
  UNION ALL SELECT 'model', model_name, 'region', coalesce(region, 'unknown'), token_count FROM usage)
  SELECT source_kind, source, target_kind, target, CAST(sum(token_count) AS BIGINT) AS value FROM e GROUP BY ALL""")
def flow_edges(spark, folder):
    return u.flow_edges(p.usage(spark, folder))


@query("unapproved_usage", f"""WITH {USAGE} SELECT model_name, department_id, count(*) AS events,
  CAST(sum(token_count) AS BIGINT) AS tokens, round(sum(cost), 4) AS cost FROM flagged
  WHERE gdpr_risk <> 'low' GROUP BY 1, 2""")
def unapproved_usage(spark, folder):
    approved = u.registry_frame(spark).filter("gdpr_risk = 'low'").select(F.col("model").alias("model_name"))
    return u.unapproved_usage(p.usage(spark, folder), approved)


@query("retention_matrix", f"""WITH {USAGE} SELECT provider, headquarters, data_region, gdpr_risk, count(*) AS events,
  CAST(sum(token_count) AS BIGINT) AS tokens FROM flagged GROUP BY 1, 2, 3, 4""")
def retention_matrix(spark, folder):
    return u.retention_matrix(p.usage(spark, folder))


@query("cost_sparklines", f"""WITH {USAGE}, d AS (SELECT department_id, CAST(usage_start AS DATE) AS day,
  round(sum(cost), 2) AS cost FROM usage GROUP BY 1, 2)
  SELECT department_id AS key, count(*) AS days, round(list_sum(list(cost)), 2) AS total,
    list(cost ORDER BY day)[1] AS first_cost, list(cost ORDER BY day)[-1] AS last_cost FROM d GROUP BY 1""")
def cost_sparklines(spark, folder):
    lines = u.cost_sparklines(p.usage(spark, folder))
    total = F.aggregate("daily_cost", F.lit(0.0), lambda s, v: s + v)
    return lines.select("key", F.size("daily_cost").alias("days"), F.round(total, 2).alias("total"),
                        F.get("daily_cost", F.lit(0)).alias("first_cost"), F.element_at("daily_cost", -1).alias("last_cost"))


@query("budget_status", f"""WITH {USAGE}, s AS (SELECT department_id AS department, sum(cost) AS c FROM usage GROUP BY 1),
  b AS (SELECT 'dept-' || n_nationkey AS department, 1000.0 * (n_nationkey + 1) * (SELECT count(*) FROM events) / 2000 AS budget FROM nation),
  j AS (SELECT department, CAST(budget AS DOUBLE) AS budget, coalesce(c, 0) AS c FROM b LEFT JOIN s USING (department))
  SELECT department, budget, round(c, 4) AS spent, round(c / budget * 100, 2) AS percentage,
    CASE WHEN c / budget * 100 > 90 THEN 'critical' WHEN c / budget * 100 > 70 THEN 'high' ELSE 'success' END AS status FROM j""")
def budget_status(spark, folder):
    events = p.table(spark, folder, "events").agg(F.count("*").alias("n")).scalar()
    budgets = p.table(spark, folder, "nation").select(
        F.concat(F.lit("dept-"), F.col("n_nationkey").cast("string")).alias("department"),
        (F.lit(1000.0) * (F.col("n_nationkey") + 1) * events / 2000).alias("budget"))
    return u.budget_status(p.usage(spark, folder), budgets)


@query("filtered_usage", f"""WITH {USAGE} SELECT id, department_id, model_name, tool_name, token_count, cost FROM flagged
  WHERE department_id = 'dept-2' AND family = 'anthropic' AND usage_start >= TIMESTAMP '2024-01-05'
    AND usage_end <= TIMESTAMP '2024-01-20'""")
def filtered_usage(spark, folder):
    wanted = ReportFilters(department="dept-2", provider="Anthropic", start="2024-01-05", end="2024-01-20")
    return filter_usage(p.usage(spark, folder), wanted).select(
        "id", "department_id", "model_name", "tool_name", "token_count", "cost")


@query("anonymized_usage", f"""WITH {USAGE} SELECT id, department_id, tool_name, model_name,
  strftime(usage_start, '%Y-%m-%d %H:%M:%S') AS usage_start, strftime(usage_end, '%Y-%m-%d %H:%M:%S') AS usage_end,
  token_count, cost, '[REDACTED]' AS purpose, region, substr(sha256(user_id_hash), 1, 12) || '-hash' AS user_id_hash FROM usage""")
def anonymized_usage(spark, folder):
    return compliance.anonymize(p.usage(spark, folder).withColumnRenamed("user_id_hash", "user_id"))


_FIELDS = ("id", "user_id_hash", "department_id", "tool_name", "model_name", "usage_start", "usage_end", "token_count", "cost", "purpose", "region")


def _issue_sql(rows):
    """Every rule on every field of `rows`."""
    parts = [f"SELECT id, 'missing_field' AS rule, '{f}' AS field FROM {rows} WHERE {f} IS NULL" for f in config.RECORD_REQUIRED_FIELDS]
    parts.append(f"SELECT id, 'unhashed_user', 'user_id_hash' FROM {rows} WHERE contains(user_id_hash, ' ') OR contains(user_id_hash, '@')")
    parts += [f"SELECT id, 'pii_{name}', '{f}' FROM {rows} WHERE regexp_matches(CAST({f} AS VARCHAR), '{pattern}')"
              for name, pattern in config.RECORD_PII_PATTERNS.items() for f in _FIELDS]
    parts += [f"SELECT id, '{rule}', '{f}' FROM {rows} WHERE {f} {test}" for rule, f, test in (
        ("tokens_high", "token_count", f"> {config.MAX_TOKEN_COUNT}"), ("tokens_negative", "token_count", "< 0"),
        ("cost_high", "cost", f"> {config.MAX_COST}"), ("cost_negative", "cost", "< 0"))]
    return " UNION ALL ".join(parts)


@query("record_issues", f"""WITH {USAGE}, r AS (SELECT * REPLACE (CASE WHEN CAST(id AS BIGINT) % 3 = 0
    THEN 'ask bob' || id || '@corp.example or +4930' || (1000000 + CAST(id AS BIGINT)) ELSE purpose END AS purpose,
    CASE WHEN CAST(id AS BIGINT) % 5 = 0 THEN 'Jane Doe' ELSE user_id_hash END AS user_id_hash, cost - 5 AS cost, token_count * 40 AS token_count,
    CASE CAST(id AS BIGINT) % 7 WHEN 0 THEN 'srv 10.0.' || (CAST(id AS BIGINT) % 250) || '.7' WHEN 1 THEN 'DE44 DE44500105175407324931' ELSE region END AS region) FROM usage)
  {_issue_sql("r")}""")
def record_issues(spark, folder):
    """Usage records with planted faults, so that several rules fire; every rule on every field."""
    number = F.col("id").cast("bigint")
    rows = spread(p.usage(spark, folder)).withColumns({
        "purpose": F.when(number % 3 == 0, F.concat(F.lit("ask bob"), "id", F.lit("@corp.example or +4930"), (
            number + 1000000).cast("string"))).otherwise(F.col("purpose")),
        "user_id_hash": F.when(number % 5 == 0, "Jane Doe").otherwise(F.col("user_id_hash")),
        "region": F.when(number % 7 == 0, F.concat(F.lit("srv 10.0."), (number % 250).cast("string"), F.lit(".7"))).when(
            number % 7 == 1, "DE44 DE44500105175407324931").otherwise(F.col("region")),
        "cost": F.col("cost") - 5, "token_count": F.col("token_count") * 40})
    return compliance.record_issues(rows).select("id", "rule", "field")


@query("issue_counts", f"""WITH {USAGE}, i AS ({_issue_sql("usage")}) SELECT rule, field, count(*) AS issue_count FROM i GROUP BY 1, 2""")
def issue_counts(spark, folder):
    return compliance.issue_counts(compliance.record_issues(p.usage(spark, folder)))


@query("duplicate_ids", """WITH l AS (SELECT user_id AS id, event_id AS line FROM events), f AS (
  SELECT id, min(line) AS first_line FROM l GROUP BY 1)
  SELECT id, line, first_line FROM l JOIN f USING (id) WHERE line > first_line""")
def duplicate_ids(spark, folder):
    lines = p.table(spark, folder, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("line_no"))
    return compliance.duplicate_ids(lines, "id", "line_no")


_LEAKS = f"WITH {FINDINGS}, {USAGE}"


@query("model_comparison", _LEAKS + """, l AS (SELECT model AS family, count(*) AS leaks, count(*) FILTER (type = 'slopsquat') AS inv
    FROM report GROUP BY 1),
  m AS (SELECT model_name, family, count(*) AS events, sum(token_count) AS tokens, sum(cost) AS c FROM flagged GROUP BY 1, 2)
  SELECT model_name AS model, family AS provider, events, CAST(tokens AS BIGINT) AS tokens, round(c, 4) AS total_cost,
    round(c / greatest(tokens, 1), 6) AS cost_per_token, round(c / events, 4) AS cost_per_session,
    coalesce(leaks, 0) AS leak_count, round(coalesce(leaks, 0) / events * 1000, 2) AS leak_rate,
    round(coalesce(inv, 0) / events * 1000, 2) AS halluc_rate, round(c / (coalesce(leaks, 0) + 1), 4) AS cost_per_quality
  FROM m LEFT JOIN l USING (family)""")
def model_comparison(spark, folder):
    return u.model_comparison(p.usage(spark, folder), p.report_rows(spark, folder))


@query("complexity_scatter", _LEAKS + """, l AS (SELECT model AS family, count(*) AS n FROM report GROUP BY 1)
  SELECT id AS conversation_id, token_count, coalesce(n, 0) AS finding_count, family AS provider, round(cost, 4) AS cost,
    department_id AS department, CASE WHEN coalesce(n, 0) > 0 THEN 'critical' ELSE 'medium' END AS severity
  FROM flagged LEFT JOIN l USING (family)""")
def complexity_scatter(spark, folder):
    return u.complexity_scatter(p.usage(spark, folder), p.report_rows(spark, folder))


@query("kpi_summary", _LEAKS + """, d AS (SELECT department_id, CAST(usage_start AS DATE) AS day, sum(cost) AS cost FROM usage GROUP BY 1, 2),
  z AS (SELECT count(*) AS n FROM (SELECT department_id, (arg_max(cost, day) - avg(cost)) / stddev_pop(cost) AS z FROM d GROUP BY 1)
    WHERE abs(z) >= 2),
  t AS (SELECT department_id, count(*) AS n FROM usage GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5),
  s AS (SELECT [floor(count(*) FILTER (purpose <> '') / count(*) * 100), floor(count(region) / count(*) * 100), 100, 100, 100] AS v FROM usage)
  SELECT (SELECT round(sum(cost), 4) FROM usage) AS total_cost, (SELECT count(*) FROM usage) AS total_events,
    (SELECT CAST(sum(token_count) AS BIGINT) FROM usage) AS total_tokens,
    (SELECT count(DISTINCT department_id) FROM usage) AS total_departments,
    (SELECT count(DISTINCT model_name) FROM usage) AS total_models, count(*) AS total_findings,
    count(*) FILTER (severity = 'critical') AS critical_count, count(*) FILTER (severity = 'high') AS high_count,
    count(*) FILTER (severity = 'medium') AS medium_count, count(*) FILTER (type = 'secret') AS secret_findings,
    count(*) FILTER (type = 'pii') AS pii_findings, count(*) FILTER (type = 'slopsquat') AS slopsquat_findings,
    (SELECT CAST(round_even(list_sum(v) / 5, 0) AS BIGINT) FROM s) AS overall_score,
    (SELECT CASE WHEN list_sum(v) / 5 >= 79.5 THEN 'compliant' ELSE 'partial' END FROM s) AS status,
    (SELECT n FROM z) AS anomalies, (SELECT string_agg(department_id, ',' ORDER BY n DESC, department_id) FROM t) AS top_departments
  FROM report""")
def kpi_summary(spark, folder):
    return u.kpi_summary(p.usage(spark, folder), p.report_rows(spark, folder))


@query("department_attribution", _LEAKS + """, l AS (SELECT department, count(*) AS leaks FROM (
    SELECT 'dept-' || (chat_id % 10) AS department FROM report) GROUP BY 1),
  g AS (SELECT department_id AS department, sum(cost) AS c, count(*) AS n, sum(token_count) AS t, count(*) FILTER (trivial) AS tr,
    count(*) FILTER (private) AS pr, floor(count(*) FILTER (purpose <> '') / count(*) * 100) AS pu,
    floor(count(region) / count(*) * 100) AS re FROM flagged GROUP BY 1)
  SELECT department, round(c, 4) AS cost, n AS sessions, CAST(t AS BIGINT) AS tokens, round(tr / n * 100, 2) AS trivial_percentage,
    round(pr / n * 100, 2) AS private_percentage, coalesce(leaks, 0) AS leak_count,
    CAST(round_even((pu + re + 300) / 5, 0) AS BIGINT) AS compliance_score FROM g LEFT JOIN l USING (department)""")
def department_attribution(spark, folder):
    found = p.findings(spark, folder).select(
        F.concat(F.lit("dept-"), (F.col("chat_id") % 10).cast("string")).alias("department"))
    return u.department_attribution(p.usage(spark, folder), found)


_SAVINGS = f"""WITH {USAGE}, s AS (
  SELECT 'trivial_usage' AS category, department_id AS department, model_name AS model, count(*) AS sessions, round(sum(cost), 4) AS savings
  FROM flagged WHERE trivial GROUP BY 2, 3
  UNION ALL SELECT 'private_usage', department_id, model_name, count(*), round(sum(cost), 4) FROM flagged WHERE private GROUP BY 2, 3)"""


@query("cost_recommendations", _SAVINGS + " SELECT * FROM s")
def cost_recommendations(spark, folder):
    return u.cost_recommendations(p.usage(spark, folder))


@query("savings_split", _SAVINGS + """ SELECT category, round(sum(savings), 4) AS savings,
  round(sum(savings) / (SELECT sum(savings) FROM s) * 100, 2) AS share FROM s GROUP BY 1""")
def savings_split(spark, folder):
    return u.savings_split(u.cost_recommendations(p.usage(spark, folder)))


@query("sketched_users", f"""WITH {USAGE}, r AS (SELECT min(usage_start)::DATE AS low, max(usage_start)::DATE AS high FROM usage),
  e AS (SELECT 'all' AS days, * FROM usage UNION ALL SELECT 'first week', usage.* FROM usage, r WHERE usage_start::DATE <= low + 6
    UNION ALL SELECT 'after it', usage.* FROM usage, r WHERE usage_start::DATE > low + 6)
  SELECT days, department_id, count(*) AS events, count(DISTINCT user_id_hash) AS users, true AS within FROM e GROUP BY 1, 2""")
def sketched_users(spark, folder):
    """Users per department over three ranges of days, from daily sketches stored in two batches, beside the exact counts.

    `within` says that an estimate is at most five standard errors, or one user, off.
    """
    usage, by, ids = p.usage(spark, folder), ["department_id"], ["user_id_hash"]
    halves = [usage.filter(F.pmod(F.xxhash64("id"), F.lit(2)) == n) for n in range(2)]
    first, second = (sketches.daily_sketches(half, F.col("usage_start"), by, ids) for half in halves)
    stored = materialise(sketches.merged_days(materialise(first, "sketches"), second, by, ids), "sketches")
    ends = stored.agg(F.date_add(F.min("day"), 6).cast("string").alias("week"), F.date_add(F.min("day"), 7).cast("string").alias("later")).first()
    out = None
    for name, low, high in (("all", None, None), ("first week", None, ends["week"]), ("after it", ends["later"], None)):
        estimate = sketches.distinct_counts(stored, by, ids, low, high).withColumn("days", F.lit(name))
        day = F.to_date("usage_start")
        exact = usage.filter((day >= F.lit(low or "0001-01-01").cast("date")) & (day <= F.lit(high or "9999-12-31").cast("date"))).groupBy(*by).agg(
            F.countDistinct("user_id_hash").alias("users"))
        found = estimate.join(exact, by)
        out = found if out is None else out.unionByName(found)
    close = F.abs(F.col("user_id_hash") - F.col("users")) <= F.greatest(F.lit(1.0), 5 * sketches.standard_error() * F.col("users"))
    return out.select("days", "department_id", "events", "users", close.alias("within"))
