"""Company rules and their matches, over `nation`/`region` and over `customer`/`supplier`."""

from __future__ import annotations

from pyspark.sql import functions as F

from usagelens.catalog import projections as p
from usagelens.catalog.oracle_parts import CHATS, MATCHES, RULES
from usagelens.catalog.registry import query
from usagelens.operators.rules import build_all_rules, company_matches, summarize
from usagelens.plans import security, views

_M = f"WITH {MATCHES} "


@query("company_rules", f"WITH {RULES} " + """SELECT rule_id, 'customers' AS source_table, field AS source_field,
  'customers.' || field AS label, category, severity, pattern, value FROM rules""")
def company_rules(spark, folder):
    return p.rules(spark, folder).select(
        "rule_id", "source_table", "source_field", "label", "category", "severity", "pattern", "value")


@query("company_rules_of_tables", r"""
  SELECT 'customers:' || c_custkey || ':customer_code' AS rule_id, 'secret' AS category, 'high' AS severity,
    '\bCST[\s\-_./]*' || (2000 + c_custkey) || '\b' AS pattern FROM customer
  UNION ALL SELECT 'customers:' || c_custkey || ':company_name', 'pii', 'high', '\bCustomer[\s\-_./\#]*' || substr(c_name, 10) || '\b' FROM customer
  UNION ALL SELECT 'customers:' || c_custkey || ':email', 'pii', 'critical', '\bc' || c_custkey || '[\s\-_./\@]*corp[\s\-_./\@]*example\b' FROM customer
  UNION ALL SELECT 'customers:' || c_custkey || ':segment', 'secret', 'medium', '\b\Q' || lower(c_mktsegment) || '\E\b' FROM customer
  UNION ALL SELECT 'employees:' || s_suppkey || ':employee_number', 'secret', 'high', '\bEMP[\s\-_./]*' || (1000 + s_suppkey) || '\b' FROM supplier
  UNION ALL SELECT 'employees:' || s_suppkey || ':full_name', 'pii', 'high', '\bSupplier[\s\-_./\#]*' || substr(s_name, 10) || '\b' FROM supplier
  UNION ALL SELECT 'employees:' || s_suppkey || ':department', 'secret', 'medium', '\bunit[\s\-_./]*' || s_nationkey || '\b' FROM supplier""")
def company_rules_of_tables(spark, folder):
    rules = build_all_rules(p.company_tables(spark, folder))
    return rules.filter("source_field <> 'annual_contract_value_eur'").select("rule_id", "category", "severity", "pattern")


@query("rule_matches", _M + """SELECT source_file, conversation_key, message_id, rule_id AS company_rule_id, matched_text, department,
  provider, severity, category AS company_category FROM matches""")
def rule_matches(spark, folder):
    found = company_matches(p.chat_context(spark, folder), p.rules(spark, folder), p.RUN_ID, rule_config=p.COMPANY_RULES)
    return found.select("source_file", "conversation_key", "message_id", "company_rule_id", "matched_text", "department",
                        "provider", "severity", "company_category")


#: Each rule with two literals that a match must hold; texts and rules then meet by the expression.
_TABLE_MATCHES = f"WITH {CHATS}" + r""", v AS (SELECT c_custkey, regexp_replace(CAST(CAST(c_acctbal AS DECIMAL(12, 2)) AS VARCHAR), '\.0+$', '') AS v FROM customer),
  r(tbl, field, rule_id, pattern, one, two) AS (
    SELECT 'customers', 'customer_code', c_custkey, '\bCST[\s\-_./]*' || (2000 + c_custkey) || '\b', 'cst', CAST(2000 + c_custkey AS VARCHAR) FROM customer
    UNION ALL SELECT 'customers', 'company_name', c_custkey, '\bCustomer[\s\-_./#]*' || substr(c_name, 10) || '\b', 'customer', substr(c_name, 10) FROM customer
    UNION ALL SELECT 'customers', 'email', c_custkey, '\bc' || c_custkey || '[\s\-_./@]*corp[\s\-_./@]*example\b', 'corp', 'c' || c_custkey FROM customer
    UNION ALL SELECT 'customers', 'segment', c_custkey, '\b\Q' || lower(c_mktsegment) || '\E\b', lower(c_mktsegment), '' FROM customer
    UNION ALL SELECT 'customers', 'annual_contract_value_eur', c_custkey, CASE WHEN regexp_matches(v, '^[0-9]+$') THEN
        CASE WHEN length(v) >= 4 THEN '\b' || array_to_string(string_split(v, ''), '[\s,._-]*') || '\b' ELSE '\b' || v || '\b' END
      WHEN contains(v, '.') THEN '\b' || array_to_string(regexp_extract_all(v, '[0-9]+'), '[\s\-_./]*') || '\b' ELSE '\b\Q' || v || '\E\b' END,
      CASE WHEN regexp_matches(v, '^[0-9]+$') THEN v[1] ELSE regexp_extract(v, '[0-9]+') END, regexp_extract(v, '[0-9]$') FROM v
    UNION ALL SELECT 'employees', 'employee_number', s_suppkey, '\bEMP[\s\-_./]*' || (1000 + s_suppkey) || '\b', 'emp', CAST(1000 + s_suppkey AS VARCHAR) FROM supplier
    UNION ALL SELECT 'employees', 'full_name', s_suppkey, '\bSupplier[\s\-_./#]*' || substr(s_name, 10) || '\b', 'supplier', substr(s_name, 10) FROM supplier
    UNION ALL SELECT 'employees', 'department', s_suppkey, '\bunit[\s\-_./]*' || s_nationkey || '\b', 'unit', CAST(s_nationkey AS VARCHAR) FROM supplier),
  t AS (SELECT message_id, translate(user_text_clean, 'ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü', '_____________________') AS x FROM chats),
  d AS (SELECT DISTINCT pattern, one, two FROM r),
  h AS (SELECT message_id, pattern, list_distinct(regexp_extract_all(x, '(?i)' || pattern)) AS ms FROM t JOIN d ON contains(lower(x), one) AND contains(lower(x), two))
  SELECT tbl AS company_source_table, field AS company_source_field, CAST(sum(len(ms)) AS BIGINT) AS match_count, count(DISTINCT rule_id) AS rules
  FROM r JOIN h USING (pattern) WHERE len(ms) > 0 GROUP BY 1, 2"""


@query("table_rule_matches", _TABLE_MATCHES)
def table_rule_matches(spark, folder):
    """All rules of whole `customer` and `supplier` tables over all messages."""
    rules = p.stage(spark, folder, "table_rules", lambda: build_all_rules(p.company_tables(spark, folder)))
    found = company_matches(p.chat_context(spark, folder), rules, p.RUN_ID)
    return found.groupBy("company_source_table", "company_source_field").agg(
        F.count("*").alias("match_count"), F.countDistinct("company_rule_id").alias("rules"))


@query("rule_stats", _M + """SELECT r.rule_id, r.field AS source_field, r.category AS rule_category, r.severity AS rule_severity,
  count(m.rule_id) AS match_count, count(DISTINCT m.conversation_key) AS affected_conversations,
  strftime(max(m.ts), '%Y-%m-%d %H:%M:%S') AS last_match_at FROM rules r LEFT JOIN matches m USING (rule_id) GROUP BY 1, 2, 3, 4""")
def rule_stats(spark, folder):
    return views.rule_stats(p.rules(spark, folder), p.matches(spark, folder)).drop("source_table", "label")


@query("match_overview", _M + """SELECT count(*) AS total_matches, count(DISTINCT conversation_key) AS affected_conversations,
  count(DISTINCT provider) AS total_providers, count(DISTINCT category) AS total_categories, 0 AS critical_matches,
  count(*) FILTER (severity = 'high') AS high_matches, count(*) FILTER (severity = 'medium') AS medium_matches, 0 AS low_matches,
  count(*) FILTER (category = 'pii') AS pii_matches, count(*) FILTER (category = 'secret') AS secret_matches,
  0 AS financial_matches, '2024-02-01 00:00:00' AS last_analysis_run FROM matches""")
def match_overview(spark, folder):
    return views.match_overview(p.matches(spark, folder), p.runs(spark, folder))


@query("matches_by_category", _M + """SELECT category, severity, provider, model_name, 'customers' AS company_source_table,
  field AS company_source_field, count(*) AS match_count, count(DISTINCT conversation_key) AS affected_conversations
  FROM matches GROUP BY ALL""")
def matches_by_category(spark, folder):
    return views.matches_by_category(p.matches(spark, folder), p.runs(spark, folder))


_CONV = """SELECT conversation_key, max(conversation_title) AS conversation_title, max(provider) AS provider, max(model_name) AS model_name,
  max(department) AS department, count(*) AS match_count, count(*) FILTER (category = 'secret') AS secret_count,
  count(*) FILTER (category = 'pii') AS pii_count, 0 AS financial_count, 0 AS critical_count, count(*) FILTER (severity = 'high') AS high_count,
  CASE WHEN count(*) FILTER (severity = 'high') > 0 THEN 'high' ELSE 'medium' END AS highest_severity,
  strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_match_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_match_at,
  string_agg(DISTINCT 'customers.' || field, ',' ORDER BY 'customers.' || field) AS labels,
  '2024-02-01 00:00:00' AS analysis_run_at FROM matches GROUP BY 1"""


@query("match_conversations", _M + _CONV)
def match_conversations(spark, folder):
    return views.match_conversations(p.matches(spark, folder), p.runs(spark, folder))


@query("conversations_page", _M + f"SELECT * FROM ({_CONV}) WHERE highest_severity = 'high' ORDER BY match_count DESC, conversation_key LIMIT 10 OFFSET 5")
def conversations_page(spark, folder):
    rows = views.match_conversations(p.matches(spark, folder), p.runs(spark, folder))
    return views.conversations_page(rows, limit=10, offset=5, highest_severity="high")


@query("conversation_findings", _M + f"""SELECT conversation_key || ':summary' AS id,
  CASE WHEN secret_count > 0 THEN 'secret' ELSE 'pii' END AS type, highest_severity AS severity, split_part(labels, ',', 1) AS category,
  model_name AS model, provider, conversation_key AS conversation_id, match_count, secret_count, pii_count, department,
  conversation_title, last_match_at AS timestamp FROM ({_CONV})""")
def conversation_findings(spark, folder):
    return views.conversation_findings(views.match_conversations(p.matches(spark, folder), p.runs(spark, folder)))


@query("conversation_summaries", _M + """SELECT conversation_key, count(*) AS match_count, count(*) FILTER (category = 'secret') AS secret_count,
  count(*) FILTER (category = 'pii') AS pii_count, 0 AS financial_count,
  string_agg(DISTINCT 'customers.' || field, ',' ORDER BY 'customers.' || field) AS labels,
  CASE WHEN count(*) FILTER (severity = 'high') > 0 THEN 'high' ELSE 'medium' END AS highest_severity,
  arg_min(provider, (ts IS NOT NULL, ts, message_id)) AS provider FROM matches GROUP BY 1""")
def conversation_summaries(spark, folder):
    return summarize(p.matches(spark, folder)).select(
        "conversation_key", "match_count", "secret_count", "pii_count", "financial_count", "labels", "highest_severity",
        "provider")


@query("department_stats", _M + """SELECT coalesce(department, 'unknown') AS department, provider, count(*) AS match_count,
  0 AS critical_count, count(*) FILTER (severity = 'high') AS high_count, count(*) FILTER (category = 'pii') AS pii_count,
  count(*) FILTER (category = 'secret') AS secret_count, count(DISTINCT conversation_key) AS conversation_count
  FROM matches GROUP BY 1, 2""")
def department_stats(spark, folder):
    return views.match_departments(p.matches(spark, folder), p.runs(spark, folder))


_TIMELINE = """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, category, severity, provider, count(*) AS match_count,
  count(DISTINCT conversation_key) AS conversation_count FROM matches WHERE ts IS NOT NULL"""


@query("match_timeline", _M + _TIMELINE + " GROUP BY 1, 2, 3, 4")
def match_timeline(spark, folder):
    return views.match_timeline(p.matches(spark, folder), p.runs(spark, folder))


@query("timeline_window", _M + _TIMELINE + " AND category = 'pii' AND CAST(ts AS DATE) >= DATE '2024-01-18' GROUP BY 1, 2, 3, 4")
def timeline_window(spark, folder):
    rows = views.match_timeline(p.matches(spark, folder), p.runs(spark, folder))
    return views.timeline_window(rows, F.lit("2024-02-01").cast("date"), 14, "pii")


@query("top_matches", _M + """SELECT conversation_key, message_id, rule_id AS rule, matched_text, severity FROM (
  SELECT *, substr(sha1(concat_ws('|', 'run-1', source_file, conversation_key, message_id, rule_id, matched_text)), 1, 20) AS id
  FROM matches WHERE severity = 'high') ORDER BY ts DESC NULLS LAST, id LIMIT 100""")
def top_matches(spark, folder):
    found = p.matches(spark, folder)
    top = views.top_matches(found, p.runs(spark, folder))
    return top.join(found.select("id", F.col("company_rule_id").alias("rule")), "id").select(
        "conversation_key", "message_id", "rule", "matched_text", "severity")


@query("match_leak_counts", _M + """SELECT CASE WHEN model_name LIKE 'gpt%' THEN 'chatgpt' WHEN model_name LIKE 'claude%' THEN 'anthropic'
  WHEN model_name LIKE 'gemini%' THEN 'gemini' ELSE 'mistral' END AS model,
  CASE WHEN category = 'pii' THEN 'pii' ELSE 'secret' END AS category, count(*) AS leak_count FROM matches GROUP BY 1, 2""")
def match_leak_counts(spark, folder):
    return security.leak_counts(security.from_matches(p.matches(spark, folder), F.lit(p.AS_OF).cast("timestamp")))
