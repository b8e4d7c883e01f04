"""Table schemas as DDL strings (usable with `spark.read.schema` and `CREATE TABLE`)."""

from __future__ import annotations

from pyspark.sql import SparkSession

CHATS = (
    "source_file STRING, source_format STRING, provider STRING, conversation_key STRING, "
    "conversation_title STRING, conversation_slug STRING, export_author STRING, model_name STRING, "
    "conversation_timestamp TIMESTAMP, message_id STRING, parent_message_id STRING, message_index INT, "
    "message_timestamp TIMESTAMP, author STRING, role STRING, language STRING, user_text STRING, "
    "user_text_clean STRING, user_text_hash STRING, metadata STRING"
)
FINDINGS = (
    "finding_id STRING, run_id STRING, chat_id STRING, analyzer STRING, pattern STRING, category STRING, "
    "severity STRING, title STRING, detail STRING, start INT, matched_text STRING, match_hash STRING, snippet STRING, "
    "confidence DOUBLE, created_at TIMESTAMP"
)
RULES = (
    "rule_id STRING, source_table STRING, source_record_id STRING, source_field STRING, label STRING, "
    "category STRING, severity STRING, pattern STRING, value STRING, active BOOLEAN"
)
MATCHES = (
    "id STRING, analysis_run_id STRING, department STRING, source_file STRING, conversation_key STRING, "
    "conversation_title STRING, provider STRING, model_name STRING, message_id STRING, "
    "message_timestamp TIMESTAMP, author STRING, role STRING, source_field STRING, company_rule_id STRING, "
    "company_label STRING, company_category STRING, company_source_table STRING, "
    "company_source_field STRING, start INT, matched_text STRING, match_context STRING, severity STRING, "
    "confidence DOUBLE, created_at TIMESTAMP"
)
RUNS = (
    "id STRING, source_message_count BIGINT, rule_count BIGINT, match_count BIGINT, status STRING, "
    "notes STRING, created_at TIMESTAMP, completed_at TIMESTAMP"
)
SUMMARIES = (
    "analysis_run_id STRING, conversation_key STRING, department STRING, provider STRING, model_name STRING, "
    "match_count BIGINT, secret_count BIGINT, pii_count BIGINT, financial_count BIGINT, "
    "labels ARRAY<STRING>, highest_severity STRING"
)
INSIGHTS = "chat_id STRING, risk_score INT, risk_factors ARRAY<STRING>, summary STRING, created_at TIMESTAMP"
RECOMMENDATIONS = (
    "category STRING, title STRING, description STRING, impact_score INT, target_audience STRING, "
    "status STRING, created_at TIMESTAMP"
)
PACKAGES = (
    "name STRING, ecosystem STRING, downloads BIGINT, dependent_packages_count BIGINT, "
    "description STRING, repository_url STRING"
)
USAGE = (
    "id STRING, user_id_hash STRING, department_id STRING, tool_name STRING, model_name STRING, "
    "usage_start TIMESTAMP, usage_end TIMESTAMP, token_count BIGINT, cost DOUBLE, purpose STRING, region STRING"
)
# What a usage log line holds before defaults are applied.
USAGE_RAW = (
    "id STRING, user_id_hash STRING, department_id STRING, tool_name STRING, model_name STRING, "
    "usage_start STRING, usage_end STRING, token_count BIGINT, cost DOUBLE, purpose STRING, region STRING"
)
FINDING_STATUS = "finding_id STRING, status STRING, notes STRING, changed_at TIMESTAMP"

TABLES = {
    "chats": CHATS, "findings": FINDINGS, "company_rules": RULES, "company_matches": MATCHES,
    "analysis_runs": RUNS, "conversation_summaries": SUMMARIES, "conversation_insights": INSIGHTS,
    "system_recommendations": RECOMMENDATIONS, "popular_packages": PACKAGES, "tools_usage": USAGE,
    "finding_status": FINDING_STATUS,
}

#: (keys, order) of the tables whose rows are upserted; of several rows of a key the latest write and the greatest order win.
KEYS = {
    "company_rules": (("rule_id",), ()),
    "company_matches": (("analysis_run_id", "source_file", "conversation_key", "message_id", "company_rule_id", "matched_text"), ("start",)),
    "conversation_summaries": (("analysis_run_id", "conversation_key"), ()),
    "analysis_runs": (("id",), ()),
    "popular_packages": (("ecosystem", "name"), ()),
}


def create_tables(spark: SparkSession, database: str | None = None) -> list[str]:
    """Create every table that does not exist yet; safe to call repeatedly."""
    created = []
    for name, ddl in TABLES.items():
        full = f"{database}.{name}" if database else name
        spark.sql(f"CREATE TABLE IF NOT EXISTS {full} ({ddl}) USING parquet")
        created.append(full)
    return created
