"""Reports over findings: distributions, leaks, duplicates, patterns in time, feeds.

A report finding has: id, type, severity, category, model, provider,
conversation_id, message_id, role, timestamp, match_value, match_context,
department, status, notes, confidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens import config
from usagelens.functions.text import fabrication_flags, model_family, severity_rank
from usagelens.operators.detect import finding_type
from usagelens.plans.filters import ReportFilters, filter_findings

LEAK_TYPES = ("secret", "pii", "slopsquat")


def report_findings(findings: DataFrame, chats: DataFrame, department: Column | None = None) -> DataFrame:
    """Detector findings with their message's columns, in the report shape."""
    context_columns = chats.select(
        "chat_id", "conversation_key", "message_id", "role", "provider", "model_name",
        F.coalesce("message_timestamp", "conversation_timestamp").alias("timestamp"),
        (department if department is not None else F.lit(None).cast("string")).alias("department"))
    joined = findings.join(context_columns, "chat_id")
    return joined.select(
        F.col("finding_id").alias("id"), finding_type(F.col("analyzer")).alias("type"), "severity", "category",
        model_family(F.coalesce("model_name", "provider")).alias("model"),
        model_family(F.col("provider")).alias("provider"), F.col("conversation_key").alias("conversation_id"),
        "message_id", "role", "timestamp", F.col("matched_text").alias("match_value"), "match_hash",
        F.col("snippet").alias("match_context"), "department", F.lit("open").alias("status"),
        F.lit(None).cast("string").alias("notes"), "confidence")


def from_matches(matches: DataFrame, as_of: Column) -> DataFrame:
    """Company matches in the report shape; a missing message time becomes `as_of`."""
    return matches.select(
        "id", F.when(F.col("company_category") == "pii", "pii").otherwise("secret").alias("type"), "severity",
        F.col("company_category").alias("category"), model_family(F.coalesce("model_name", "provider")).alias("model"),
        model_family(F.col("provider")).alias("provider"), F.col("conversation_key").alias("conversation_id"),
        "message_id", "role", F.coalesce("message_timestamp", as_of).alias("timestamp"),
        F.col("matched_text").alias("match_value"), F.sha2("matched_text", 256).alias("match_hash"), "match_context", "department", F.lit("open").alias("status"),
        F.lit(None).cast("string").alias("notes"), "confidence")


def with_status(findings: DataFrame, status_log: DataFrame) -> DataFrame:
    """Overlay the latest status and notes per finding; findings without an entry stay open."""
    latest = status_log.groupBy(F.col("finding_id").alias("id")).agg(
        F.max_by(F.struct("status", "notes"), F.struct("changed_at", "status")).alias("s"))
    return findings.drop("status", "notes").join(latest, "id", "left").withColumns({
        "status": F.coalesce("s.status", F.lit("open")), "notes": F.col("s.notes")}).drop("s")


def audit_trail(status_log: DataFrame, finding_id: str | None = None) -> DataFrame:
    rows = status_log if finding_id is None else status_log.filter(F.col("finding_id") == finding_id)
    return rows.orderBy("changed_at", "finding_id", "status")


# ------------------------------------------------------------ distributions
def severity_distribution(findings: DataFrame) -> DataFrame:
    """Counts per type and severity; every type and severity is present."""
    counts = findings.groupBy("type").agg(*[
        F.count_if(F.col("severity") == s).alias(s) for s in config.SEVERITIES])
    kinds = findings.sparkSession.sql("SELECT * FROM VALUES ('secret'), ('pii'), ('slopsquat') AS t(type)")
    return kinds.join(counts, "type", "left").na.fill(0)


def severity_totals(findings: DataFrame) -> DataFrame:
    return findings.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in config.SEVERITIES])


def leak_counts(findings: DataFrame, filters: ReportFilters | None = None) -> DataFrame:
    rows = findings.filter(F.col("type").isin(*LEAK_TYPES))
    if filters and filters.model:
        wanted = filters.model.lower()
        rows = rows.filter((F.col("model") == wanted) | (F.col("provider") == wanted))
    if filters and filters.category:
        rows = rows.filter(F.col("type") == filters.category)
    return rows.groupBy("model", F.col("type").alias("category")).agg(
        F.count("*").alias("leak_count")).orderBy(F.desc("leak_count"), "model", "category")


def slopsquat_stats(findings: DataFrame, usage: DataFrame, dimension: str = "model") -> DataFrame:
    """Invented names per model, provider or department, per 1000 sessions and by kind."""
    key = {"department": F.coalesce("department", F.lit("unknown")), "provider": F.col("provider")}.get(
        dimension, F.col("model"))
    kinds = [F.count_if(flag).alias(kind) for kind, flag in fabrication_flags(F.col("match_value")).items()]
    sessions = usage.agg(F.greatest(F.count("*"), F.lit(1)).alias("n")).scalar()
    return findings.filter(F.col("type") == "slopsquat").groupBy(key.alias("key")).agg(
        F.count("*").alias("halluc_count"), *kinds).select(
        "key", "halluc_count", F.round(F.col("halluc_count") * 1000 / sessions, 2).alias("halluc_rate"),
        *config.FABRICATION_KEYWORDS)


def duplicate_secrets(findings: DataFrame, min_providers: int = 2, min_users: int = 0) -> DataFrame:
    """Secrets seen at several providers.

    Rows collapse to (value, provider, conversation, message, department)
    before the distinct counts, so one value in very many rows is no hot group.
    """
    secrets = findings.filter(F.col("type") == "secret").select(
        F.col("match_hash").alias("secret_hash"), "category", "provider", "conversation_id", "message_id",
        "department", "timestamp")
    small = secrets.groupBy(
        "secret_hash", "provider", "conversation_id", "message_id", "department").agg(
        F.min("category").alias("category"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    return small.groupBy("secret_hash").agg(
        F.min("category").alias("category"), F.min("first").alias("first_detected"),
        F.max("last").alias("last_detected"), F.countDistinct("provider").alias("providers"),
        F.countDistinct("conversation_id").alias("affected_users"),
        F.countDistinct("message_id").alias("affected_sessions"),
        F.array_sort(F.collect_set("department")).alias("departments"), F.lit("critical").alias("severity")).filter(
        (F.col("providers") >= min_providers) & (F.col("affected_users") >= min_users)).orderBy(
        F.desc("affected_users"), "first_detected", "secret_hash")


def findings_series(findings: DataFrame, granularity: str = "day") -> DataFrame:
    return findings.groupBy(F.date_trunc(granularity, "timestamp").alias("bucket")).agg(
        F.count("*").cast("double").alias("value")).orderBy("bucket")


def hourly_pattern(findings: DataFrame) -> DataFrame:
    return findings.groupBy(F.hour("timestamp").alias("hour")).agg(
        F.count("*").alias("leak_count"), F.count_if(F.col("severity") == "critical").alias("critical_count"))


def weekday_pattern(findings: DataFrame) -> DataFrame:
    return findings.groupBy(F.date_format("timestamp", "EEEE").alias("day_of_week")).agg(
        F.count("*").alias("leak_count"))


# ------------------------------------------------------------ feeds and pages
def findings_page(findings: DataFrame, filters: ReportFilters = ReportFilters()) -> DataFrame:
    """One page, newest first, after all filters; ties are broken by id."""
    rows = filter_findings(findings, filters).orderBy(F.desc("timestamp"), "id")
    return rows.offset(filters.offset).limit(filters.limit)


def findings_total(findings: DataFrame, filters: ReportFilters = ReportFilters()) -> DataFrame:
    return filter_findings(findings, filters).agg(F.count("*").alias("total"))


def finding_payload(findings: DataFrame) -> DataFrame:
    return findings.select(
        "id", "type", "severity", "category", "model", "provider", "conversation_id", "message_id", "role",
        F.col("timestamp").alias("detected_at"), "match_value", F.col("match_context").alias("context_preview"),
        "status", "department", "confidence")


def finding_detail(findings: DataFrame, finding_id: str) -> DataFrame:
    one = findings.filter(F.col("id") == finding_id)
    none = F.array().cast("array<string>")
    return finding_payload(one).withColumns({
        "full_context": F.col("context_preview"), "remediation_history": none, "related_findings": none,
        "duplicate_count": F.lit(1)})


def alert_payload(findings: DataFrame) -> DataFrame:
    return findings.select(
        "id", "type", "severity", F.concat(F.initcap("type"), F.lit(" finding")).alias("title"),
        F.col("match_context").alias("message"), "timestamp",
        F.coalesce(F.nullif("department", F.lit("")), F.lit("unknown")).alias("department"), "provider",
        "conversation_id", "status", F.concat(F.lit("/dashboard/findings/"), "id").alias("action_url"))


def alerts(findings: DataFrame, filters: ReportFilters = ReportFilters()) -> DataFrame:
    """The newest findings as alerts."""
    rows = filter_findings(findings, filters).orderBy(F.desc("timestamp"), "id").limit(filters.limit)
    return alert_payload(rows)


def alert_stats(alerts_frame: DataFrame) -> DataFrame:
    """Alert counts per severity and status."""
    return alerts_frame.groupBy("severity", "status").agg(F.count("*").alias("alert_count"))


def recent_leaks(findings: DataFrame, limit: int = 20) -> DataFrame:
    """The newest secret and personal-data findings."""
    return findings.filter(F.col("type").isin("secret", "pii")).orderBy(
        F.desc("timestamp"), "id").limit(limit)


def merge_feed(feed: DataFrame, arrivals: DataFrame, keep: int = 25) -> DataFrame:
    """New alerts in front of the feed, each id once, cut to `keep`."""
    both = arrivals.withColumn("_new", F.lit(1)).unionByName(feed.withColumn("_new", F.lit(0)))
    columns = [c for c in both.columns if c not in ("id", "_new")]
    one = both.groupBy("id").agg(F.min("_new").alias("_new"), F.min_by(F.struct(*columns), "_new").alias("r"))
    return one.select("id", "r.*", "_new").orderBy(F.desc("_new"), F.desc("timestamp"), "id").limit(keep).drop("_new")


def sort_findings(findings: DataFrame, column: str = "timestamp", descending: bool = True) -> DataFrame:
    key = severity_rank(F.col("severity")) if column == "severity" else F.col(column)
    return findings.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_first(), "id")


# ------------------------------------------------------ analyst summaries
def findings_summary(findings: DataFrame, analyzer: str | None = None, limit: int = 50) -> DataFrame:
    """Counts by analyzer, category and severity of detector findings, largest first."""
    rows = findings if analyzer is None else findings.filter(F.col("analyzer") == analyzer)
    return rows.groupBy("analyzer", "category", "severity").agg(F.count("*").alias("finding_count")).orderBy(
        F.desc("finding_count"), "analyzer", "category", "severity").limit(limit)


def provider_risk(findings: DataFrame, by: str = "provider", limit: int | None = None) -> DataFrame:
    """Totals and counts per severity, most critical first; all groups unless a limit is given."""
    ranked = findings.groupBy(by).agg(
        F.count("*").alias("total"), *[F.count_if(F.col("severity") == s).alias(s) for s in config.SEVERITIES]).orderBy(
        F.desc("critical"), F.desc("high"), by)
    return ranked.limit(limit) if limit else ranked


def top_entities(messages: DataFrame, text_col: str, kinds: dict[str, str], limit: int = 20) -> DataFrame:
    """The most frequent values per entity kind, each kind given as an expression with one group."""
    found = F.array(*[F.struct(F.lit(kind).alias("kind"), F.regexp_extract_all(
        F.col(text_col), F.lit("(?U)" + pattern), F.lit(1)).alias("v")) for kind, pattern in kinds.items()])
    rows = messages.select(F.inline(found)).select("kind", F.explode("v").alias("entity"))
    return rows.groupBy("kind", F.lower("entity").alias("entity")).agg(F.count("*").alias("mentions")).orderBy(
        F.desc("mentions"), "kind", "entity").limit(limit)


def context_exposure(messages: DataFrame, session_col: str, text_col: str, weights: dict[str, int]) -> DataFrame:
    """Exposure score per session: weights of the file types its texts mention."""
    endings = "|".join(weights)
    files = messages.select(session_col, F.explode(F.regexp_extract_all(
        F.lower(F.col(text_col)), F.lit(rf"[a-z0-9_-]+\.({endings})\b"), F.lit(1))).alias("ending"))
    return files.groupBy(session_col).pivot("ending", list(weights)).count().na.fill(0).select(
        session_col, *weights, sum((F.col(e) * F.lit(w) for e, w in weights.items()), F.lit(0)).alias("score"))


def top_packages(findings: DataFrame, limit: int = 10) -> DataFrame:
    """The package names suggested most often."""
    return findings.filter(F.col("type") == "slopsquat").groupBy(F.lower("match_value").alias("package")).agg(
        F.count("*").alias("mentions")).orderBy(F.desc("mentions"), "package").limit(limit)
