"""Pre-aggregated views over messages, findings, insights, company rules and matches.

Every view first brings findings and insights to message grain, so a message
with many findings neither counts nor weighs more than once.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.functions.text import severity_name, severity_rank

HIGH = ("critical", "high")


# ------------------------------------------------------------ detector views
def per_message(findings: DataFrame) -> DataFrame:
    def of(category):
        return F.count_if(F.col("category") == category)

    complexity = F.when(F.col("analyzer") == "llm_complexity", F.try_variant_get(
        F.try_parse_json("meta"), "$.complexity_score", "double")) if "meta" in findings.columns \
        else F.lit(None).cast("double")
    return findings.groupBy("chat_id").agg(
        F.count("*").alias("findings"),
        *[F.count_if(F.col("severity") == s).alias(f"{s}_findings") for s in ("critical", "high", "medium", "low")],
        of("security_leak").alias("security_leaks"), of("content_leak").alias("content_leaks"),
        of("supply_chain").alias("supply_chain_findings"), of("usage_quality").alias("trivial_usage"),
        F.sum(complexity).alias("complexity_sum"), F.count(complexity).alias("complexity_n"))


def overview(chats: DataFrame, findings: DataFrame, insights: DataFrame) -> DataFrame:
    """One row over everything; averages are per message with an insight."""
    per = per_message(findings).select("chat_id", "findings", *[
        f"{s}_findings" for s in ("critical", "high", "medium", "low")])
    risk = insights.groupBy("chat_id").agg(F.sum("risk_score").alias("risk"), F.count("risk_score").alias("risks"))
    joined = chats.select("chat_id", "conversation_key", "provider").join(per, "chat_id", "left").join(
        risk, "chat_id", "left")
    # Conversations are folded per provider first: the distinct counts then run over few rows.
    small = joined.groupBy("conversation_key", "provider").agg(
        F.count("*").alias("m"), F.sum("findings").alias("f"),
        *[F.sum(f"{s}_findings").alias(s) for s in ("critical", "high", "medium", "low")],
        F.count_if(F.col("findings") > 0).alias("a"), F.sum("risk").alias("risk"), F.sum("risks").alias("risks"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return small.agg(
        total("m").alias("total_messages"), F.countDistinct("conversation_key").alias("total_conversations"),
        F.countDistinct("provider").alias("total_providers"), total("f").alias("total_findings"),
        *[total(s).alias(f"{s}_findings") for s in ("critical", "high", "medium", "low")],
        total("a").alias("analyzed_messages"), (total("m") - total("a")).alias("pending_messages"),
        F.round(F.sum("risk") / F.sum("risks"), 4).alias("average_risk_score"))


def findings_by_category(chats: DataFrame, findings: DataFrame) -> DataFrame:
    # Fold findings per message before the join: fewer rows meet the messages.
    per = findings.groupBy("chat_id", "category", "severity", "analyzer").agg(F.count("*").alias("n"))
    return per.join(chats.select("chat_id", "provider", "model_name"), "chat_id").groupBy(
        "category", "severity", "analyzer", "provider", "model_name").agg(F.sum("n").alias("finding_count"))


def provider_stats(chats: DataFrame, findings: DataFrame) -> DataFrame:
    joined = chats.select("chat_id", "conversation_key", "provider", "model_name").join(
        per_message(findings), "chat_id", "left")
    sums = ("security_leaks", "content_leaks", "supply_chain_findings", "trivial_usage")
    small = joined.groupBy("provider", "model_name", "conversation_key").agg(
        F.count("*").alias("m"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums],
        F.sum("complexity_sum").alias("cs"), F.sum("complexity_n").alias("cn"))
    return small.groupBy("provider", "model_name").agg(
        F.sum("m").alias("message_count"), F.count("*").alias("conversation_count"),
        *[F.sum(c).alias(c) for c in sums], F.round(F.sum("cs") / F.nullif(F.sum("cn"), F.lit(0)), 4).alias("avg_complexity"))


def findings_timeline(chats: DataFrame, findings: DataFrame) -> DataFrame:
    per = findings.groupBy("chat_id", "category", "severity").agg(F.count("*").alias("n"))
    days = chats.filter(F.col("conversation_timestamp").isNotNull()).select(
        "chat_id", F.to_date("conversation_timestamp").alias("day"))
    return per.join(days, "chat_id").groupBy("day", "category", "severity").agg(F.sum("n").alias("finding_count"))


def top_findings(chats: DataFrame, findings: DataFrame, n: int = 100) -> DataFrame:
    """The newest critical and high findings; the n rows are chosen before messages are joined."""
    top = findings.filter(F.col("severity").isin(*HIGH)).orderBy(F.desc("created_at"), "finding_id").limit(n)
    context = chats.select("chat_id", "provider", "model_name", "conversation_title", "author", "conversation_timestamp")
    return context.join(F.broadcast(top), "chat_id").select(
        "finding_id", "analyzer", "category", "severity", "title", "detail", "snippet", "confidence", "created_at",
        "provider", "model_name", "conversation_title", "author", "conversation_timestamp").orderBy(
        F.desc("created_at"), "finding_id")


def conversation_scatter(chats: DataFrame, findings: DataFrame) -> DataFrame:
    """Conversations of more than one message: size, complexity and leaks."""
    joined = chats.select(
        "chat_id", "conversation_key", "provider", "model_name", F.length("user_text_clean").alias("chars")).join(
        per_message(findings), "chat_id", "left")
    return joined.groupBy("conversation_key", "provider", "model_name").agg(
        F.count("*").alias("message_count"),
        F.round(F.sum("complexity_sum") / F.nullif(F.sum("complexity_n"), F.lit(0)), 4).alias("avg_complexity"),
        (F.coalesce(F.sum("security_leaks"), F.lit(0)) + F.coalesce(F.sum("content_leaks"), F.lit(0))).alias("leak_count"),
        F.sum("chars").alias("total_chars")).filter(F.col("message_count") > 1)


# --------------------------------------------------------------- match views
def completed(matches: DataFrame, runs: DataFrame) -> DataFrame:
    """Matches of completed runs with the run's time; runs are few, one row per analysis."""
    done = runs.filter(F.col("status") == "completed").select(
        F.col("id").alias("analysis_run_id"), F.col("completed_at").alias("analysis_run_at"))
    return matches.join(done, "analysis_run_id")


def _severity_counts(names=("critical", "high", "medium", "low"), suffix="_matches") -> list[Column]:
    return [F.count_if(F.col("severity") == s).alias(f"{s}{suffix}") for s in names]


def _category_counts(names=("pii", "secret", "financial"), suffix="_matches") -> list[Column]:
    return [F.count_if(F.col("company_category") == c).alias(f"{c}{suffix}") for c in names]


def match_overview(matches: DataFrame, runs: DataFrame) -> DataFrame:
    """One row even when nothing matched; the run time comes from the run log."""
    rows = completed(matches, runs)
    last = runs.filter(F.col("status") == "completed").agg(F.max("completed_at").alias("t")).scalar()
    small = rows.groupBy("conversation_key", "provider", "company_category").agg(
        F.count("*").alias("m"), *_severity_counts())
    return small.agg(
        F.coalesce(F.sum("m"), F.lit(0)).alias("total_matches"),
        F.countDistinct("conversation_key").alias("affected_conversations"),
        F.countDistinct("provider").alias("total_providers"), F.countDistinct("company_category").alias("total_categories"),
        *[F.coalesce(F.sum(f"{s}_matches"), F.lit(0)).alias(f"{s}_matches") for s in ("critical", "high", "medium", "low")],
        *[F.coalesce(F.sum(F.when(F.col("company_category") == c, F.col("m"))), F.lit(0)).alias(f"{c}_matches")
          for c in ("pii", "secret", "financial")]).withColumn("last_analysis_run", last)


def _with_conversations(rows: DataFrame, keys: list, counts: list[Column], count_name: str) -> DataFrame:
    """Counts per key plus distinct conversations, folding by conversation first."""
    names = [k if isinstance(k, str) else k[0] for k in keys]
    columns = [F.col(k) if isinstance(k, str) else k[1].alias(k[0]) for k in keys]
    small = rows.groupBy(*columns, "conversation_key").agg(F.count("*").alias("match_count"), *counts)
    sums = [c for c in small.columns if c not in (*names, "conversation_key")]
    return small.groupBy(*names).agg(*[F.sum(c).alias(c) for c in sums], F.count("*").alias(count_name))


def matches_by_category(matches: DataFrame, runs: DataFrame) -> DataFrame:
    return _with_conversations(
        completed(matches, runs), [("category", F.col("company_category")), "severity", "provider", "model_name",
                                   "company_source_table", "company_source_field"], [], "affected_conversations")


def match_conversations(matches: DataFrame, runs: DataFrame) -> DataFrame:
    """Per conversation: counts, highest severity by rank, first and last match, labels."""
    return completed(matches, runs).groupBy("conversation_key").agg(
        F.max("conversation_title").alias("conversation_title"), F.max("provider").alias("provider"),
        F.max("model_name").alias("model_name"), F.max("department").alias("department"),
        F.count("*").alias("match_count"), *_category_counts(("secret", "pii", "financial"), "_count"),
        *_severity_counts(HIGH, "_count"),
        severity_name(F.max(severity_rank(F.col("severity")))).alias("highest_severity"),
        F.min("message_timestamp").alias("first_match_at"), F.max("message_timestamp").alias("last_match_at"),
        F.array_sort(F.collect_set("company_label")).alias("labels"), F.max("analysis_run_at").alias("analysis_run_at"))


def match_departments(matches: DataFrame, runs: DataFrame) -> DataFrame:
    return _with_conversations(
        completed(matches, runs), [("department", F.coalesce("department", F.lit("unknown"))), "provider"],
        [*_severity_counts(HIGH, "_count"), *_category_counts(("pii", "secret"), "_count")], "conversation_count")


def match_timeline(matches: DataFrame, runs: DataFrame) -> DataFrame:
    rows = completed(matches, runs).filter(F.col("message_timestamp").isNotNull())
    return _with_conversations(
        rows, [("day", F.to_date("message_timestamp")), ("category", F.col("company_category")), "severity",
               "provider"], [], "conversation_count")


def timeline_window(timeline: DataFrame, as_of: Column, days: int = 30, category: str | None = None) -> DataFrame:
    """The last `days` days before `as_of`, newest first."""
    rows = timeline.filter(F.col("day") >= F.date_sub(as_of, days))
    rows = rows if category is None else rows.filter(F.col("category") == category)
    return rows.orderBy(F.desc("day"))


def top_matches(matches: DataFrame, runs: DataFrame, n: int = 100) -> DataFrame:
    """Critical before high, newest first."""
    rows = completed(matches.filter(F.col("severity").isin(*HIGH)), runs)
    return rows.orderBy(severity_rank(F.col("severity")).desc(), F.desc("created_at"), "id").limit(n).select(
        "id", "department", "source_file", "conversation_key", "conversation_title", "provider", "model_name",
        "message_id", "message_timestamp", "author", "role", "company_label",
        F.col("company_category").alias("category"), "company_source_table", "company_source_field", "matched_text",
        "match_context", "severity", "confidence", "created_at", "analysis_run_at")


def rule_stats(rules: DataFrame, matches: DataFrame) -> DataFrame:
    """Matches per rule; rules that never matched stay with zero."""
    small = matches.groupBy(F.col("company_rule_id").alias("rule_id"), "conversation_key").agg(
        F.count("*").alias("m"), F.max("created_at").alias("t"))
    per = small.groupBy("rule_id").agg(
        F.sum("m").alias("m"), F.count("*").alias("c"), F.max("t").alias("last_match_at"))
    return rules.join(per, "rule_id", "left").select(
        "rule_id", "source_table", "source_field", "label", F.col("category").alias("rule_category"),
        F.col("severity").alias("rule_severity"), F.coalesce("m", F.lit(0)).alias("match_count"),
        F.coalesce("c", F.lit(0)).alias("affected_conversations"), "last_match_at")


def conversations_page(conversations: DataFrame, limit: int = 100, offset: int = 0, **equal) -> DataFrame:
    """Conversations with most matches first; filters by department, provider or highest_severity."""
    for column, value in equal.items():
        if value is not None:
            conversations = conversations.filter(F.col(column) == value)
    return conversations.orderBy(F.desc("match_count"), "conversation_key").offset(offset).limit(limit)


def conversation_findings(conversations: DataFrame) -> DataFrame:
    """Conversation summaries in the shape of findings."""
    return conversations.select(
        F.concat("conversation_key", F.lit(":summary")).alias("id"),
        F.when(F.col("secret_count") > 0, "secret").otherwise("pii").alias("type"),
        F.col("highest_severity").alias("severity"),
        F.coalesce(F.get("labels", F.lit(0)), F.lit("secret")).alias("category"),
        F.coalesce("model_name", F.lit("unknown")).alias("model"),
        F.coalesce("provider", F.lit("unknown")).alias("provider"),
        F.col("conversation_key").alias("conversation_id"), "match_count", "secret_count", "pii_count", "department",
        "conversation_title", F.col("last_match_at").alias("timestamp"))


def chat_stats(chats: DataFrame) -> DataFrame:
    small = chats.groupBy("conversation_key", "provider", "model_name").agg(
        F.count("*").alias("m"), F.min("conversation_timestamp").alias("a"), F.max("conversation_timestamp").alias("z"))
    return small.agg(
        F.coalesce(F.sum("m"), F.lit(0)).alias("messages"), F.countDistinct("conversation_key").alias("conversations"),
        F.countDistinct("provider").alias("providers"), F.countDistinct("model_name").alias("models"),
        F.min("a").alias("earliest"), F.max("z").alias("latest"))


def conversation_explorer(chats: DataFrame, findings: DataFrame) -> DataFrame:
    """Conversations with message and finding counts."""
    per = findings.groupBy("chat_id").agg(
        F.count("*").alias("n"), F.max(severity_rank(F.col("severity"))).alias("rank"))
    return chats.select("chat_id", "conversation_key", "provider", "conversation_timestamp").join(
        per, "chat_id", "left").groupBy("conversation_key").agg(
        F.min("provider").alias("provider"), F.count("*").alias("message_count"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("finding_count"),
        severity_name(F.coalesce(F.max("rank"), F.lit(0))).alias("highest_severity"),
        F.min("conversation_timestamp").alias("started_at"))


def conversation_detail(chats: DataFrame, findings: DataFrame, conversation_key: str) -> DataFrame:
    """The messages of one conversation in order, each with its findings."""
    messages = chats.filter(F.col("conversation_key") == conversation_key)
    per = findings.join(messages.select("chat_id"), "chat_id", "left_semi").groupBy("chat_id").agg(
        F.array_sort(F.collect_list(F.struct("start", "analyzer", "pattern", "severity", "matched_text"))).alias("findings"))
    return messages.join(per, "chat_id", "left").orderBy("message_index")


DETECTOR_VIEWS = {
    "overview": overview, "findings_by_category": findings_by_category, "provider_stats": provider_stats,
    "findings_timeline": findings_timeline, "top_findings": top_findings, "conversation_scatter": conversation_scatter,
}
MATCH_VIEWS = {
    "match_overview": match_overview, "matches_by_category": matches_by_category,
    "match_conversations": match_conversations, "match_departments": match_departments,
    "match_timeline": match_timeline, "top_matches": top_matches,
}


def detector_views(chats: DataFrame, findings: DataFrame, insights: DataFrame) -> dict[str, DataFrame]:
    build = {**DETECTOR_VIEWS, "overview": partial(overview, insights=insights)}
    return {name: view(chats, findings) for name, view in build.items()}


def match_views(matches: DataFrame, runs: DataFrame, rules: DataFrame) -> dict[str, DataFrame]:
    out = {name: view(matches, runs) for name, view in MATCH_VIEWS.items()}
    return {**out, "rule_stats": rule_stats(rules, matches)}
