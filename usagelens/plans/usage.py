"""Usage reports: cost, volume, compliance, time series, anomalies, provider flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens import config
from usagelens.functions.text import any_of, is_private, is_trivial, model_family, usage_word_count
from usagelens.plans.filters import ReportFilters, filter_usage

DIMENSIONS = ("department", "model", "tool", "region", "timespan")


def dimension_key(dimension: str) -> Column:
    if dimension == "region":
        return F.coalesce(F.nullif("region", F.lit("")), F.lit("unknown"))
    if dimension == "timespan":
        return F.date_format("usage_start", "yyyy-MM-dd")
    columns = {"department": "department_id", "model": "model_name", "tool": "tool_name"}
    return F.col(columns[dimension]) if dimension in columns else F.lit("unknown")


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(part / F.greatest(whole, F.lit(1)) * 100, digits)


def cost_analytics(usage: DataFrame, dimension: str = "department", filters: ReportFilters | None = None) -> DataFrame:
    """Cost, sessions, tokens and trivial/private shares per bucket, most expensive first."""
    rows = filter_usage(usage, filters) if filters else usage
    sums = rows.groupBy(dimension_key(dimension).alias("key")).agg(
        F.sum("cost").alias("c"), F.count("*").alias("sessions"), F.sum("token_count").alias("tokens"),
        F.count_if(is_trivial(F.col("purpose"), F.col("token_count"))).alias("trivial"),
        F.count_if(is_private(F.col("purpose"))).alias("private"))
    return sums.select(
        "key", F.round("c", 4).alias("cost"), "sessions",
        F.round(F.col("c") / F.col("sessions"), 4).alias("avg_cost_per_session"), "tokens",
        F.round(F.col("c") / F.greatest("tokens", F.lit(1)), 6).alias("cost_per_token"),
        percent(F.col("trivial"), F.col("sessions")).alias("trivial_percentage"),
        percent(F.col("private"), F.col("sessions")).alias("private_percentage")).orderBy(F.desc("cost"), "key")


def usage_analytics(usage: DataFrame, dimension: str = "department", filters: ReportFilters | None = None) -> DataFrame:
    rows = filter_usage(usage, filters) if filters else usage
    words = F.col("word_count") if "word_count" in rows.columns else usage_word_count(
        F.col("purpose"), F.col("token_count"))
    return rows.groupBy(dimension_key(dimension).alias("key")).agg(
        F.count("*").alias("events"), F.sum("token_count").alias("tokens"),
        F.round(F.sum("token_count") / F.count("*"), 2).alias("average_tokens"),
        F.round(F.sum(words) / F.count("*"), 2).alias("average_words")).orderBy(F.desc("tokens"), "key")


def rollup_by(usage: DataFrame, column: str) -> DataFrame:
    """Events, tokens, cost, and trivial/private counts by the wide keyword lists."""
    return usage.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("unknown")).alias("key")).agg(
        F.count("*").alias("events"), F.sum("token_count").alias("tokens"), F.round(F.sum("cost"), 4).alias("cost"),
        F.count_if(is_trivial(F.col("purpose"), F.col("token_count"), config.TRIVIAL_KEYWORDS_WIDE)).alias("trivial"),
        F.count_if(is_private(F.col("purpose"), config.PRIVATE_KEYWORDS_WIDE)).alias("private"))


def usage_totals(usage: DataFrame) -> DataFrame:
    return usage.agg(
        F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 4).alias("total_cost"), F.count("*").alias("total_events"),
        F.coalesce(F.sum("token_count"), F.lit(0)).alias("total_tokens"),
        F.countDistinct("department_id").alias("total_departments"),
        F.countDistinct("model_name").alias("total_models"))


def top_departments(usage: DataFrame, n: int = 5) -> DataFrame:
    return usage.groupBy(F.col("department_id").alias("department")).agg(
        F.round(F.sum("cost"), 4).alias("cost"), F.count("*").alias("events")).orderBy(
        F.desc("events"), "department").limit(n)


def kpi_summary(usage: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: usage totals, finding counts, compliance, anomaly count and the top departments.

    Each part is one aggregate over its table; the parts meet as scalar
    sub-queries, so no join is planned.
    """
    kinds = findings.agg(F.struct(
        F.count("*").alias("total_findings"),
        *[F.count_if(F.col("severity") == s).alias(f"{s}_count") for s in ("critical", "high", "medium")],
        *[F.count_if(F.col("type") == t).alias(f"{t}_findings") for t in ("secret", "pii", "slopsquat")]).alias("s"))
    score = compliance_overall(usage).select(F.struct("overall_score", "status").alias("s"))
    alerts = anomalies(usage).agg(F.count("*").alias("s"))
    tops = top_departments(usage).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(F.negative("events").alias("order"), "department"))),
        lambda s: s["department"]), ",").alias("s"))
    totals = usage_totals(usage)
    return totals.select(
        *totals.columns, kinds.scalar().alias("f"), score.scalar().alias("c"), alerts.scalar().alias("anomalies"),
        tops.scalar().alias("top_departments")).select(*totals.columns, "f.*", "c.*", "anomalies", "top_departments")


# --------------------------------------------------------------- compliance
def _coverage(usage: DataFrame) -> DataFrame:
    """One row per check: covered rows, all rows, truncated percentage."""
    counts = usage.agg(F.count("*").alias("total"), *[
        F.count_if(F.coalesce(F.col(column).cast("string"), F.lit("")) != "").alias(check)
        for check, column in config.COVERAGE_CHECKS])
    entries = F.array(*[F.struct(F.lit(check).alias("check"), F.col(check).alias("covered"))
                        for check, _ in config.COVERAGE_CHECKS])
    return counts.select("total", F.inline(entries)).select(
        "check", "covered", "total",
        F.when(F.col("total") == 0, 0).otherwise(
            F.floor(F.col("covered") / F.col("total") * 100)).cast("int").alias("percentage"))


def compliance_checks(usage: DataFrame) -> DataFrame:
    return _coverage(usage).filter(F.col("total") > 0)


def compliance_overall(usage: DataFrame) -> DataFrame:
    """Mean percentage (half to even) and its status; no data scores 0."""
    overall = F.bround(F.avg("percentage"), 0).cast("int")
    return _coverage(usage).agg(overall.alias("overall_score")).select(
        "overall_score", F.when(F.col("overall_score") >= 80, "compliant")
        .when(F.col("overall_score") >= 50, "partial").otherwise("non_compliant").alias("status"))


def legislation_score(usage: DataFrame) -> DataFrame:
    """The same checks with an integer-division mean."""
    return _coverage(usage).agg(F.floor(F.sum("percentage") / F.count("*")).cast("int").alias("score"))


# ------------------------------------------------------------------- time
def time_series(usage: DataFrame, metric: str = "cost", granularity: str = "day") -> DataFrame:
    """One value per hour, day or week: cost, events or tokens."""
    values = {"cost": F.sum("cost"), "events": F.count("*").cast("double"),
              "tokens": F.sum("token_count").cast("double")}
    return usage.groupBy(F.date_trunc(granularity, "usage_start").alias("bucket")).agg(
        F.round(values[metric], 2).alias("value")).orderBy("bucket")


def daily_summary(usage: DataFrame) -> DataFrame:
    return usage.groupBy(F.to_date("usage_start").alias("day"), "department_id", "tool_name", "model_name").agg(
        F.count("*").alias("event_count"), F.sum("token_count").alias("total_tokens"),
        F.round(F.sum("cost"), 4).alias("total_cost"))


def last_points(series: DataFrame, n: int = 30, order: str = "bucket") -> DataFrame:
    return series.orderBy(F.desc(order)).limit(n).orderBy(order)


def anomalies(usage: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Departments whose cost on their last day is far from their daily mean.

    The deviation is the population one over all days, the last included; zero
    counts as 1. At least two days are needed.
    """
    daily = usage.groupBy("department_id", F.to_date("usage_start").alias("day")).agg(F.sum("cost").alias("cost"))
    stats = daily.groupBy("department_id").agg(
        F.count("*").alias("days"), F.avg("cost").alias("mean"), F.stddev_pop("cost").alias("deviation"),
        F.max("day").alias("period"), F.max_by("cost", "day").alias("observed"))
    z = (F.col("observed") - F.col("mean")) / F.when(F.col("deviation") == 0, 1.0).otherwise(F.col("deviation"))
    return stats.filter(F.col("days") >= 2).withColumn("z", z).filter(F.abs("z") >= threshold).select(
        F.col("department_id").alias("department"), "period", F.lit("cost").alias("metric"),
        F.round("mean", 4).alias("baseline_value"), F.round("observed", 4).alias("observed_value"),
        F.round("z", 2).alias("z_score"), F.when(F.col("z") > 0, "high").otherwise("low").alias("severity"),
        F.concat("department_id", F.lit(" cost deviated from baseline")).alias("explanation"))


# ----------------------------------------------------------- provider flow
def registry_frame(spark: SparkSession) -> DataFrame:
    """The provider registry; fixed and tiny, so always broadcast."""
    values = ", ".join(str(row) for row in config.PROVIDER_REGISTRY)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(model, provider, headquarters, data_region, gdpr_risk)")


def with_provider(usage: DataFrame, model_col: str = "model_name") -> DataFrame:
    """Add provider, headquarters, data_region, gdpr_risk: exact model name, else by substring."""
    lower = F.lower(F.col(model_col))
    fallback = None
    for words, entry in config.PROVIDER_FALLBACK:
        hit = any_of([lower.contains(w) for w in words])
        fallback = F.when(hit, entry) if fallback is None else fallback.when(hit, entry)
    exact = F.col(model_col).isin(*[row[0] for row in config.PROVIDER_REGISTRY])
    keyed = usage.withColumn("_entry", F.when(exact, F.col(model_col)).otherwise(fallback))
    registry = registry_frame(usage.sparkSession).withColumnRenamed("model", "_entry")
    joined = keyed.join(F.broadcast(registry), "_entry", "left").drop("_entry")
    names = ("provider", "headquarters", "data_region", "gdpr_risk")
    return joined.withColumns({n: F.coalesce(n, F.lit(v)) for n, v in zip(names, config.UNKNOWN_PROVIDER)})


def provider_flow(usage: DataFrame) -> DataFrame:
    """Events, tokens, cost, and the tools and departments seen per provider."""
    # Provider follows from the model, so rows shrink to (model, tool, department) first.
    small = usage.groupBy("model_name", "tool_name", "department_id").agg(
        F.count("*").alias("n"), F.sum("token_count").alias("t"), F.sum("cost").alias("c"))
    return with_provider(small).groupBy("provider").agg(
        F.sum("n").alias("event_count"), F.sum("t").alias("total_tokens"), F.round(F.sum("c"), 4).alias("total_cost"),
        F.array_sort(F.collect_set("tool_name")).alias("tools"),
        F.array_sort(F.collect_set("department_id")).alias("departments"))


def code_index_risks(usage: DataFrame) -> DataFrame:
    """Sessions of code-indexing tools with a high-risk provider."""
    rows = usage.filter(F.col("tool_name").isin(*config.CODE_INDEXING_TOOLS))
    return with_provider(rows).filter(F.col("gdpr_risk") == "high").select(
        "id", F.col("tool_name").alias("tool"), F.col("model_name").alias("model"), "provider",
        F.col("department_id").alias("department"),
        F.lit("Agent may index codebase and send IP to non-EU provider").alias("risk"))


def non_eu_transfers(usage: DataFrame) -> DataFrame:
    """Sessions of tools that handle sensitive data with a provider outside the EU."""
    rows = usage.filter(F.col("tool_name").isin(*config.SENSITIVE_TOOLS))
    return with_provider(rows).filter(~F.col("data_region").isin(*config.EU_SAFE_REGIONS)).select(
        "id", F.col("tool_name").alias("tool"), F.col("model_name").alias("model"), "provider", "data_region",
        F.col("department_id").alias("department"))


# ------------------------------------------------------ usage with findings
def model_comparison(usage: DataFrame, findings: DataFrame) -> DataFrame:
    """Usage and cost per model beside the findings of its family."""
    per_model = usage.groupBy("model_name").agg(
        F.count("*").alias("events"), F.sum("token_count").alias("tokens"), F.sum("cost").alias("c"))
    per_family = findings.filter(F.col("type").isin("secret", "pii", "slopsquat")).groupBy(
        F.col("model").alias("provider")).agg(
        F.count("*").alias("leaks"), F.count_if(F.col("type") == "slopsquat").alias("invented"))
    joined = per_model.withColumn("provider", model_family(F.col("model_name"))).join(per_family, "provider", "left")
    leaks, invented = F.coalesce("leaks", F.lit(0)), F.coalesce("invented", F.lit(0))
    return joined.select(
        F.col("model_name").alias("model"), "provider", "events", "tokens", F.round("c", 4).alias("total_cost"),
        F.round(F.col("c") / F.greatest("tokens", F.lit(1)), 6).alias("cost_per_token"),
        F.round(F.col("c") / F.col("events"), 4).alias("cost_per_session"), leaks.alias("leak_count"),
        F.round(leaks / F.col("events") * 1000, 2).alias("leak_rate"),
        F.round(invented / F.col("events") * 1000, 2).alias("halluc_rate"),
        F.round(F.col("c") / (leaks + 1), 4).alias("cost_per_quality")).orderBy(F.desc("total_cost"), "model")


def complexity_scatter(usage: DataFrame, findings: DataFrame, provider: str | None = None) -> DataFrame:
    """Every session with the number of findings of its model family.

    The lookup side has one row per model family, which is few by nature; AQE
    still checks its size before it is broadcast.
    """
    counts = findings.filter(F.col("type").isin("secret", "pii", "slopsquat")).groupBy(
        F.col("model").alias("provider")).agg(F.count("*").alias("n"))
    rows = usage.withColumn("provider", model_family(F.col("model_name")))
    if provider:
        rows = rows.filter(F.col("provider") == provider.lower())
    n = F.coalesce("n", F.lit(0))
    return rows.join(counts, "provider", "left").select(
        F.col("id").alias("conversation_id"), "token_count", n.alias("finding_count"), "provider",
        F.round("cost", 4).alias("cost"), F.col("department_id").alias("department"),
        F.when(n > 0, "critical").otherwise("medium").alias("severity"))


# ------------------------------------------------------------ shares, budget
def cost_shares(usage: DataFrame, dimension: str = "department") -> DataFrame:
    """Each bucket's share of the total cost in percent."""
    total = usage.agg(F.sum("cost").alias("t")).scalar()
    return usage.groupBy(dimension_key(dimension).alias("key")).agg(F.sum("cost").alias("c")).select(
        "key", F.round("c", 4).alias("cost"), F.round(F.col("c") / total * 100, 2).alias("share"))


def budget_status(usage: DataFrame, budgets: DataFrame) -> DataFrame:
    """Spending against budgets (department, budget): above 90 % critical, above 70 % high."""
    spent = usage.groupBy(F.col("department_id").alias("department")).agg(F.sum("cost").alias("c"))
    used = F.col("c") / F.col("budget") * 100
    return budgets.join(spent, "department", "left").withColumn("c", F.coalesce("c", F.lit(0.0))).select(
        "department", "budget", F.round("c", 4).alias("spent"), F.round(used, 2).alias("percentage"),
        F.when(used > 90, "critical").when(used > 70, "high").otherwise("success").alias("status"))


# ----------------------------------------------------- sovereignty extras
def flow_edges(usage: DataFrame) -> DataFrame:
    """Token flow department -> tool -> model -> region."""
    small = usage.groupBy(
        "department_id", "tool_name", "model_name", dimension_key("region").alias("region")).agg(
        F.sum("token_count").alias("t"))
    steps = (("department", "department_id", "tool", "tool_name"), ("tool", "tool_name", "model", "model_name"),
             ("model", "model_name", "region", "region"))
    edges = F.array(*[F.struct(
        F.lit(a).alias("source_kind"), F.col(x).alias("source"), F.lit(b).alias("target_kind"),
        F.col(y).alias("target")) for a, x, b, y in steps])
    return small.select("t", F.inline(edges)).groupBy("source_kind", "source", "target_kind", "target").agg(
        F.sum("t").alias("value"))


def unapproved_usage(usage: DataFrame, approved_models: DataFrame) -> DataFrame:
    """Usage of models that the allow-list (column `model_name`) does not hold."""
    small = usage.groupBy("model_name", "department_id").agg(
        F.count("*").alias("events"), F.sum("token_count").alias("tokens"), F.round(F.sum("cost"), 4).alias("cost"))
    return small.join(approved_models.select("model_name").distinct(), "model_name", "left_anti")


def retention_matrix(usage: DataFrame) -> DataFrame:
    """Providers in use with headquarters, data region and risk, and how much goes there."""
    small = usage.groupBy("model_name").agg(F.count("*").alias("n"), F.sum("token_count").alias("t"))
    return with_provider(small).groupBy("provider", "headquarters", "data_region", "gdpr_risk").agg(
        F.sum("n").alias("events"), F.sum("t").alias("tokens"))


def department_attribution(usage: DataFrame, findings: DataFrame) -> DataFrame:
    """Cost, volume, shares, leaks and purpose coverage per department."""
    leaks = findings.filter(F.col("department").isNotNull()).groupBy("department").agg(F.count("*").alias("leaks"))
    rows = usage.groupBy(F.col("department_id").alias("department")).agg(
        F.sum("cost").alias("c"), F.count("*").alias("sessions"), F.sum("token_count").alias("tokens"),
        F.count_if(is_trivial(F.col("purpose"), F.col("token_count"))).alias("trivial"),
        F.count_if(is_private(F.col("purpose"))).alias("private"),
        *[F.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")) != "").alias(f"_{k}")
          for k, c in config.COVERAGE_CHECKS])
    checks = [F.floor(F.col(f"_{k}") / F.col("sessions") * 100) for k, _ in config.COVERAGE_CHECKS]
    mean = sum(checks[1:], checks[0]) / len(checks)
    return rows.join(leaks, "department", "left").select(
        "department", F.round("c", 4).alias("cost"), "sessions", "tokens",
        percent(F.col("trivial"), F.col("sessions")).alias("trivial_percentage"),
        percent(F.col("private"), F.col("sessions")).alias("private_percentage"),
        F.coalesce("leaks", F.lit(0)).alias("leak_count"), F.bround(mean, 0).cast("int").alias("compliance_score"))


def cost_sparklines(usage: DataFrame, dimension: str = "department") -> DataFrame:
    """Daily costs per bucket in day order; one entry per day, so bounded by the calendar."""
    daily = usage.groupBy(dimension_key(dimension).alias("key"), F.to_date("usage_start").alias("day")).agg(
        F.round(F.sum("cost"), 2).alias("cost"))
    return daily.groupBy("key").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("day", "cost"))), lambda s: s["cost"]).alias("daily_cost"))


# ------------------------------------------------------- cost recommendations
def cost_recommendations(usage: DataFrame) -> DataFrame:
    """What trivial and private sessions cost per department and model: (category, department, model, savings)."""
    trivial = is_trivial(F.col("purpose"), F.col("token_count"))
    private = is_private(F.col("purpose"))
    sums = usage.groupBy("department_id", "model_name").agg(
        F.sum(F.when(trivial, F.col("cost"))).alias("t"), F.count_if(trivial).alias("tn"),
        F.sum(F.when(private, F.col("cost"))).alias("p"), F.count_if(private).alias("pn"))
    kinds = F.array(
        F.struct(F.lit("trivial_usage").alias("category"), F.col("tn").alias("sessions"), F.col("t").alias("s")),
        F.struct(F.lit("private_usage").alias("category"), F.col("pn").alias("sessions"), F.col("p").alias("s")))
    return sums.select(F.col("department_id").alias("department"), F.col("model_name").alias("model"), F.inline(kinds)).filter(
        F.col("sessions") > 0).select("category", "department", "model", "sessions", F.round("s", 4).alias("savings"))


def savings_split(recommended: DataFrame) -> DataFrame:
    """Savings per category and their share of the total."""
    total = recommended.agg(F.sum("savings").alias("t")).scalar()
    return recommended.groupBy("category").agg(F.sum("savings").alias("s")).select(
        "category", F.round("s", 4).alias("savings"), F.round(F.col("s") / total * 100, 2).alias("share"))
