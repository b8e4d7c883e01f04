"""Scorer verdicts to findings, insights and recommendations; analyzers as plug-ins.

Scorers are plain frame functions: a model behind `mapInPandas`, a landed file
of answers, or the keyword rules used here by default.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from usagelens.functions.text import is_private, is_trivial, strip_code_fence

TRIVIAL = "classification STRING, confidence DOUBLE, reason STRING"
SENSITIVITY = ("contains_sensitive BOOLEAN, sensitivity_level STRING, "
               "findings ARRAY<STRUCT<type: STRING, detail: STRING>>")
COMPLEXITY = "complexity_score INT, category STRING, reason STRING"
INSIGHT = "risk_score INT, risk_factors ARRAY<STRING>, summary STRING"

Analyzer = Callable[[DataFrame], DataFrame]
_ANALYZERS: dict[str, Analyzer] = {}


def register_analyzer(name: str, function: Analyzer) -> None:
    """An analyzer takes messages and returns findings (chat_id, analyzer, category, severity, ...)."""
    _ANALYZERS[name] = function


def run_analyzers(messages: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Findings of the named analyzers, missing columns filled with null."""
    chosen = names if names is not None else list(_ANALYZERS)
    out = None
    for name in chosen:
        found = _ANALYZERS[name](messages)
        out = found if out is None else out.unionByName(found, allowMissingColumns=True)
    if out is None:
        raise ValueError("no analyzer is registered")
    return out


#: What an analyzer in SQL returns for a message.
FINDING = ("chat_id BIGINT, analyzer STRING, category STRING, severity STRING, title STRING, detail STRING, snippet STRING, "
           "confidence DOUBLE")


def register_batch_analyzer(spark: SparkSession, name: str, analyze: Callable[[list[dict]], list[dict]]) -> Analyzer:
    """Make an analyzer of whole batches known to SQL, as a table function, and to `run_analyzers`.

    `analyze` gets the messages of a batch as dictionaries, in order, and returns
    findings with any fields of FINDING; the analyzer's name is filled in. In SQL:

        SELECT f.* FROM name(TABLE(messages) PARTITION BY batch_id ORDER BY position) AS f

    A batch is one partition of the call and must fit a task. `analyze` travels
    to the workers with the function.
    """
    fields = [field.split()[0] for field in FINDING.split(", ")]

    class Batch:
        def __init__(self):
            self.messages = []

        def eval(self, row: Row):
            self.messages.append(row.asDict())

        def terminate(self):
            for finding in analyze(self.messages) if self.messages else ():
                finding = {**finding, "analyzer": name}
                yield tuple(finding.get(field) for field in fields)

    spark.udtf.register(name, udtf(Batch, returnType=FINDING))

    def over(messages: DataFrame) -> DataFrame:
        return messages.sparkSession.sql(f"SELECT f.* FROM {name}(TABLE({{messages}}) PARTITION BY batch_id ORDER BY position) AS f", messages=messages)

    register_analyzer(name, over)
    return over


def parse_verdicts(answers: DataFrame, schema: str, answer_col: str = "answer", id_col: str = "chat_id") -> DataFrame:
    """(chat id, verdict, meta): the answer without code fences, read with the schema."""
    text = strip_code_fence(F.col(answer_col))
    return answers.select(id_col, F.from_json(text, schema).alias("verdict"), text.alias("meta")).filter(
        F.col("verdict").isNotNull())


def answers_for_batch(batch: DataFrame, answer_list: DataFrame, id_col: str = "chat_id") -> DataFrame:
    """Positional answers of scored batches joined to their messages.

    `batch` holds (batch_id, position, chat id); `answer_list` one JSON array
    per batch. Surplus answers are dropped, missing ones give no row.
    """
    items = F.try_variant_get(F.try_parse_json(strip_code_fence(F.col("answers"))), "$", "array<variant>")
    each = answer_list.select("batch_id", F.posexplode(items).alias("position", "v")).select(
        "batch_id", "position", F.to_json("v").alias("answer"))
    return batch.join(each, ["batch_id", "position"]).select(id_col, "answer")


def _finding(id_col: str, analyzer: str, category: Column, severity: Column, title: Column, detail: Column,
             snippet: Column, confidence: Column) -> list[Column]:
    return [F.col(id_col), F.lit(analyzer).alias("analyzer"), category.alias("category"), severity.alias("severity"),
            title.alias("title"), detail.alias("detail"), snippet.alias("snippet"), confidence.alias("confidence"),
            F.col("meta")]


def trivial_findings(verdicts: DataFrame, messages: DataFrame, id_col: str = "chat_id", text: str = "user_text") -> DataFrame:
    v = verdicts.filter(F.coalesce("verdict.classification", F.lit("productive")) == "trivial")
    return v.join(messages.select(id_col, F.substring(text, 1, 300).alias("_s")), id_col).select(*_finding(
        id_col, "llm_trivial", F.lit("usage_quality"), F.lit("low"), F.lit("Trivial AI usage detected"),
        F.col("verdict.reason"), F.col("_s"), F.coalesce("verdict.confidence", F.lit(0.8))))


def sensitivity_findings(verdicts: DataFrame, messages: DataFrame, id_col: str = "chat_id",
                         text: str = "user_text") -> DataFrame:
    v = verdicts.filter(F.col("verdict.contains_sensitive"))
    level = F.coalesce("verdict.sensitivity_level", F.lit("medium"))
    severity = F.when(level.isin("critical", "high", "medium", "low"), level).when(level == "none", "info").otherwise("medium")
    parts = F.array_join(F.transform("verdict.findings", lambda f: F.concat(f["type"], F.lit(": "), f["detail"])), "; ")
    return v.join(messages.select(id_col, F.substring(text, 1, 300).alias("_s")), id_col).select(*_finding(
        id_col, "llm_sensitivity", F.lit("content_leak"), severity,
        F.concat(F.lit("Sensitive content detected ("), level, F.lit(")")), F.nullif(parts, F.lit("")),
        F.col("_s"), F.lit(0.85)))


def complexity_findings(verdicts: DataFrame, id_col: str = "chat_id") -> DataFrame:
    score = F.coalesce("verdict.complexity_score", F.lit(5)).cast("string")
    title = F.concat(F.lit("Complexity: "), score, F.lit("/10 ("), F.coalesce("verdict.category", F.lit("unknown")), F.lit(")"))
    return verdicts.select(*_finding(
        id_col, "llm_complexity", F.lit("complexity"), F.lit("info"), title, F.col("verdict.reason"),
        F.lit(None).cast("string"), F.lit(0.9)))


# --------------------------------------------------------- default scorers
def keyword_verdicts(messages: DataFrame, id_col: str = "chat_id", text: str = "user_text",
                     tokens: Column | None = None) -> DataFrame:
    """Trivial-use answers from the keyword rules, in the answer format of a model."""
    size = tokens if tokens is not None else F.floor(F.length(text) / 4)
    hit = is_trivial(F.col(text), size) | is_private(F.col(text))
    return messages.select(id_col, F.to_json(F.struct(
        F.when(hit, "trivial").otherwise("productive").alias("classification"), F.lit(0.8).alias("confidence"),
        F.when(hit, "keyword").alias("reason"))).alias("answer"))


# Our default weights for the deterministic insight scorer.
SEVERITY_WEIGHT = {"critical": 40, "high": 20, "medium": 8, "low": 2}


def insights(findings: DataFrame, as_of: Column, id_col: str = "chat_id") -> DataFrame:
    """Risk per message: the sum of severity weights up to 100, its factors, a summary.

    Counts fold per (message, category, severity) first; factors are category
    names, of which there are few.
    """
    weight = F.lit(0)
    for name, value in SEVERITY_WEIGHT.items():
        weight = F.when(F.col("severity") == name, value).otherwise(weight)
    small = findings.groupBy(id_col, "category", "severity").agg(F.count("*").alias("n"))
    per = small.groupBy(id_col).agg(
        F.sum(F.col("n") * weight).alias("w"), F.sum("n").alias("n"),
        F.array_sort(F.collect_set("category")).alias("risk_factors"))
    return per.select(
        id_col, F.least(F.lit(100), F.col("w")).cast("int").alias("risk_score"), "risk_factors",
        F.concat(F.col("n").cast("string"), F.lit(" findings: "), F.array_join("risk_factors", ", ")).alias("summary"),
        as_of.alias("created_at"))


def pending_insights(findings: DataFrame, stored: DataFrame, limit: int | None = None, id_col: str = "chat_id") -> DataFrame:
    """Messages with findings but no insight, lowest id first when limited."""
    rest = findings.select(id_col).distinct().join(stored.select(id_col).distinct(), id_col, "left_anti")
    return rest.orderBy(id_col).limit(limit) if limit else rest


def statistics_json(overview: DataFrame, by_category: DataFrame, providers: DataFrame, n: int = 10) -> DataFrame:
    """Overview, top categories and top providers in one JSON row, as a recommender reads them."""
    def packed(frame: DataFrame, order: str) -> Column:
        ties = [c for c in frame.columns if c != order]
        top = frame.orderBy(F.desc(order), *ties).limit(n)
        rows = F.collect_list(F.struct(F.negative(order).alias("_order"), F.to_json(F.struct(*frame.columns)).alias("j")))
        return top.agg(F.array_join(F.transform(F.array_sort(rows), lambda r: r["j"]), ",").alias("s")).scalar()

    return overview.select(F.concat(
        F.lit('{"overview":'), F.to_json(F.struct(*overview.columns)), F.lit(',"top_finding_categories":['),
        packed(by_category, "finding_count"), F.lit('],"provider_usage_and_leaks":['), packed(providers, "message_count"),
        F.lit("]}")).alias("statistics"))


# Our default thresholds: (category, title, share column, threshold, impact, audience).
RECOMMENDATION_RULES = (
    ("security", "Rotate exposed credentials", "critical_share", 0.0, 95, "security team"),
    ("security", "Train staff on secrets in prompts", "high_share", 0.01, 80, "all staff"),
    ("coverage", "Analyse pending messages", "pending_share", 0.5, 50, "platform team"),
    ("quality", "Review risky conversations", "risk_share", 0.3, 60, "team leads"),
)


def recommendations(overview: DataFrame, as_of: Column) -> DataFrame:
    """One row per rule whose share exceeds its threshold, from the one-row overview."""
    per = F.greatest("total_messages", F.lit(1))
    shares = overview.select(
        (F.col("critical_findings") / per).alias("critical_share"), (F.col("high_findings") / per).alias("high_share"),
        (F.col("pending_messages") / per).alias("pending_share"),
        (F.coalesce("average_risk_score", F.lit(0.0)) / 100).alias("risk_share"))
    rules = F.array(*[F.when(F.col(share) > bound, F.struct(
        F.lit(category).alias("category"), F.lit(title).alias("title"),
        F.concat(F.lit(f"{share} is "), F.format_number(share, 4)).alias("description"),
        F.lit(impact).alias("impact_score"), F.lit(audience).alias("target_audience")))
        for category, title, share, bound, impact, audience in RECOMMENDATION_RULES])
    return shares.select(F.inline(F.array_compact(rules))).select(
        "*", F.lit("active").alias("status"), as_of.alias("created_at"))
