"""Batch jobs: one analysis cycle, one company-rule run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from usagelens import config, schemas
from usagelens.config import RuleConfig
from usagelens.operators import verdicts
from usagelens.operators.detect import detect, processed_log
from usagelens.operators.keyed_log import KeyedLog
from usagelens.operators.rules import company_matches, summarize
from usagelens.operators.tables import VersionedTable, checked_insights, has_completed_run, run_row, swap_recommendations
from usagelens.plans import views
from usagelens.session import materialise

PROCESSED = "chat_id STRING, analyzer STRING"
#: Keys of the tables to which analysis cycles only add. All three lie in buckets by chat_id, so a cycle reads its messages' buckets.
LOGS = {"processed": ("chat_id", "analyzer"), "findings": ("finding_id",), "conversation_insights": ("chat_id",)}


@dataclass
class Store:
    """The engine's tables under one root folder; `buckets` is the layout of the logs, thousands for billions of messages."""

    spark: SparkSession
    root: str
    buckets: int = 16

    def table(self, name: str, schema: str | StructType | None = None) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.root}/{name}", schema or schemas.TABLES[name], *schemas.KEYS.get(name, ()))

    def log(self, name: str) -> KeyedLog:
        ddl = PROCESSED if name == "processed" else schemas.TABLES[name]
        return KeyedLog(self.spark, f"{self.root}/log_{name}", ddl, LOGS[name], ("chat_id",), self.buckets)


def _typed(rows: DataFrame, ddl: str) -> DataFrame:
    """The columns of a table in its order and types; absent ones are null."""
    have = set(rows.columns)
    empty = rows.sparkSession.createDataFrame([], ddl)
    return rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
                         for f in empty.schema])


def analysis_cycle(store: Store, chats: DataFrame, run_id: str, as_of: Column, detectors=config.DETECTORS,
                   text_col: str = "user_text") -> dict[str, int]:
    """Detect in user messages no analyzer has seen, then insights and recommendations.

    Messages count as seen once a run finished, with or without findings. A
    repeated cycle over the same messages adds nothing. A cycle writes only what
    its own messages bring, and reads of the logs only the buckets that its
    messages fall in. `chats` needs chat_id, author, the text, and the columns
    the views read.
    """
    analyzers = sorted({d.analyzer for d in detectors})
    messages = chats.withColumn("chat_id", F.col("chat_id").cast("string")).filter(F.col("author") == "user")
    seen = store.log("processed").near(messages)
    # A message is finished when every analyzer has seen it. Only this batch's part of the log is folded.
    seen = seen.filter(F.col("analyzer").isin(*analyzers)).join(messages.select("chat_id").distinct(), "chat_id", "left_semi")
    finished = seen.groupBy("chat_id").agg(
        F.countDistinct("analyzer").alias("n")).filter(F.col("n") == len(analyzers)).select("chat_id")
    fresh = messages.join(finished, "chat_id", "left_anti")
    found = detect(fresh, detectors=detectors, text_col=text_col, run_id=run_id).withColumn("created_at", as_of)
    found = materialise(_typed(found, schemas.FINDINGS), "cycle-findings")
    log = materialise(processed_log(fresh, analyzers), "cycle-processed")
    added = found.count()
    if added:
        store.log("findings").append_new(found)
        scored = checked_insights(verdicts.insights(found, as_of))
        store.log("conversation_insights").append_new(materialise(_typed(scored, schemas.INSIGHTS), "cycle-insights"))
    store.log("processed").append_new(log)
    return {"messages": log.select("chat_id").distinct().count(), "findings": added}


def refresh_detector_views(store: Store, chats: DataFrame, as_of: Column) -> dict[str, DataFrame]:
    """Write all detector views and swap the recommendations; returns the views as stored."""
    messages = chats.withColumn("chat_id", F.col("chat_id").cast("string"))
    built = views.detector_views(messages, store.log("findings").read(), store.log("conversation_insights").read())
    out = {}
    for name, frame in built.items():
        table = store.table(f"view_{name}", frame.schema)
        table.write(frame)
        out[name] = table.read()
    advice = verdicts.recommendations(out["overview"], as_of)
    stored = store.table("system_recommendations")
    stored.write(_typed(swap_recommendations(stored.read(), advice), schemas.RECOMMENDATIONS))
    return out


def run_rule_scan(store: Store, chats: DataFrame, rules: DataFrame, run_id: str, as_of: Column,
                  rule_config: RuleConfig = config.DEFAULT_RULE_CONFIG) -> dict[str, DataFrame]:
    """Scan all messages with all rules: rules, matches, summaries, run log, views."""
    store.table("company_rules").upsert(_typed(rules, schemas.RULES), ["rule_id"])
    stored_rules = store.table("company_rules").read()
    found = _typed(company_matches(chats, stored_rules, run_id, rule_config=rule_config, as_of=as_of), schemas.MATCHES)
    store.table("company_matches").upsert(found, *map(list, schemas.KEYS["company_matches"]))
    matches = store.table("company_matches").read()
    own = matches.filter(F.col("analysis_run_id") == run_id)
    store.table("conversation_summaries").upsert(
        _typed(summarize(own), schemas.SUMMARIES), ["analysis_run_id", "conversation_key"])
    count = lambda f: f.agg(F.count("*").alias("n")).scalar()
    entry = run_row(store.spark, run_id, count(chats), count(stored_rules), count(own), as_of)
    store.table("analysis_runs").upsert(_typed(entry, schemas.RUNS), ["id"])
    return views.match_views(matches, store.table("analysis_runs").read(), stored_rules)


def ensure_rule_scan(store: Store, chats: DataFrame, rules: DataFrame, run_id: str, as_of: Column, **options):
    """Run the rule scan unless one has completed before."""
    if has_completed_run(store.table("analysis_runs").read()):
        return None
    return run_rule_scan(store, chats, rules, run_id, as_of, **options)
