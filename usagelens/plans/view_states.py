"""Detector views kept up to date by what each batch of messages adds.

A batch leaves partial states: sums per (day, conversation, provider, model) and
per (day, category, severity, analyzer, provider, model), and its newest severe
findings. All of them add up over batches, so the views are made from states
alone and no message or finding is read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.operators.keyed_log import KeyedLog
from usagelens.operators.tables import VersionedTable
from usagelens.plans import views
from usagelens.plans.jobs import Store
from usagelens.session import materialise

SEVERITIES = ("critical", "high", "medium", "low")
LEAKS = ("security_leaks", "content_leaks", "supply_chain_findings", "trivial_usage")
#: The columns that tell the rows of a state apart, and the sums in it.
CONVERSATION = ("day", "conversation_key", "provider", "model_name")
CONVERSATION_SUMS = ("messages", "findings", *[f"{s}_findings" for s in SEVERITIES], *LEAKS, "complexity_sum", "complexity_n",
                     "analyzed", "risk", "risks", "chars")
CATEGORY = ("day", "category", "severity", "analyzer", "provider", "model_name")
TOP = 100

_CONVERSATIONS = ("batch BIGINT, day DATE, conversation_key STRING, provider STRING, model_name STRING, "
                  + ", ".join(f"{c} {'DOUBLE' if c == 'complexity_sum' else 'BIGINT'}" for c in CONVERSATION_SUMS))
_CATEGORIES = ("batch BIGINT, day DATE, category STRING, severity STRING, analyzer STRING, provider STRING, model_name STRING, "
               "finding_count BIGINT")
_TOP = ("batch BIGINT, finding_id STRING, analyzer STRING, category STRING, severity STRING, title STRING, detail STRING, snippet STRING, "
        "confidence DOUBLE, created_at TIMESTAMP, provider STRING, model_name STRING, conversation_title STRING, author STRING, "
        "conversation_timestamp TIMESTAMP")


# -------------------------------------------------------------------- states
def conversation_states(chats: DataFrame, findings: DataFrame, insights: DataFrame) -> DataFrame:
    """Sums per CONVERSATION; messages are counted once, whatever findings they have."""
    risk = insights.groupBy("chat_id").agg(F.sum("risk_score").alias("risk"), F.count("risk_score").alias("risks"))
    each = chats.select("chat_id", F.to_date("conversation_timestamp").alias("day"), "conversation_key", "provider", "model_name",
                        F.length("user_text_clean").alias("chars"))
    joined = each.join(views.per_message(findings), "chat_id", "left").join(risk, "chat_id", "left")
    joined = joined.withColumns({"messages": F.lit(1), "analyzed": (F.col("findings") > 0).cast("int")})
    return joined.groupBy(*CONVERSATION).agg(*[F.sum(c).alias(c) for c in CONVERSATION_SUMS])


def category_states(chats: DataFrame, findings: DataFrame) -> DataFrame:
    per = findings.groupBy("chat_id", "category", "severity", "analyzer").agg(F.count("*").alias("n"))
    days = chats.select("chat_id", F.to_date("conversation_timestamp").alias("day"), "provider", "model_name")
    return per.join(days, "chat_id").groupBy(*CATEGORY).agg(F.sum("n").alias("finding_count"))


# --------------------------------------------------------------------- views
def overview(states: DataFrame) -> DataFrame:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    small = states.groupBy("conversation_key", "provider").agg(*[F.sum(c).alias(c) for c in CONVERSATION_SUMS])
    return small.agg(
        total("messages").alias("total_messages"), F.countDistinct("conversation_key").alias("total_conversations"),
        F.countDistinct("provider").alias("total_providers"), total("findings").alias("total_findings"),
        *[total(f"{s}_findings").alias(f"{s}_findings") for s in SEVERITIES],
        total("analyzed").alias("analyzed_messages"), (total("messages") - total("analyzed")).alias("pending_messages"),
        F.round(F.sum("risk") / F.sum("risks"), 4).alias("average_risk_score"))


def _complexity():
    return F.round(F.sum("complexity_sum") / F.nullif(F.sum("complexity_n"), F.lit(0)), 4).alias("avg_complexity")


def provider_stats(states: DataFrame) -> DataFrame:
    small = states.groupBy("provider", "model_name", "conversation_key").agg(*[F.sum(c).alias(c) for c in CONVERSATION_SUMS])
    return small.groupBy("provider", "model_name").agg(
        F.sum("messages").alias("message_count"), F.count("*").alias("conversation_count"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in LEAKS], _complexity())


def conversation_scatter(states: DataFrame) -> DataFrame:
    leaks = sum((F.coalesce(F.sum(c), F.lit(0)) for c in ("security_leaks", "content_leaks")), F.lit(0))
    return states.groupBy("conversation_key", "provider", "model_name").agg(
        F.sum("messages").alias("message_count"), _complexity(), leaks.alias("leak_count"),
        F.sum("chars").alias("total_chars")).filter(F.col("message_count") > 1)


def findings_by_category(states: DataFrame) -> DataFrame:
    return states.groupBy("category", "severity", "analyzer", "provider", "model_name").agg(F.sum("finding_count").alias("finding_count"))


def findings_timeline(states: DataFrame) -> DataFrame:
    return states.filter(F.col("day").isNotNull()).groupBy("day", "category", "severity").agg(F.sum("finding_count").alias("finding_count"))


def top_findings(states: DataFrame, n: int = TOP) -> DataFrame:
    return states.orderBy(F.desc("created_at"), "finding_id").limit(n)


class ViewStates:
    """The states of all batches under the root of a store.

    A message belongs to the batch that brought it first, as a log of ids in
    buckets says. A batch that is delivered again replaces its own states, so a
    writer lost at any point is made good by the replay; a message that a later
    batch repeats is not counted again. One writer at a time, batches in
    order: only the newest may come again.
    """

    def __init__(self, store: Store):
        spark, root = store.spark, store.root
        self.counted = KeyedLog(spark, f"{root}/counted", "chat_id STRING, batch BIGINT", ("chat_id",), buckets=store.buckets)
        state = lambda name, ddl, keys: VersionedTable(spark, f"{root}/states_{name}", ddl, ("batch", *keys))
        self.conversations = state("conversations", _CONVERSATIONS, CONVERSATION)
        self.categories = state("categories", _CATEGORIES, CATEGORY)
        self.top = state("top", _TOP, ("finding_id",))

    def add(self, batch: int, chats: DataFrame, findings: DataFrame, insights: DataFrame) -> None:
        """The states of one batch; of the findings and insights, those of its messages count.

        `chats` has an id per message and the columns of the views. What is read
        is the batch and its buckets of the log, besides the two frames: give
        them narrowed to the batch (`KeyedLog.near`).
        """
        ids = chats.select(F.col("chat_id").cast("string").alias("chat_id"), F.lit(batch).alias("batch")).distinct()
        ids = materialise(ids, "view-ids")
        self.counted.append_new(ids)
        mine = self.counted.near(ids).filter(F.col("batch") == batch).select(F.col("chat_id").alias("_mine"))
        own = lambda rows: rows.join(mine, F.col("chat_id").cast("string").eqNullSafe(F.col("_mine")), "left_semi")
        chats, findings, insights = own(chats), own(findings), own(insights)
        for table, rows in ((self.conversations, conversation_states(chats, findings, insights)),
                            (self.categories, category_states(chats, findings)), (self.top, views.top_findings(chats, findings, TOP))):
            table.upsert(rows.withColumn("batch", F.lit(batch)), list(table.keys))

    def views(self) -> dict[str, DataFrame]:
        """All detector views, from states alone."""
        conversations, categories = self.conversations.read(), self.categories.read()
        return {"overview": overview(conversations), "findings_by_category": findings_by_category(categories),
                "provider_stats": provider_stats(conversations), "findings_timeline": findings_timeline(categories),
                "top_findings": top_findings(self.top.read()).drop("batch"), "conversation_scatter": conversation_scatter(conversations)}

    def compact(self) -> None:
        """Add up the states of all batches but the newest, which may still be delivered again."""
        for table, keys in ((self.conversations, CONVERSATION), (self.categories, CATEGORY)):
            rows = table.read()
            newest = rows.agg(F.max("batch")).first()[0]
            if newest is None:
                continue
            batch = F.when(F.col("batch") == newest, newest).otherwise(F.lit(-1)).cast("long").alias("batch")
            sums = [c for c in rows.columns if c not in ("batch", *keys)]
            table.write(rows.groupBy(batch, *keys).agg(*[F.sum(c).alias(c) for c in sums]))
        rows = self.top.read()
        if (newest := rows.agg(F.max("batch")).first()[0]) is not None:
            self.top.write(top_findings(rows.filter(F.col("batch") < newest)).withColumn("batch", F.lit(-1).cast("long")).unionByName(
                rows.filter(F.col("batch") == newest)))
