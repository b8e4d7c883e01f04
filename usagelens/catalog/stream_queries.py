"""Streams run over all available input (`availableNow`), compared with batch SQL.

Windows that are still open when the bounded input ends are added by a closing
step, so the statements are the plain aggregates.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from usagelens.catalog import projections as p
from usagelens.catalog.oracle_parts import FINDINGS, USAGE
from usagelens.catalog.registry import query
from usagelens.plans.jobs import Store, analysis_cycle
from usagelens.session import scratch_path
from usagelens.streaming import streams

_U = f"WITH {USAGE} "


def _usage_stream(spark, folder):
    return p.usage_columns(streams.file_stream(spark, folder, "events.parquet"))


@query("daily_stream", _U + """SELECT strftime(date_trunc('day', usage_start), '%Y-%m-%d %H:%M:%S') AS window_start, department_id,
  count(*) AS events, CAST(sum(token_count) AS BIGINT) AS tokens, round(sum(cost), 2) AS cost FROM usage
  GROUP BY 1, 2""")
def daily_stream(spark, folder):
    out = streams.run_to_end(streams.daily_usage, _usage_stream(spark, folder), p.usage(spark, folder), "1 hour", "window_end", "daily", "1 day")
    return out.drop("window_end")


@query("usage_sessions", _U + """, g AS (SELECT *, CASE WHEN usage_start - lag(usage_start) OVER (PARTITION BY user_id_hash ORDER BY usage_start)
    <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM usage),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id_hash ORDER BY usage_start) AS n FROM g)
  SELECT user_id_hash, strftime(min(usage_start), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS events,
    CAST(sum(token_count) AS BIGINT) AS tokens FROM s GROUP BY user_id_hash, n""")
def usage_sessions(spark, folder):
    out = streams.run_to_end(lambda u: streams.usage_sessions(u, "6 hours"), _usage_stream(spark, folder), p.usage(spark, folder),
                             "1 hour", "session_end", "sessions", "6 hours", "user_id_hash")
    return out.drop("session_end")


@query("rate_limit_breaches", _U + """, w AS (SELECT user_id_hash, time_bucket(INTERVAL 10 MINUTE, usage_start) - to_minutes(10 * k) AS start
    FROM usage, (SELECT unnest([0, 1, 2, 3, 4, 5]) AS k))
  SELECT user_id_hash, strftime(start, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS requests FROM w
  GROUP BY 1, 2 HAVING count(*) > 2""")
def rate_limit_breaches(spark, folder):
    out = streams.run_to_end(lambda u: streams.rate_limit_breaches(u, 2, "60 minutes", "10 minutes"), _usage_stream(spark, folder),
                             p.usage(spark, folder), "1 minute", "window_end", "rate", "60 minutes")
    return out.drop("window_end")


@query("limited_requests", "WITH RECURSIVE " + USAGE + """, o AS (
    SELECT id, user_id_hash, usage_start AS t, row_number() OVER (PARTITION BY user_id_hash ORDER BY usage_start, id) AS k FROM usage),
  r AS (SELECT id, user_id_hash, k, true AS accepted, [t] AS kept FROM o WHERE k = 1
    UNION ALL SELECT o.id, o.user_id_hash, o.k, len(now) < 2, CASE WHEN len(now) < 2 THEN list_append(now, o.t) ELSE now END
    FROM (SELECT o.*, [x FOR x IN r.kept IF o.t - x < INTERVAL 6 HOUR] AS now FROM r JOIN o ON o.user_id_hash = r.user_id_hash AND o.k = r.k + 1) AS o)
  SELECT id, user_id_hash, accepted FROM r""")
def limited_requests(spark, folder):
    """A limiter of two requests in six hours, with state per user, over a stream that is stopped and started again between four batches."""
    events = p.table(spark, folder, "events")
    landed, out, checkpoint = (scratch_path(spark, f"requests-{part}") for part in ("landed", "judged", "checkpoint"))
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    cuts = [float("-inf"), *events.select(seconds.cast("double").alias("s")).approxQuantile("s", [0.25, 0.5, 0.75], 0.01), float("inf")]
    for low, high in zip(cuts, cuts[1:]):
        events.filter((seconds > low) & (seconds <= high)).write.mode("append").parquet(landed)
        judged = streams.limited_requests(p.usage_columns(spark.readStream.schema(events.schema).parquet(landed)), 2, 6 * 3600)
        judged.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(
            availableNow=True).start().awaitTermination()
    return spark.read.schema(judged.schema).parquet(out).select("id", "user_id_hash", "accepted")


@query("distinct_stream", f"WITH {USAGE} SELECT tool_name, count(*) AS events, round(sum(cost), 2) AS cost FROM usage GROUP BY 1")
def distinct_stream(spark, folder):
    """Every event delivered twice, counted once."""
    doubled = _usage_stream(spark, folder).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    out = streams.run_available(streams.distinct_events(doubled), "distinct")
    return out.groupBy("tool_name").agg(F.count("*").alias("events"), F.round(F.sum("cost"), 2).alias("cost"))


@query("alert_stream", f"WITH {FINDINGS} SELECT finding_id, analyzer, pattern, severity FROM findings WHERE severity IN ('critical', 'high')")
def alert_stream(spark, folder):
    messages = p.message_columns(streams.file_stream(spark, folder, "documents.parquet"))
    return streams.run_available(streams.alert_stream(messages), "alerts").select(
        "finding_id", "analyzer", "pattern", "severity")


@query("analysis_stream", f"""WITH {FINDINGS} SELECT analyzer, count(*) AS finding_count, count(DISTINCT f.chat_id) AS messages
  FROM findings f JOIN chats c USING (chat_id) WHERE c.author = 'user' GROUP BY 1""")
def analysis_stream(spark, folder):
    """Cycles over a message stream of three batches, then once more over everything: the repeat adds nothing."""
    store = Store(spark, scratch_path(spark, "store"))
    as_of = F.lit(p.AS_OF).cast("timestamp")
    landed = scratch_path(spark, "landed")
    p.table(spark, folder, "documents").repartition(3, "doc_id").write.parquet(landed)
    raw = p.table(spark, folder, "documents").schema
    messages = p.message_columns(spark.readStream.schema(raw).option("maxFilesPerTrigger", 1).parquet(landed))
    streams.analysis_stream(messages, store, scratch_path(spark, "cycle"), as_of).awaitTermination()
    analysis_cycle(store, p.message_columns(p.table(spark, folder, "documents")), "again", as_of)
    return store.log("findings").read().groupBy("analyzer").agg(
        F.count("*").alias("finding_count"), F.countDistinct("chat_id").alias("messages"))


@query("event_feed", "SELECT event_id AS id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 25")
def event_feed(spark, folder):
    """The last 25 events of a stream, each once."""
    events = streams.file_stream(spark, folder, "events.parquet").selectExpr(
        "CAST(event_id AS BIGINT) AS id", "event_type", "CAST(ts AS TIMESTAMP) AS ts")
    store = Store(spark, scratch_path(spark, "feed"))
    table = store.table("feed", "id BIGINT, event_type STRING, ts TIMESTAMP")
    streams.feed_sink(events, table, 25, ["ts", "id"], scratch_path(spark, "feed-checkpoint")).awaitTermination()
    return table.read().select("id", "event_type")
