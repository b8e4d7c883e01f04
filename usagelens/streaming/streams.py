"""The same jobs on streams: watermarked windows, sessions, de-duplication, alerts, cycles."""

from __future__ import annotations

import sys
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from usagelens import config, schemas
from usagelens.functions.text import is_blank
from usagelens.operators.detect import detect
from usagelens.operators.tables import VersionedTable, keep_last
from usagelens.plans.jobs import Store, analysis_cycle, refresh_detector_views
from usagelens.plans.view_states import ViewStates
from usagelens.session import materialise, scratch_path
from usagelens.sources.usage_log import with_defaults

# The state function travels to the workers by value, so that workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# --------------------------------------------------------------------- sources
def usage_log_stream(spark: SparkSession, folder: str, as_of: Column) -> DataFrame:
    """JSON-lines usage files as they arrive; lines that are no record are dropped."""
    lines = spark.readStream.text(folder).filter(~is_blank(F.col("value")))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    parsed = lines.select(F.trim("value").alias("line"), F.from_json(
        "value", schemas.USAGE_RAW + ", _bad STRING", options).alias("r"))
    good = parsed.filter(F.col("r").isNotNull() & F.col("r._bad").isNull()).select("line", "r.*")
    return with_defaults(good, as_of, F.col("line"))


def file_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet file, or all files of a folder, of the given name as a stream."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{{{name}}}")  # a plain path must be a folder, a pattern need not


def parsed_messages(raw: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Messages that parse; malformed ones are dropped."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    rows = raw.select(F.from_json(F.col(column).cast("string"), schema + ", _bad STRING", options).alias("m"))
    return rows.filter(F.col("m").isNotNull() & F.col("m._bad").isNull()).select("m.*").drop("_bad")


# ------------------------------------------------------------------- windows
def daily_usage(usage: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events, tokens and cost per department and day; days close when the watermark passes them."""
    return usage.withWatermark("usage_start", late).groupBy(
        F.window("usage_start", width).alias("w"), "department_id").agg(
        F.count("*").alias("events"), F.sum("token_count").alias("tokens"), F.sum("cost").alias("cost")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "department_id", "events",
        "tokens", F.round("cost", 2).alias("cost"))


def usage_sessions(usage: DataFrame, gap: str = "30 minutes", late: str = "1 hour", user: str = "user_id_hash") -> DataFrame:
    """Usage per user and session; a session ends after `gap` without an event."""
    return usage.withWatermark("usage_start", late).groupBy(
        F.session_window("usage_start", gap).alias("w"), user).agg(
        F.count("*").alias("events"), F.sum("token_count").alias("tokens")).select(
        user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events", "tokens")


def rate_limit_breaches(usage: DataFrame, limit: int = 120, width: str = "60 seconds", slide: str = "10 seconds",
                        late: str = "1 minute", user: str = "user_id_hash") -> DataFrame:
    """Sliding windows in which one user sends more than `limit` requests."""
    return usage.withWatermark("usage_start", late).groupBy(
        F.window("usage_start", width, slide).alias("w"), user).agg(F.count("*").alias("requests")).filter(
        F.col("requests") > limit).select(
        user, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "requests")


def limited_requests(usage: DataFrame, limit: int = 120, seconds: int = 60, late: str = "1 minute", user: str = "user_id_hash",
                     id_col: str = "id", time_col: str = "usage_start") -> DataFrame:
    """(id, user, time, accepted) of every request, as a limiter decides one after the other.

    A request is refused while `limit` requests of its user were accepted within
    the `seconds` before it; refused ones do not count, so each decision hangs on
    the earlier ones and no window says it. A user's state is the times of at most
    `limit` accepted requests; a timer drops it when the last of them has run out.
    Within a batch requests are judged by time and id, over batches as they
    arrive, and those behind the watermark (`late`) are not judged. Requests
    without a time are left out; those without a user are one user's.
    """
    span = seconds * 1_000_000

    def judge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = deque(state.get[0] if state.exists else [])
        rows = pd.concat(list(frames), ignore_index=True).sort_values(["at", "id"], kind="stable")
        accepted = []
        for at in rows["at"].tolist():
            while kept and at - kept[0] >= span:
                kept.popleft()
            accepted.append(len(kept) < limit)
            if accepted[-1]:
                kept.append(at)
        yield pd.DataFrame({"id": rows["id"], "user": rows["user"], "at": rows["at"], "accepted": accepted})
        if kept:
            state.update((list(kept),))
            state.setTimeoutTimestamp(max((kept[-1] + span) // 1000 + 1, state.getCurrentWatermarkMs() + 1))

    rows = usage.withWatermark(time_col, late).filter(F.col(time_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("id"), F.col(user).cast("string").alias("user"), time_col, F.unix_micros(time_col).alias("at"))
    judged = rows.groupBy("user").applyInPandasWithState(
        judge, "id string, user string, at long, accepted boolean", "times array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return judged.select("id", F.col("user").alias(user), F.timestamp_micros("at").alias(time_col), "accepted")


def distinct_events(usage: DataFrame, id_col: str = "id", time_col: str = "usage_start", late: str = "1 hour") -> DataFrame:
    """Each id once, for inputs that deliver at least once."""
    return usage.withWatermark(time_col, late).dropDuplicatesWithinWatermark([id_col])


def alert_stream(messages: DataFrame, severities: tuple[str, ...] = ("critical", "high"), detectors=config.DETECTORS,
                 text_col: str = "user_text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Findings of the wanted severities as they occur; other detectors are not even tried."""
    return detect(messages, text_col=text_col, detectors=[d for d in detectors if d.severity in severities], keep=keep)


# --------------------------------------------------------------------- sinks
def run_available(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a stream over all input that is there, into Parquet; returns what it wrote."""
    spark = stream.sparkSession
    out, checkpoint = scratch_path(spark, f"{label}-out"), scratch_path(spark, f"{label}-checkpoint")
    query = stream.writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_to_end(build: Callable[[DataFrame], DataFrame], stream: DataFrame, rows: DataFrame, late: str, end_col: str, label: str,
               width: str, session_of: str | None = None, time_col: str = "usage_start") -> DataFrame:
    """A windowed stream over bounded input, with the windows that no watermark closes.

    In append mode a window is written once the watermark (newest event minus
    `late`) has passed its end. When the input is known to have ended, what is
    still open is worked out by the same `build` over the end of `rows`, the same
    input as a table, and added: only events of the last `width` before the
    watermark can lie in an open window. Sessions (`session_of` names whose, and
    `width` is the gap) reach back further, so those of users with an event as late
    as that are worked out.
    """
    written = run_available(build(stream), label)
    closed = rows.agg(F.max(time_col)).select((F.col(f"max({time_col})") - F.expr(f"INTERVAL {late}")).alias("m")).scalar()
    recent = rows.filter(F.col(time_col) > closed - F.expr(f"INTERVAL {width}"))
    if session_of:
        recent = rows.join(recent.select(session_of).distinct(), session_of, "left_semi")
    # Stored first: a filter on a session's end would be pushed below the merge of its events.
    still_open = materialise(build(recent), f"{label}-open").filter(F.col(end_col) > closed)
    return written.unionByName(still_open.select(*written.columns))


def upsert_sink(stream: DataFrame, table: VersionedTable, keys: list[str], checkpoint: str, order: list[str] | None = None,
                **trigger) -> StreamingQuery:
    """Each batch is upserted by key, so a replayed batch changes nothing; a table opened with its keys is not rewritten."""
    def write(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            table.upsert(batch, keys, order)

    return stream.writeStream.foreachBatch(write).outputMode("update").option(
        "checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def feed_sink(stream: DataFrame, table: VersionedTable, n: int, order: list[str], checkpoint: str,
              id_col: str = "id", **trigger) -> StreamingQuery:
    """Keep the last n distinct entries of a stream."""
    def write(batch: DataFrame, number: int) -> None:
        both = table.read().unionByName(batch).dropDuplicates([id_col])
        table.write(keep_last(both, n, order))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})).start()


def append_log(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """An append-only event log; `keep_last` on it replays the newest entries."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})).start()


def analysis_stream(messages: DataFrame, store: Store, checkpoint: str, as_of: Column,
                    all_chats: Callable[[], DataFrame] | None = None, states: ViewStates | None = None, **trigger) -> StreamingQuery:
    """The analysis cycle on every batch of new messages; views are refreshed when it found something.

    With `states` each batch adds its part to the views instead: no message of another batch is read.

    A batch is stored first: the cycle reads it several times, some of them for
    one column, and a batch of a stream would be worked out whole each time.
    """
    def cycle(batch: DataFrame, number: int) -> None:
        batch = materialise(batch, "cycle-batch")
        result = analysis_cycle(store, batch, f"batch-{number}", as_of)
        if states is not None:
            states.add(number, batch, store.log("findings").near(batch), store.log("conversation_insights").near(batch))
        if result["findings"] and all_chats is not None:
            refresh_detector_views(store, all_chats(), as_of)

    return messages.writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})).start()
