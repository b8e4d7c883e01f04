"""Chat exports in six formats, brought to one message table (see `schemas.CHATS`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens import config
from usagelens.functions.text import (
    block_text, clean_user_text, content_hash, detect_provider, drop_nul, is_blank, normalize_author,
    parse_timestamp, strip, unicode_pattern)
from usagelens.schemas import CHATS
from usagelens.sources.files import (
    carry_forward, file_name, file_stem, number_lines, parent_name, path_exists, running_count, text_lines,
    whole_files)
from usagelens.sources.splitting import json_groups, json_items

_STANDARD = ("STRUCT<title: STRING, tags: VARIANT, author: STRING, count: VARIANT, exporter: STRING, date: VARIANT, "
             "url: STRING, messages: ARRAY<STRUCT<id: STRING, author: STRING, content: VARIANT>>>")
#: An element of a conversation array.
CONVERSATION = ("STRUCT<conversation_hash: STRING, model: STRING, timestamp: VARIANT, language: STRING, turn: VARIANT, "
                "redacted: VARIANT, toxic: VARIANT, conversation: ARRAY<STRUCT<role: STRING, content: VARIANT, "
                "turn_identifier: STRING, timestamp: VARIANT>>>")


def empty_chats(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CHATS)


def _filled(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def to_chats(rows: DataFrame) -> DataFrame:
    """Bring extracted rows to the message table: defaults, cleaned text, hash."""
    text = drop_nul(F.col("user_text"))
    rows = rows.withColumn("user_text", text).withColumn("user_text_clean", clean_user_text(F.col("user_text")))
    rows = rows.withColumn("user_text_hash", content_hash(F.col("user_text_clean")))
    have = set(rows.columns)
    parts = [field.split(" ", 1) for field in CHATS.split(", ")]
    return rows.select(*[
        (F.col(name) if name in have else F.lit(None)).cast(kind).alias(name) for name, kind in parts])


def _meta(**fields: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]), {"ignoreNullFields": "false"})


# ------------------------------------------------------------------ JSON files
def standard_export(files: DataFrame) -> DataFrame:
    """Files that hold one object with a `messages` list."""
    doc = files.filter(F.substring(F.ltrim("text"), 1, 1) == "{").select("path", F.from_json("text", _STANDARD).alias("d"))
    each = doc.filter("d.messages IS NOT NULL").select("path", "d", F.posexplode("d.messages").alias("idx", "m"))
    content = F.try_variant_get("m.content", "$", "string")
    author = normalize_author(F.col("m.author"))
    kept = each.withColumns({"author": author, "user_text": content}).filter(
        F.col("author").isNotNull() & (F.schema_of_variant("m.content") == "STRING") & ~is_blank(F.col("user_text")))
    tags = F.coalesce(F.size(F.try_variant_get("d.tags", "$", "array<variant>")), F.lit(0))
    return to_chats(kept.select(
        F.col("path").alias("source_file"), F.lit("json").alias("source_format"),
        detect_provider(file_name(F.col("path")), F.col("d.author")).alias("provider"),
        F.coalesce(_filled(F.col("d.url")), file_stem(F.col("path"))).alias("conversation_key"),
        F.col("d.title").alias("conversation_title"), F.col("d.author").alias("export_author"),
        parse_timestamp(F.col("d.date")).alias("conversation_timestamp"),
        F.coalesce(_filled(F.col("m.id")), F.concat_ws("-", "author", F.col("idx").cast("string"))).alias("message_id"),
        F.col("idx").alias("message_index"), "author", F.lower("m.author").alias("role"), "user_text",
        _meta(source=F.lit("standard-export"), url=F.col("d.url"), tag_count=tags, message_total=F.col("d.count"),
              exporter=F.col("d.exporter")).alias("metadata")))


def conversation_array(items: DataFrame) -> DataFrame:
    """Arrays of conversations, each with a `conversation` list of turns, as items (path, index, item) of type CONVERSATION.

    The first item tells whether a file is one of these.
    """
    conv = items.select("path", F.col("index").alias("conv_idx"), F.col("item").alias("c"))
    conv = conv.join(conv.filter("conv_idx = 0 and c.conversation is not null").select("path"), "path", "left_semi")
    each = conv.select("path", "conv_idx", "c", F.posexplode("c.conversation").alias("idx", "m"))
    kept = each.withColumns({
        "author": normalize_author(F.col("m.role")), "user_text": F.try_variant_get("m.content", "$", "string"),
        "key": F.coalesce(_filled(F.col("c.conversation_hash")), F.concat_ws(
            "-", file_stem(F.col("path")), F.col("conv_idx").cast("string")))}).filter(
        F.col("author").isNotNull() & (F.schema_of_variant("m.content") == "STRING") & ~is_blank(F.col("user_text")))
    return to_chats(kept.select(
        F.col("path").alias("source_file"), F.lit("json").alias("source_format"), F.lit("chatgpt").alias("provider"),
        F.col("key").alias("conversation_key"),
        F.concat(F.lit("wildchat-"), F.substring("key", 1, 12)).alias("conversation_title"),
        F.col("c.model").alias("model_name"), parse_timestamp(F.col("c.timestamp")).alias("conversation_timestamp"),
        F.coalesce(_filled(F.col("m.turn_identifier")), F.concat_ws(
            "-", "author", F.col("idx").cast("string"))).alias("message_id"),
        F.col("idx").alias("message_index"), parse_timestamp(F.col("m.timestamp")).alias("message_timestamp"),
        "author", F.lower("m.role").alias("role"), F.col("c.language").alias("language"), "user_text",
        _meta(source=F.lit("wildchat"), turn=F.col("c.turn"), conversation_hash=F.col("c.conversation_hash"),
              redacted=F.col("c.redacted"), toxic=F.col("c.toxic")).alias("metadata")))


# ------------------------------------------------------------------- markdown
def markdown_transcript(files: DataFrame, legacy_headers: bool = False) -> DataFrame:
    """`###` sections under known user and model headers, numbered as kept."""
    pattern = "(?d)" + unicode_pattern(config.SECTION_PATTERN)
    model = config.MODEL_HEADERS if legacy_headers else config.MODEL_HEADERS + config.EXTRA_MODEL_HEADERS
    heads = F.regexp_extract_all("text", F.lit(pattern), F.lit(1))
    bodies = F.slice(F.split("text", pattern, -1), F.lit(2), F.size(heads))
    sections = F.transform(F.arrays_zip(heads.alias("h"), bodies.alias("b")), lambda s: F.struct(
        F.when(F.lower(s["h"]).isin(*config.USER_HEADERS), "user").when(
            F.lower(s["h"]).isin(*model), "model").alias("author"), strip(s["b"]).alias("user_text")))
    kept = F.filter(sections, lambda s: s["author"].isNotNull() & (s["user_text"] != ""))
    each = files.select("path", F.posexplode(kept).alias("idx", "s")).select("path", "idx", "s.*")
    stem = file_stem(F.col("path"))
    return to_chats(each.select(
        F.col("path").alias("source_file"), F.lit("markdown").alias("source_format"),
        F.lit("antigravity").alias("provider"), stem.alias("conversation_key"), stem.alias("conversation_title"),
        F.lit("antigravity").alias("export_author"),
        F.concat(F.lit("user-md-"), F.col("idx").cast("string")).alias("message_id"),
        F.col("idx").alias("message_index"), "author", F.col("author").alias("role"), "user_text",
        _meta(source=F.lit("antigravity-markdown")).alias("metadata")))


# ----------------------------------------------------------------- JSON lines
def _text_of(event: str, *keys: str) -> Column:
    """The first non-empty of the fields, as text."""
    return F.coalesce(*[_filled(F.try_variant_get(event, f"$.{k}", "string")) for k in keys])


def _value_of(event: str, *keys: str) -> Column:
    """The first of the fields that is neither null nor empty, as a variant."""
    values = [F.try_variant_get(event, f"$.{k}", "variant") for k in keys]
    return F.coalesce(*[F.when(~F.is_variant_null(v) & ~F.to_json(v).isin('""', "[]", "{}", "0", "false"), v)
                        for v in values])


def _events(lines: DataFrame) -> DataFrame:
    rows = lines.filter(~is_blank(F.col("text"))).withColumn("e", F.try_parse_json("text"))
    return rows.filter(F.schema_of_variant("e").startswith("OBJECT")).drop("text")


def prompt_history(lines: DataFrame) -> DataFrame:
    """One prompt per line; lines that are no JSON object are skipped; the author defaults to user."""
    rows = _events(number_lines(lines))
    role = _text_of("e", "role", "author", "type")
    rows = rows.withColumns({
        "role_value": role, "author": F.coalesce(normalize_author(role), F.lit("user")),
        "user_text": block_text(_value_of("e", "prompt", "content", "text", "display"))}).filter(
        ~is_blank(F.col("user_text")))
    stamp = parse_timestamp(_value_of("e", "timestamp", "createdAt"))
    return to_chats(rows.select(
        F.col("path").alias("source_file"), F.lit("jsonl").alias("source_format"), F.lit("claude_code").alias("provider"),
        F.coalesce(_text_of("e", "sessionId", "conversationId"), file_stem(F.col("path"))).alias("conversation_key"),
        F.lit("claude-history").alias("conversation_title"), _text_of("e", "model").alias("model_name"),
        stamp.alias("conversation_timestamp"),
        F.coalesce(_text_of("e", "id", "uuid"), F.concat(
            F.lit("claude-history-"), F.col("line").cast("string"))).alias("message_id"),
        F.col("line").alias("message_index"), stamp.alias("message_timestamp"), "author",
        F.lower(F.coalesce("role_value", "author")).alias("role"), _text_of("e", "language").alias("language"),
        "user_text", _meta(source=F.lit("claude-history-jsonl")).alias("metadata")))


def project_sessions(lines: DataFrame) -> DataFrame:
    """Session events of a project tree; messages are numbered per file as kept."""
    rows = _events(number_lines(lines))
    role = _text_of("e", "type", "role")
    rows = rows.withColumns({
        "role_value": role, "author": normalize_author(role),
        "user_text": block_text(_value_of("e", "message", "content"))}).filter(
        F.col("author").isNotNull() & ~is_blank(F.col("user_text")))
    rows = running_count(rows, "idx")
    stamp = parse_timestamp(_value_of("e", "timestamp"))
    return to_chats(rows.select(
        F.col("path").alias("source_file"), F.lit("jsonl").alias("source_format"), F.lit("claude_code").alias("provider"),
        F.coalesce(_text_of("e", "sessionId", "conversationId"), file_stem(F.col("path"))).alias("conversation_key"),
        parent_name(F.col("path")).alias("conversation_slug"), _text_of("e", "model").alias("model_name"),
        stamp.alias("conversation_timestamp"),
        F.coalesce(_text_of("e", "uuid", "id"), F.concat(
            F.lit("claude-"), "author", F.lit("-"), F.col("line").cast("string"))).alias("message_id"),
        _text_of("e", "parentUuid", "parentId").alias("parent_message_id"), F.col("idx").alias("message_index"),
        stamp.alias("message_timestamp"), "author", F.lower("role_value").alias("role"), "user_text",
        _meta(source=F.lit("claude-project-jsonl"), cwd=_text_of("e", "cwd"), git_branch=_text_of("e", "gitBranch"),
              permission_mode=_text_of("e", "permissionMode")).alias("metadata")))


def agent_sessions(lines: DataFrame) -> DataFrame:
    """Session events of an agent tree; a `model_change` event sets the model of later messages.

    The carried value is a struct, so a change to no model resets it.
    """
    rows = _events(number_lines(lines)).withColumn("kind", F.lower(_text_of("e", "type")))
    change = F.when(F.col("kind") == "model_change", F.struct(_text_of("e", "model").alias("model")))
    rows = carry_forward(rows, change, "current").filter(F.col("kind") == "message")
    role = _text_of("e", "role")
    rows = rows.withColumns({
        "role_value": role, "author": normalize_author(role),
        "user_text": block_text(_value_of("e", "content", "message", "text"))}).filter(
        F.col("author").isNotNull() & ~is_blank(F.col("user_text")))
    rows = running_count(rows, "idx")
    stamp = parse_timestamp(_value_of("e", "timestamp"))
    return to_chats(rows.select(
        F.col("path").alias("source_file"), F.lit("jsonl").alias("source_format"), F.lit("pi_agent").alias("provider"),
        F.coalesce(_text_of("e", "session_id", "sessionId"), file_stem(F.col("path"))).alias("conversation_key"),
        parent_name(F.col("path")).alias("conversation_slug"),
        F.coalesce(_text_of("e", "model"), F.col("current.model")).alias("model_name"),
        stamp.alias("conversation_timestamp"),
        F.coalesce(_text_of("e", "id"), F.concat(
            F.lit("pi-"), "author", F.lit("-"), F.col("line").cast("string"))).alias("message_id"),
        _text_of("e", "parentId").alias("parent_message_id"), F.col("idx").alias("message_index"),
        stamp.alias("message_timestamp"), "author", F.lower("role_value").alias("role"),
        _text_of("e", "language").alias("language"), "user_text",
        _meta(source=F.lit("pi-agent-jsonl"), cwd=_text_of("e", "cwd")).alias("metadata")))


# ------------------------------------------------------------------ collection
def read_export_folder(spark: SparkSession, folder: str, legacy_headers: bool = False) -> DataFrame:
    """All JSON and Markdown exports of one folder; other shapes and broken files give no rows."""
    if not path_exists(spark, folder):
        return empty_chats(spark)
    groups = json_groups(spark, folder, stored=True)
    single = groups.filter("not is_list")
    arrays = json_items(spark, folder, CONVERSATION, lists_only=True, groups=groups)
    markdown = whole_files(spark, folder, "*.md")
    return standard_export(single).unionByName(conversation_array(arrays)).unionByName(
        markdown_transcript(markdown, legacy_headers))


def collect_chats(spark: SparkSession, exports: str | None = None, history: str | None = None,
                  projects: str | None = None, agents: str | None = None) -> DataFrame:
    """Messages of every given location; a location that does not exist adds nothing."""
    out = empty_chats(spark)
    if exports:
        out = out.unionByName(read_export_folder(spark, exports))
    if history and path_exists(spark, history):
        out = out.unionByName(prompt_history(text_lines(spark, history)))
    for root, read in ((projects, project_sessions), (agents, agent_sessions)):
        if root and path_exists(spark, root):
            out = out.unionByName(read(text_lines(spark, root)))
    return out


def provider_counts(chats: DataFrame) -> DataFrame:
    return chats.groupBy("provider").agg(F.count("*").alias("message_count"))


def top_files(chats: DataFrame, n: int = 5) -> DataFrame:
    return chats.groupBy("source_file").agg(F.count("*").alias("message_count")).orderBy(
        F.desc("message_count"), "source_file").limit(n)
