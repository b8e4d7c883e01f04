"""Company rules: build one pattern per configured cell, then find them in messages.

The scan never pairs every message with every rule. A rule's letters and digits,
written without separators, form its *compact key*; a match of the rule covers
whole message tokens whose concatenation equals that key. So messages and rules
meet in an equality join on short keys and only survivors run the expression.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens import config
from usagelens.config import RuleConfig
from usagelens.functions.text import collapse_whitespace, infer_department, severity_name, severity_rank, stable_id
from usagelens.operators.detect import explode_matches
from usagelens.session import once

KEY_CHARS = 32


# ---------------------------------------------------------------- rule build
def rule_pattern(value: Column, legacy_separators: bool = False, numeric: Column | None = None) -> Column:
    """The expression for one cell value, empty when the value is blank.

    Several tokens may be separated by blanks and `- _ . /` or by any other
    character the value itself contains; numbers of four or more digits accept
    grouping marks; anything else is a literal. Always bounded by word breaks.
    """
    text = collapse_whitespace(value)
    if numeric is not None and not legacy_separators:
        text = F.when(numeric, F.regexp_replace(text, r"\.0+$", "")).otherwise(text)
    tokens = F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0))
    if legacy_separators:
        separators = F.lit(r"[\s\-_./]*")
    else:
        extra = F.array_distinct(F.split(F.regexp_replace(text, r"[A-Za-z0-9\s\-_./]", ""), ""))
        escaped = F.transform(F.filter(extra, lambda c: c != ""), lambda c: F.concat(F.lit("\\"), c))
        safe = F.transform(escaped, lambda c: F.when(c.rlike(r"(?U)^\\[\w]"), F.substring(c, 2, 9)).otherwise(c))
        separators = F.concat(F.lit(r"[\s\-_./"), F.array_join(safe, ""), F.lit("]*"))
    several = F.concat(F.lit(r"\b"), F.regexp_replace(F.array_join(tokens, " "), " ", _as_replacement(separators)),
                       F.lit(r"\b"))
    digits = F.array_join(F.split(text, ""), r"[\s,._-]*")
    number = F.when(F.length(text) >= 4, F.concat(F.lit(r"\b"), digits, F.lit(r"\b"))).otherwise(
        F.concat(F.lit(r"\b"), text, F.lit(r"\b")))
    literal = F.concat(F.lit(r"\b\Q"), F.replace(text, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E\b"))
    return (F.when(F.coalesce(text, F.lit("")) == "", F.lit(""))
            .when(F.size(tokens) > 1, several)
            .when(text.rlike("^[0-9]+$"), number)
            .otherwise(literal))


def _as_replacement(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\$])", r"\\$1")


def _scalars(raw: str | None) -> list[str]:
    """Keys and leaves in the file's order, at any depth, without recursion of our own."""
    if not raw:
        return []
    try:
        waiting = [json.loads(raw)]
    except (ValueError, RecursionError):
        return [raw]
    out = []
    while waiting:
        node = waiting.pop()
        if isinstance(node, dict):
            for key, value in reversed(node.items()):
                waiting += [value, str(key)]
        elif isinstance(node, list):
            waiting += reversed(node)
        elif node is not None:
            out.append(str(node))
    return [v for v in out if v.strip()]


def json_scalars(raw: Column) -> Column:
    """All keys and leaf values of a JSON text, at any depth; the text itself when it is not JSON.

    Keys come in the order of the text, which VARIANT does not keep; only JSON
    cells of company tables pass here.
    """

    @F.pandas_udf("array<string>")
    def walk(cells: pd.Series) -> pd.Series:
        return cells.map(_scalars)

    return walk(raw)


def build_rules(table: str, rows: DataFrame, rules: RuleConfig = config.DEFAULT_RULE_CONFIG, id_col: str = "id",
                legacy_separators: bool = False) -> DataFrame:
    """One rule per non-empty configured cell of a company table, one per scalar of JSON cells."""
    types = dict(rows.dtypes)
    fields = [f for f in rules.table_fields.get(table, {}) if f in types]
    cells = []
    for name in fields:
        text = F.col(name).cast("string")
        numeric = types[name].startswith(("decimal", "double", "float"))
        values = json_scalars(text) if name in rules.json_fields else F.array(text)
        cells.append(F.struct(
            F.lit(name).alias("source_field"), F.lit(rules.category(table, name)).alias("category"),
            F.lit(rules.severity(table, name)).alias("severity"), F.lit(name in rules.json_fields).alias("is_json"),
            F.lit(numeric).alias("is_number"), F.when(text != "", values).alias("values")))
    if not cells:
        raise ValueError(f"no configured column of {table} is present")
    record = F.col(id_col).cast("string")
    long = rows.select(record.alias("source_record_id"), F.inline(F.array(*cells)))
    long = long.select("*", F.posexplode("values").alias("idx", "value"))
    suffix = F.when(F.col("is_json"), F.concat(F.lit(":"), F.col("idx").cast("string"))).otherwise("")
    mark = F.when(F.col("is_json"), F.concat(F.lit("["), F.col("idx").cast("string"), F.lit("]"))).otherwise("")
    return long.select(
        F.concat(F.lit(f"{table}:"), "source_record_id", F.lit(":"), "source_field", suffix).alias("rule_id"),
        F.lit(table).alias("source_table"), "source_record_id", "source_field",
        F.concat(F.lit(f"{table}."), "source_field", mark).alias("label"),
        "category", "severity",
        rule_pattern(F.col("value"), legacy_separators, F.col("is_number")).alias("pattern"),
        "value", F.lit(True).alias("active")).filter(F.col("pattern") != "")


def build_all_rules(tables: dict[str, DataFrame], rules: RuleConfig = config.DEFAULT_RULE_CONFIG, **kw) -> DataFrame:
    """Rules of every configured table that is present."""
    parts = [build_rules(name, tables[name], rules, **kw) for name in rules.table_fields if name in tables]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# ----------------------------------------------------------------- rule scan
#: Letters outside ASCII that equal an ASCII letter when case is ignored, and final sigma.
_PARTNERS = ("\u017f\u0131\u0130\u212a\u03c2", "siik\u03c3")
_GRAM = 3


def _fold(text: Column) -> Column:
    return F.lower(F.translate(text, *_PARTNERS))


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[a-z0-9]+"), F.lit(0))


def _patterns(rules: DataFrame) -> DataFrame:
    """Distinct expressions of active rules with their compact key and how many message tokens it may span.

    Rules of equal value (the segment of every customer, say) share one
    expression, which is matched once per message and expanded to rules last.
    A value with a case partner of an ASCII letter has a key for either reading.
    """
    value = collapse_whitespace(F.col("value"))
    tokens = F.col("_part")
    number = F.regexp_replace(F.regexp_replace(value, r"\.0+$", ""), "[^0-9]", "")
    digits = F.col("pattern").contains(r"[\s,._-]*")
    parts = F.array_distinct(F.array(_tokens(F.lower(value)), _tokens(_fold(value))))
    return rules.filter("active").withColumn("_part", F.explode(parts)).select(
        "pattern", F.when(digits, number).otherwise(F.array_join(tokens, "")).alias("_compact"),
        F.when(digits, F.length(number)).otherwise(F.size(tokens)).alias("_span"), _fold(value).alias("_folded")).distinct()


def _texts_both_ways(texts: DataFrame) -> DataFrame:
    """Each text lower-cased and, where that differs, with case partners folded as well.

    A rule's own letters outside ASCII may be separators to its key, a
    message's may stand for ASCII letters; so both readings of a message give keys.
    """
    plain, folded = F.lower("_text"), _fold(F.col("_text"))
    return texts.withColumn("_reading", F.explode(F.array_distinct(F.array(plain, folded))))


def _letter_keys(texts: DataFrame, key: list[str], lettered: DataFrame, span: int) -> DataFrame:
    """(message key, _key): concatenations of whole message tokens that start like a rule.

    Places are gated by the first three characters of the rules' keys, at most
    36^3 strings, so that side is broadcast; keys of one or two characters are
    gated as a whole and only meet places whose first token is as short.
    """
    leads = lettered.select(F.substring("_compact", 1, _GRAM).alias("_lead")).distinct()
    words = F.col("_tokens")
    # A place carries its own few tokens only; the whole list would be copied once per token.
    runs = F.transform(words, lambda _, at: F.slice(words, at + 1, F.lit(span)))
    places = once(texts.select(*key, "_reading"), _tokens=_tokens(F.col("_reading"))).select(*key, F.explode(runs).alias("_run"))
    first, start = F.get("_run", F.lit(0)), F.array_join(F.slice("_run", 1, _GRAM), "")
    short = F.array(F.substring(start, 1, _GRAM), F.substring(start, 1, 2), first)
    openings = F.when(F.length(first) >= _GRAM, F.array(F.substring(first, 1, _GRAM))).otherwise(short)
    places = places.withColumn("_lead", F.explode(openings)).join(F.broadcast(leads), "_lead", "left_semi").drop("_lead")
    widths = places.select("*", F.explode(F.sequence(F.lit(1), F.size("_run"))).alias("_width"))
    run = F.array_join(F.slice("_run", F.lit(1), F.col("_width")), "")
    shorter = F.array_join(F.slice("_run", F.lit(1), F.col("_width") - 1), "")
    return widths.filter((F.col("_width") == 1) | (F.length(shorter) < KEY_CHARS)).select(*key, F.substring(run, 1, KEY_CHARS).alias("_key"))


def _bare_keys(texts: DataFrame, key: list[str]) -> DataFrame:
    """(message key, _key): runs of up to three characters that begin outside ASCII letters, digits and blanks."""
    text = F.col("_reading")
    starts = F.filter(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, F.lit(1)).rlike("[^a-z0-9 ]"))
    grams = F.flatten(F.transform(starts, lambda i: F.array(*[F.substring(text, i, F.lit(n)) for n in range(1, _GRAM + 1)])))
    return texts.filter(text.rlike("[^a-z0-9 ]")).select(*key, F.explode(F.array_distinct(grams)).alias("_key"))


def scan_messages(messages: DataFrame, rules: DataFrame, message_key: list[str], text_col: str = "user_text_clean",
                  carry: tuple[str, ...] = (), derive: dict[str, Column] | None = None) -> DataFrame:
    """Every match of every active rule in every message, case-insensitively.

    `derive` adds columns worked out from carried ones and `_text`, for messages
    with a match only.

    One plan for all sizes: (message key, key) pairs meet the rules' keys in an
    equality join whose strategy the measured sizes choose, each candidate
    expression is verified once per message, and matches are expanded to rules.
    """
    patterns = _patterns(rules)
    limits = patterns.agg(F.max(F.least("_span", F.lit(KEY_CHARS))).alias("span"),
                          F.count_if(F.length("_compact") == 0).alias("bare")).first()
    columns = list(dict.fromkeys([*message_key, *carry]))
    texts = once(messages, _text=collapse_whitespace(F.col(text_col))).select(*columns, "_text").filter(F.col("_text") != "")
    read = _texts_both_ways(texts.select(*message_key, "_text"))
    lettered = patterns.filter(F.length("_compact") > 0)
    parts = []
    if limits["span"]:
        offered = lettered.select("pattern", F.substring("_compact", 1, KEY_CHARS).alias("_key"))
        parts.append(_letter_keys(read, message_key, lettered, limits["span"]).join(offered, "_key"))
    if limits["bare"]:
        offered = patterns.filter(F.length("_compact") == 0).select("pattern", F.substring("_folded", 1, _GRAM).alias("_key"))
        parts.append(_bare_keys(read, message_key).join(offered, "_key"))
    pairs = texts.select(*message_key).limit(0).withColumn("pattern", F.lit(""))
    for part in parts:
        pairs = pairs.unionByName(part.select(*message_key, "pattern"))
    return _verify(texts.join(pairs.distinct(), message_key), rules, columns, derive)


def _verify(pairs: DataFrame, rules: DataFrame, columns: list[str], derive: dict[str, Column] | None = None) -> DataFrame:
    pairs = pairs.withColumn("_regex", F.concat(F.lit("(?iU)"), "pattern"))
    pairs = once(pairs, matches=F.expr("regexp_extract_all(_text, _regex, 0)")).filter(F.size("matches") > 0)
    for name, value in (derive or {}).items():
        pairs, columns = pairs.withColumn(name, value), [*columns, name]
    found = explode_matches(pairs, "_text", "_regex", [*columns, "pattern"])
    known = rules.filter("active").select("pattern", "rule_id", "label", "category", "severity", "source_table", "source_field")
    return found.join(known, "pattern").select(
        *columns, F.col("rule_id").alias("company_rule_id"), F.col("label").alias("company_label"),
        F.col("category").alias("company_category"), F.col("source_table").alias("company_source_table"),
        F.col("source_field").alias("company_source_field"), "start", F.col("match").alias("matched_text"),
        F.col("snippet").alias("match_context"), "severity", F.lit(1.0).alias("confidence"))


def company_matches(messages: DataFrame, rules: DataFrame, run_id: str, text_col: str = "user_text_clean",
                    rule_config: RuleConfig = config.DEFAULT_RULE_CONFIG, as_of: Column | None = None) -> DataFrame:
    """The match table of one run: one row per (message, rule, matched text).

    Equal texts matched several times in one message are one row, at the last
    position, as the table's key demands.
    """
    key = ["source_file", "conversation_key", "message_id"]
    carry = ("conversation_title", "provider", "model_name", "message_timestamp", "author", "role")
    # The department is read off the title, or the text of a message with a match.
    found = scan_messages(messages, rules, key, text_col, carry, {"department": infer_department(
        F.coalesce(F.nullif("conversation_title", F.lit("")), F.col("_text")), rule_config.department_keywords)})
    rest = [c for c in found.columns if c not in (*key, "company_rule_id", "matched_text")]
    one = found.groupBy(*key, "company_rule_id", "matched_text").agg(
        F.max_by(F.struct(*rest), "start").alias("r")).select(
        *key, "company_rule_id", "matched_text", "r.*")
    return one.select(
        stable_id(F.lit(run_id), "source_file", "conversation_key", "message_id", "company_rule_id",
                  "matched_text").alias("id"),
        F.lit(run_id).alias("analysis_run_id"), *key, "department", *carry,
        F.lit(text_col).alias("source_field"), "company_rule_id", "company_label", "company_category",
        "company_source_table", "company_source_field", "start", "matched_text", "match_context", "severity",
        "confidence", (as_of if as_of is not None else F.col("message_timestamp")).alias("created_at"))


def summarize(matches: DataFrame) -> DataFrame:
    """Per conversation: counts, labels, highest severity, and the first match's context columns."""
    order = F.struct("message_timestamp", "message_id", "start", "company_rule_id")
    first = F.min_by(F.struct("department", "provider", "model_name"), order)
    return matches.groupBy("analysis_run_id", "conversation_key").agg(
        first.alias("first"), F.count("*").alias("match_count"),
        F.count_if(F.col("company_category") == "secret").alias("secret_count"),
        F.count_if(F.col("company_category") == "pii").alias("pii_count"),
        F.count_if(F.col("company_category") == "financial").alias("financial_count"),
        F.array_sort(F.collect_set("company_label")).alias("labels"),
        severity_name(F.max(severity_rank(F.col("severity")))).alias("highest_severity")).select(
        "analysis_run_id", "conversation_key", "first.department", "first.provider", "first.model_name",
        "match_count", "secret_count", "pii_count", "financial_count", "labels", "highest_severity")
