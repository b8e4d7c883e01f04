"""Pattern detectors: one message row in, one row per match out.

The whole operator is narrow (no shuffle): a cheap literal gate, the pattern
on texts that pass it, then positions for the few that match.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens import config
from usagelens.config import Detector
from usagelens.functions.text import contains_any, unicode_pattern
from usagelens.session import once

_BLOCK = 64


def _gated_matches(detector: Detector, text: Column, lower: Column) -> Column:
    matches = F.regexp_extract_all(text, F.lit(unicode_pattern(detector.pattern)), F.lit(0))
    source = lower if detector.gate_lower else text
    gates = [contains_any(source, literals) for literals in detector.gate]
    if detector.gate_regex:
        gates.append(text.rlike(unicode_pattern(detector.gate_regex)))
    return F.when(reduce(lambda a, b: a & b, gates), matches) if gates else matches


def explode_matches(hits: DataFrame, text: str, pattern: str, keep: list[str], values: Column | None = None) -> DataFrame:
    """One row per element of `matches`: the kept columns, `start`, `match`, `value` and `snippet`.

    `pattern` names the column that holds the expression. The text between
    matches is what `split` leaves, so a match starts after all pieces up to
    its own and all earlier matches; sums run over blocks of matches. Finished
    structs are exploded: neither the text nor the arrays travel with each
    match. Patterns must not match the empty string.
    """
    pieces = F.expr(f"split(`{text}`, `{pattern}`, -1)")
    # Each step is worked out once per text: inlined into the lambdas it would be once per match.
    hits = once(hits, _value=values if values is not None else F.col("matches"),
                _gaps=F.transform(F.slice(pieces, F.lit(1), F.size("matches")), F.length))
    hits = once(hits, _spans=F.zip_with("_gaps", F.transform("matches", F.length), lambda gap, length: gap + length))
    last_block = F.floor((F.size("_spans") - 1) / _BLOCK).cast("int")
    hits = once(hits, _blocks=F.transform(
        F.sequence(F.lit(0), last_block), lambda b: _total(F.slice("_spans", b * _BLOCK + 1, F.lit(_BLOCK)))))
    hits = once(hits, _starts=F.transform(
        F.sequence(F.lit(0), F.size("_blocks") - 1), lambda b: _total(F.slice("_blocks", F.lit(1), b))))

    def begin(at: Column) -> Column:
        block = F.floor(at / _BLOCK).cast("int")
        return F.element_at("_starts", block + 1) + _total(
            F.slice("_spans", block * _BLOCK + 1, at % _BLOCK)) + F.element_at("_gaps", at + 1)

    found = F.transform("matches", lambda m, at: F.struct(
        begin(at).alias("start"), m.alias("match"), F.element_at("_value", at + 1).alias("value")))
    hits = once(hits, _found=found)
    return hits.select(*keep, F.inline(F.transform("_found", lambda f: F.struct(
        f["start"].alias("start"), f["match"].alias("match"), f["value"].alias("value"),
        context(F.col(text), f["start"], F.length(f["match"])).alias("snippet")))))


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda s, v: s + v)


def context(text: Column, start: Column, length: Column, padding: int = 80) -> Column:
    """The match with up to `padding` characters on either side, trimmed."""
    left = F.greatest(start - padding, F.lit(0))
    cut = F.substring(text, left + 1, start + length + padding - left)
    return F.regexp_replace(cut, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def detect(messages: DataFrame, id_col: str = "chat_id", text_col: str = "user_text",
           detectors: Iterable[Detector] = config.DETECTORS, keep: tuple[str, ...] = (),
           run_id: str | None = None) -> DataFrame:
    """One row per match of any detector; `keep` names message columns to carry along.

    Give the raw text to find what cleaning would remove, or the cleaned text
    to look at what is left after it. `matched_text` is for display, at most 50
    characters of a secret; `match_hash` stands for the whole value.
    """
    detectors = list(detectors)
    carried = [id_col, *keep]
    base = messages.select(*carried, F.col(text_col).alias("_text"), F.lower(text_col).alias("_lower"))
    found = F.array(*[
        F.struct(
            F.lit(d.analyzer).alias("analyzer"), F.lit(d.name).alias("pattern"), F.lit(d.category).alias("category"),
            F.lit(d.severity).alias("severity"), F.lit(d.title).alias("title"),
            F.lit(unicode_pattern(d.pattern)).alias("_regex"), F.lit(d.group).alias("_group"),
            F.lit(d.confidence).alias("confidence"),
            _gated_matches(d, F.col("_text"), F.col("_lower")).alias("matches"))
        for d in detectors])
    hits = base.select(*carried, "_text", F.inline(F.filter(found, lambda h: F.size(h["matches"]) > 0)))
    shown = F.when(F.col("_group") == 0, F.col("matches")).otherwise(F.expr("regexp_extract_all(_text, _regex, 1)"))
    rows = explode_matches(hits, "_text", "_regex", [
        *carried, "analyzer", "pattern", "category", "severity", "title", "confidence"], shown)
    package = F.col("analyzer") == "slopsquatting"
    return rows.select(
        F.sha1(F.concat_ws("|", F.col(id_col).cast("string"), "analyzer", "pattern",
                           F.col("start").cast("string"), "match")).alias("finding_id"),
        F.lit(run_id).cast("string").alias("run_id"),
        *carried, "analyzer", "pattern", "category", "severity",
        F.when(package, F.concat(F.lit("Potential slopsquatting: "), "value")).otherwise(F.col("title")).alias("title"),
        F.when(package, F.col("title")).otherwise(F.concat(F.lit("Pattern: "), "pattern")).alias("detail"),
        "start",
        F.when(package, F.col("value")).otherwise(F.substring("value", 1, 50)).alias("matched_text"),
        F.sha2("value", 256).alias("match_hash"), "snippet", "confidence")


def finding_type(analyzer: Column) -> Column:
    """The report type of an analyzer: secret, pii or slopsquat."""
    return F.when(analyzer == "pii", "pii").when(analyzer == "slopsquatting", "slopsquat").otherwise("secret")


def unanalysed(messages: DataFrame, processed: DataFrame, analyzer: str, id_col: str = "chat_id",
               batch: int | None = None) -> DataFrame:
    """User messages this analyzer has not seen, oldest id first if a batch size is given.

    `processed` holds one row per (chat, analyzer) that was looked at, with or
    without findings, so clean messages are not fetched again.
    """
    done = processed.filter(F.col("analyzer") == analyzer).select(id_col)
    rest = messages.filter(F.col("author") == "user").join(done, id_col, "left_anti")
    return rest.orderBy(id_col).limit(batch) if batch else rest


def processed_log(messages: DataFrame, analyzers: Iterable[str], id_col: str = "chat_id") -> DataFrame:
    """One row per (message, analyzer) of a finished run."""
    return messages.select(id_col, F.explode(F.array(*[F.lit(a) for a in analyzers])).alias("analyzer"))


def findings_json(messages: DataFrame, findings: DataFrame, insights: DataFrame | None = None,
                  id_col: str = "chat_id") -> DataFrame:
    """Per message its findings as a JSON array, for messages without an insight yet."""
    pending = findings if insights is None else findings.join(insights.select(id_col), id_col, "left_anti")
    packed = pending.groupBy(id_col).agg(
        F.to_json(F.array_sort(F.collect_list(F.struct(
            "start", "analyzer", "pattern", "category", "severity", "title", "confidence")))).alias("findings"),
        F.max("run_id").alias("run_id"))
    return packed.join(messages.select(id_col), id_col, "left_semi")


# ------------------------------------------------------------- code imports
def extract_packages(documents: DataFrame, id_col: str, text_col: str, lang: str | None = None) -> DataFrame:
    """(id, language, position, package) for every package a source text imports.

    Names come in order of appearance, each once; relative module paths are left
    out. Without a given language the one with more import statements is taken,
    Python on a tie; with any other language both kinds count. Lines end at
    line feeds only.
    """
    text = F.col(text_col)
    found = once(
        documents.select(id_col, text_col),
        _python=F.regexp_extract_all(text, F.lit("(?d)" + unicode_pattern(config.PYTHON_IMPORT_PATTERN)), F.lit(1)),
        _node=F.regexp_extract_all(text, F.lit("(?d)" + unicode_pattern(config.NODE_IMPORT_PATTERN)), F.lit(1)))
    chosen = F.lit(lang) if lang else F.when(F.size("_python") >= F.size("_node"), "python").otherwise("node")
    node = F.filter("_node", lambda m: ~m.startswith("."))
    names = (F.when(F.col("language") == "python", F.col("_python")).when(F.col("language") == "node", node)
             .otherwise(F.concat("_python", node)))
    return found.withColumn("language", chosen).select(
        id_col, "language", F.posexplode(F.array_distinct(names)).alias("position", "package"))
