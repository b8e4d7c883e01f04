"""Record checks, duplicate ids and anonymisation of usage records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens import config
from usagelens.functions.text import any_of, pseudonym, unicode_pattern
from usagelens.session import once


def _line(text: str | Column, line: Column) -> Column:
    body = F.lit(text) if isinstance(text, str) else text
    return F.concat(F.lit("Line "), line.cast("string"), F.lit(": "), body)


def record_issues(records: DataFrame, line: Column | None = None) -> DataFrame:
    """One row per rule a record breaks: (id, rule, field, message).

    A column the frame lacks is a missing field of every record; a null value is
    a missing field of its own record.
    """
    present = [c for c in records.columns if not c.startswith("_")]
    number = line if line is not None else (F.col("_line") if "_line" in records.columns else F.lit(None))
    issues: list[Column] = []

    def issue(condition: Column, rule: str, field: str, message: Column) -> None:
        issues.append(F.when(condition, F.struct(
            F.lit(rule).alias("rule"), F.lit(field).alias("field"), message.alias("message"))))

    for field in config.RECORD_REQUIRED_FIELDS:
        gone = F.col(field).isNull() if field in present else F.lit(True)
        issue(gone, "missing_field", field, F.lit(f"missing required field '{field}'"))
    if "user_id_hash" in present:
        uid = F.coalesce(F.col("user_id_hash").cast("string"), F.lit(""))
        issue(uid.contains("@") | uid.contains(" "), "unhashed_user", "user_id_hash",
              F.concat(F.lit("'user_id_hash' looks like PII: '"), F.substring(uid, 1, 30), F.lit("'")))
    # One test over all fields together clears most records; a break between
    # fields is a word break, as their ends are.
    everything = F.concat_ws("\n", *[F.col(c).cast("string") for c in present])
    suspects = {name: unicode_pattern(pattern) for name, pattern in config.RECORD_PII_PATTERNS.items()}
    records = once(records, **{f"_has_{name}": everything.rlike(pattern) for name, pattern in suspects.items()})
    for field in present:
        text = F.coalesce(F.col(field).cast("string"), F.lit(""))
        for name, pattern in suspects.items():
            hit = F.col(f"_has_{name}") & text.rlike(pattern)
            if field in config.RECORD_TEXT_FIELDS:
                hit = hit & ~text.isin("[REDACTED]", "")
            issue(hit, f"pii_{name}", field, F.concat(
                F.lit(f"PII detected ({name}) in field '{field}': '"), F.substring(text, 1, 60), F.lit("'")))
    if "token_count" in present:
        raw = F.col("token_count").cast("string")
        tokens = raw.try_cast("bigint")
        issue(tokens > config.MAX_TOKEN_COUNT, "tokens_high", "token_count", F.concat(
            F.lit("token_count "), raw, F.lit(f" exceeds limit {config.MAX_TOKEN_COUNT}")))
        issue(tokens < 0, "tokens_negative", "token_count", F.concat(F.lit("token_count is negative ("), raw, F.lit(")")))
        issue(raw.isNotNull() & tokens.isNull(), "tokens_invalid", "token_count",
              F.lit("token_count is not a valid integer"))
    if "cost" in present:
        raw = F.col("cost").cast("string")
        cost = raw.try_cast("double")
        issue(cost > config.MAX_COST, "cost_high", "cost", F.concat(
            F.lit("cost "), raw, F.lit(f" exceeds limit {config.MAX_COST}")))
        issue(cost < 0, "cost_negative", "cost", F.concat(F.lit("cost is negative ("), raw, F.lit(")")))
        issue(raw.isNotNull() & cost.isNull(), "cost_invalid", "cost", F.lit("cost is not a valid number"))
    found = records.select(F.col("id").cast("string").alias("id") if "id" in present else F.lit(None).alias("id"),
                           number.cast("bigint").alias("line"), F.inline(F.array_compact(F.array(*issues))))
    return found.select("id", "line", "rule", "field", F.when(
        F.col("line").isNotNull(), _line(F.col("message"), F.col("line"))).otherwise(F.col("message")).alias("message"))


def duplicate_ids(records: DataFrame, id_col: str, line_col: str) -> DataFrame:
    """Records whose id was seen on an earlier line, with that first line.

    The first line per id is an aggregate, so an id on a third of all lines
    folds on the map side; only ids that repeat are joined back.
    """
    first = records.groupBy(id_col).agg(F.min(line_col).alias("first_line"), F.count("*").alias("_n")).filter(
        F.col("_n") > 1).drop("_n")
    return records.join(first, id_col).filter(F.col(line_col) > F.col("first_line")).select(
        id_col, F.col(line_col).alias("line"), "first_line")


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("rule", "field").agg(F.count("*").alias("issue_count"))


def check_result(issues: DataFrame) -> DataFrame:
    """One row: how many issues, and whether the file passes."""
    return issues.agg(F.count("*").alias("issues")).select("issues", (F.col("issues") == 0).alias("passed"))


def anonymize(records: DataFrame) -> DataFrame:
    """Keep metadata, replace identifiers by a stable hash, redact everything else."""
    names = records.columns
    hashed = [c for c in names if c in config.HASH_FIELDS]
    out: list[Column] = []
    for c in names:
        if c in config.SAFE_FIELDS:
            out.append(F.col(c))
        elif c == "user_id_hash" and not hashed:
            out.append(F.col(c))
        elif c not in config.HASH_FIELDS and c != "user_id_hash":
            out.append(F.lit("[REDACTED]").alias(c))
    if hashed:
        stored = [F.col("user_id_hash")] if "user_id_hash" in names else []
        # Later identifiers win over earlier ones, and over a stored hash.
        out.append(F.coalesce(*[pseudonym(F.col(c)) for c in reversed(hashed)], *stored).alias("user_id_hash"))
    return records.select(*out)


def write_anonymized(records: DataFrame, path: str) -> int:
    """Write the anonymised records as JSON lines; returns how many were written."""
    from pyspark.sql import Observation

    seen = Observation()
    anonymize(records).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(path)
    return seen.get["n"]


def unhashed(records: DataFrame, column: str = "user_id_hash") -> DataFrame:
    """Records whose pseudonym looks like a name or an address."""
    return records.filter(any_of([F.col(column).contains("@"), F.col(column).contains(" ")]))
