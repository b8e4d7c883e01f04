"""Column functions for text, identifiers, time and classification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from usagelens import config

# White space as Unicode defines it, plus the ASCII separators 0x1C-0x1F.
WS = r"[\s\x1c-\x1f]"


def unicode_pattern(pattern: str) -> str:
    """Make `\\w`, `\\b`, `\\d`, `\\s` and case folding Unicode-aware."""
    return "(?U)" + pattern


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def contains_any(text: Column, words) -> Column:
    return any_of([text.contains(w) for w in words])


# ------------------------------------------------------------------ cleaning
def drop_nul(text: Column) -> Column:
    return F.translate(text, "\0", "")


def collapse_whitespace(text: Column) -> Column:
    """One blank for every run of white space, none at the ends."""
    return F.trim(F.regexp_replace(text, unicode_pattern(WS + "+"), " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, unicode_pattern(rf"^{WS}+|{WS}+$"), "")


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(unicode_pattern(r"[^\s\x1c-\x1f]"))


def clean_user_text(raw: Column) -> Column:
    """Redact URLs, addresses and keys (in this order), then tidy white space.

    Texts without the literals that a pattern needs are not searched for it.
    """
    text = drop_nul(raw)
    for literals, pattern, mark in ((("://",), config.URL_PATTERN, "URL"), (("@",), config.EMAIL_PATTERN, "EMAIL"),
                                    (("sk-", "AKIA", "ghp_"), config.SECRET_PATTERN, "SECRET")):
        redacted = F.regexp_replace(text, unicode_pattern(pattern), f"[REDACTED_{mark}]")
        text = F.when(contains_any(text, literals), redacted).otherwise(text)
    return collapse_whitespace(text)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def html_text(html: Column, limit: int | None = None) -> Column:
    """Replace tags by blanks and collapse white space; whole text unless a limit is given."""
    text = collapse_whitespace(F.regexp_replace(html, "<[^>]+>", " "))
    return F.substring(text, 1, limit) if limit else text


def line_separators_to_space(text: Column) -> Column:
    """Replace U+2028 and U+2029 by a blank."""
    return F.translate(text, "\u2028\u2029", "  ")


# ----------------------------------------------------------------- ids, time
def stable_id(*parts: Column, length: int = 20) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, length)


def pseudonym(value: Column) -> Column:
    return F.concat(F.substring(F.sha2(value.cast("string"), 256), 1, 12), F.lit("-hash"))


def parse_iso(text: Column) -> Column:
    """A timestamp from an ISO string, extended or compact; else null.

    Strings without an offset are read in the session zone, which is UTC.
    """
    spread = F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})(?=$|[T ])", "$1-$2-$3")
    spread = F.regexp_replace(spread, r"(?<=^\d{4}-\d{2}-\d{2}[T ])(\d{2})(\d{2})(\d{2})?(?=$|[.Z+-])", "$1:$2:$3")
    spread = F.regexp_replace(spread, r"(?<=[T ]\d{2}:\d{2}):(?=$|[Z+-])", ":00")
    return F.when(spread.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}.*)?$"), F.try_to_timestamp(spread))


def parse_timestamp(value: Column) -> Column:
    """A timestamp from a VARIANT: a number is epoch milliseconds, a string is ISO; else null.

    The JSON type decides, so a string of digits is a date or nothing.
    """
    kind = F.schema_of_variant(value)
    number = F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT)"), F.try_variant_get(value, "$", "double"))
    text = F.when(kind == "STRING", F.try_variant_get(value, "$", "string"))
    return F.coalesce(F.timestamp_micros((number * 1000).cast("bigint")), parse_iso(text))


# ------------------------------------------------------------ classification
def detect_provider(file_name: Column, fallback: Column | None = None) -> Column:
    lower = F.lower(file_name)
    other = F.lower(F.coalesce(F.nullif(fallback, F.lit("")), F.lit("unknown"))) if fallback is not None \
        else F.lit("unknown")
    return (F.when(lower.startswith("chatgpt_"), "chatgpt")
            .when(lower.startswith("gemini_"), "gemini")
            .when(lower.startswith("antigravity"), "antigravity")
            .otherwise(other))


def normalize_author(role: Column) -> Column:
    lower = F.lower(strip(role.cast("string")))
    return (F.when(lower.isin("user", "human"), "user")
            .when(lower.isin("assistant", "model", "ai", "bot"), "model"))


def model_family(name: Column) -> Column:
    lower = F.lower(strip(F.coalesce(F.nullif(name, F.lit("")), F.lit("unknown"))))
    out = None
    for prefixes, family in config.MODEL_FAMILIES:
        hit = any_of([lower.startswith(p) for p in prefixes])
        out = F.when(hit, family) if out is None else out.when(hit, family)
    return out.otherwise(lower)


def is_trivial(purpose: Column, tokens: Column, keywords=config.TRIVIAL_KEYWORDS) -> Column:
    hit = contains_any(F.lower(F.coalesce(purpose, F.lit(""))), keywords)
    return F.coalesce(tokens <= config.TRIVIAL_TOKEN_LIMIT, F.lit(False)) & hit


def is_private(purpose: Column, keywords=config.PRIVATE_KEYWORDS) -> Column:
    return contains_any(F.lower(F.coalesce(purpose, F.lit(""))), keywords)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(unicode_pattern(r"\b[\w'-]+\b")))


def usage_word_count(purpose: Column, tokens: Column) -> Column:
    floor_tokens = F.greatest(F.lit(1), F.floor(tokens / 4).cast("int"))
    return F.greatest(word_count(F.coalesce(purpose, F.lit(""))), floor_tokens)


def infer_department(text: Column, keywords: dict[str, list[str]] | None = None) -> Column:
    """The first configured department of which a keyword occurs in the text."""
    table = config.DEFAULT_RULE_CONFIG.department_keywords if keywords is None else keywords
    lower = F.lower(F.coalesce(text, F.lit("")))
    if not table:
        return F.lit(None).cast("string")
    return F.coalesce(*[F.when(contains_any(lower, words), F.lit(name)) for name, words in table.items() if words])


def severity_rank(severity: Column) -> Column:
    out = None
    for name, rank in config.SEVERITY_RANK.items():
        out = F.when(severity == name, rank) if out is None else out.when(severity == name, rank)
    return out.otherwise(0)


def severity_name(rank: Column) -> Column:
    out = None
    for name, value in config.SEVERITY_RANK.items():
        out = F.when(rank == value, name) if out is None else out.when(rank == value, name)
    return out.otherwise("info")


def fabrication_flags(value: Column) -> dict[str, Column]:
    lower = F.lower(F.coalesce(value, F.lit("")))
    return {kind: contains_any(lower, words) for kind, words in config.FABRICATION_KEYWORDS.items()}


# ------------------------------------------------------------- model output
def strip_code_fence(text: Column) -> Column:
    """Model output without a surrounding markdown fence."""
    inner = F.regexp_extract(text, r"(?s)^\s*```[a-zA-Z]*\s*\n?(.*?)\s*```\s*$", 1)
    return F.when(text.rlike(r"(?s)^\s*```"), F.when(inner != "", inner).otherwise(text)).otherwise(strip(text))


def prompt_lines(text: Column, position: Column, size: int = 2000) -> Column:
    """The message's numbered lines, as scorers receive them: parts of `size` characters that together are the whole text."""
    last = F.greatest(F.ceil(F.length(text) / size).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(1), last), lambda part: F.concat(
        F.lit("["), position.cast("string"), F.lit("] "), F.substring(text, (part - 1) * size + 1, F.lit(size))))


# --------------------------------------------------------- content of blocks
def block_text(content: Column) -> Column:
    """Text of one VARIANT content value.

    A string is taken as it is, an object gives its first textual key, an array
    gives its typed text blocks joined by line breaks. An object that wraps an
    array of blocks under `content` is opened one level.
    """
    kind = F.schema_of_variant(content)
    direct = F.try_variant_get(content, "$", "string")
    wrapped = F.try_variant_get(content, "$.content", "array<variant>")
    blocks = F.coalesce(F.try_variant_get(content, "$", "array<variant>"), wrapped)
    from_object = F.coalesce(*[_string_field(content, k) for k in ("text", "content", "prompt", "message")])
    joined = F.array_join(
        F.filter(F.transform(blocks, _one_block), lambda t: ~is_blank(t)), "\n")
    out = (F.when(content.isNull(), F.lit(""))
           .when(kind == "STRING", direct)
           .when(kind.startswith("ARRAY"), joined)
           .when(kind.startswith("OBJECT"), F.coalesce(from_object, joined, F.lit("")))
           .otherwise(F.lit("")))
    return drop_nul(out)


def _string_field(value: Column, name: str) -> Column:
    inner = F.try_variant_get(value, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(inner) == "STRING", F.try_variant_get(value, f"$.{name}", "string"))


def _one_block(block: Column) -> Column:
    kind = F.lower(F.coalesce(F.try_variant_get(block, "$.type", "string"), F.lit("")))
    text = F.when(kind.isin("text", "input_text", "user_text"), _string_field(block, "text"))
    return (F.when(F.schema_of_variant(block) == "STRING", F.try_variant_get(block, "$", "string"))
            .otherwise(F.coalesce(text, _string_field(block, "content"))))
