"""URL filters: host-suffix and path-prefix expressions met by short hash prefixes.

Each URL is expanded into the expressions "host suffix + path prefix" that a
rule could have. Expressions and rules join on the first four bytes of their
SHA-256, whole digests confirm, and the longest rule decides.

Path prefixes are taken at the lengths that occur among the rules, so any rule
path is met exactly and the expansion is (labels of the host) x (rule path
lengths), not (characters of the path). Only (page, host, path) is shuffled,
once and by all three, so a host that a third of all pages share is no hot key. The rule side is left to the optimizer: a small
rule table is broadcast by its measured size, a large one is shuffled and AQE
splits common prefixes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import lower_ascii

PREFIX_BYTES = 4


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return lower_ascii(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0))


def url_path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(F.coalesce(at, F.lit(0)) > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_suffixes(host: Column) -> Column:
    """The host and every parent domain: `a.b.c` gives a.b.c, b.c, c."""
    labels = F.split(host, "\\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every row of `pages`.

    `rules`: host, path, verdict (allow or block). A rule fits its host and all
    subdomains when the URL's path starts with the rule's. The longest rule
    (host and path together) wins; of equally long ones the longer host, then
    block, then the larger text. Without a rule the verdict is `default`. Null
    URLs and URLs without `://` have no host and no path, so no rule fits them.
    Repeated rows are judged one by one; other columns are ignored.
    """
    ready = rules.select(F.concat("host", "path").alias("_rule"), F.col("host").alias("_rule_host"), F.col("verdict").alias("_says")).filter(
        F.col("_rule").isNotNull()).withColumn("_digest", F.unhex(F.sha2(F.concat_ws("\n", "_rule_host", "_rule").cast("binary"), 256)))
    ready = ready.withColumn("_short", F.substr("_digest", F.lit(1), F.lit(PREFIX_BYTES)))
    lengths = sorted(r[0] for r in rules.select(F.char_length("path")).distinct().collect() if r[0] is not None)
    taken = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    taken = taken.groupBy("page_id", "host", "path").agg(F.count("*").alias("_copies"))
    at = F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>")
    fitting = F.filter(at, lambda n: n <= F.char_length("path"))
    made = F.flatten(F.transform(host_suffixes(F.col("host")), lambda h: F.transform(
        fitting, lambda n: F.struct(h.alias("h"), F.concat(h, F.substr(F.col("path"), F.lit(1), n)).alias("e")))))
    wide = taken.select("*", F.explode_outer(F.when(F.col("host") != "", made)).alias("_x"))
    wide = wide.withColumn("_own", F.unhex(F.sha2(F.concat_ws("\n", "_x.h", "_x.e").cast("binary"), 256)))
    met = wide.join(ready, (F.substr("_own", F.lit(1), F.lit(PREFIX_BYTES)) == F.col("_short")) & (F.col("_own") == F.col("_digest")), "left")
    rank = F.struct(F.char_length("_rule").alias("a"), F.char_length("_rule_host").alias("b"), (F.col("_says") == "block").alias("c"),
                    F.col("_rule").alias("rule"), F.col("_says").alias("says"))
    best = met.groupBy("page_id", "host", "path", "_copies").agg(F.max(F.when(F.col("_rule").isNotNull(), rank)).alias("_best"))
    each = best.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return each.select("page_id", "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.says", F.lit(default)).alias("verdict"))
