"""Package names: dictionary scans, look-alike detection, and import verdicts.

Look-alikes are found in bulk. Names and dictionary meet on shared deletion
keys (edit distance) or on shared rare tokens, two of them where two must have
partners (Jaccard); only those pairs are measured, so there is never a names x dictionary product.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from usagelens import config
from usagelens.functions.similarity import deletion_keys, osa_distance, tokenize, with_fuzzy_jaccard, within_one_edit
from usagelens.functions.text import strip


# --------------------------------------------------------------- dictionary
def by_ecosystem(packages: DataFrame, ecosystem: str) -> DataFrame:
    return packages.filter(F.col("ecosystem") == ecosystem).orderBy(
        F.desc_nulls_last("dependent_packages_count"), "name")


def find_by_name(packages: DataFrame, name: str) -> DataFrame:
    return packages.filter(F.lower("name") == name.lower())


def count_by_ecosystem(packages: DataFrame) -> DataFrame:
    return packages.groupBy("ecosystem").agg(F.count("*").alias("package_count"))


def from_registry_feed(items: DataFrame, ecosystem: str) -> DataFrame:
    """Dictionary rows of landed registry items; counts default to 0."""
    return items.filter(F.coalesce("name", F.lit("")) != "").select(
        "name", F.lit(ecosystem).alias("ecosystem"), F.coalesce("downloads", F.lit(0)).cast("bigint").alias("downloads"),
        F.coalesce("dependent_packages_count", F.lit(0)).cast("bigint").alias("dependent_packages_count"),
        "description", "repository_url")


def listed(packages: DataFrame) -> DataFrame:
    """Dictionary rows as the listing shows them, descriptions cut to 500 characters."""
    return packages.withColumn("description", F.substring("description", 1, 500))


# --------------------------------------------------------------- look-alikes
def _edit_candidates(names: DataFrame, dictionary: DataFrame, edits: int) -> DataFrame:
    """Pairs within `edits` alignments share a deletion key; keys travel as 64-bit hashes."""
    left = names.select("q", F.explode(deletion_keys(F.col("q"), edits)).alias("k"))
    right = dictionary.select("p", F.explode(deletion_keys(F.col("p"), edits)).alias("k"))
    left = left.select("q", F.xxhash64("k").alias("k"))
    right = right.select("p", F.xxhash64("k").alias("k"))
    # Two strings within `edits` also lie within 2 * edits plain edits (a swap is two).
    near = F.levenshtein("q", "p", 2 * edits) >= 0
    return left.join(right, "k").filter(near).select("q", "p")


def _name_tokens(names: DataFrame, column: str) -> DataFrame:
    """(name, n, t, w): distinct tokens, how often each occurs, and all tokens counted; a name without any has one empty token."""
    tokens = names.select(column, tokenize(F.col(column)).alias("all"))
    each = tokens.select(column, F.size("all").alias("n"), "all", F.explode(
        F.when(F.size("all") == 0, F.array(F.lit(""))).otherwise(F.array_distinct("all"))).alias("t"))
    return each.select(column, "n", "t", F.greatest(F.size(F.filter("all", lambda x: x == F.col("t"))), F.lit(1)).alias("w"))


def _near_tokens(left: DataFrame, right: DataFrame) -> DataFrame:
    """(t, u): tokens of the names and of the dictionary within one edit of each other; every distinct token is compared once."""
    a = left.select("t").distinct().select("t", F.explode(deletion_keys(F.col("t"), 1)).alias("k"))
    b = right.select(F.col("t").alias("u")).distinct().select("u", F.explode(deletion_keys(F.col("u"), 1)).alias("k"))
    return a.join(b, "k").select("t", "u").distinct().filter(within_one_edit(F.col("t"), F.col("u")))


def _ranked(tokens: DataFrame, column: str, partners: DataFrame, share: float) -> DataFrame:
    """(name, one, first, second): tokens from rare to common, each as (before, near); `partners` are (t, df, near).

    At least the share of a name's n tokens must have partners, so at most
    n - needed do not, and the rarest token that has one lies within that many of
    the rarest (`first`). Where two distinct tokens must have partners, the next
    one lies one further at most (`second`); `one` marks names in which one may do.
    """
    ranked = tokens.join(partners, "t", "left").fillna(0, "df")
    order = Window.partitionBy(column).orderBy("df", "t").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranked.withColumn("before", F.coalesce(F.sum("w").over(order), F.lit(0)))
    token = F.struct("before", F.coalesce("near", F.array().cast("array<string>")).alias("near"))
    names = placed.groupBy(column).agg(F.first("n").alias("n"), F.max("w").alias("w"), F.collect_list(token).alias("all"))
    needed = F.ceil(F.lit(round(share, 9)) * F.col("n") - F.lit(1e-6))
    return names.withColumn("free", F.col("n") - needed).select(
        column, ((needed < 2) | (F.col("w") > 1)).alias("one"), "all",
        F.filter("all", lambda x: x["before"] <= F.col("free")).alias("first"),
        F.filter("all", lambda x: x["before"] <= F.col("free") + 1).alias("second"))


def _each(tokens: Column, key: Callable[[Column], Column]) -> Column:
    return F.flatten(F.transform(tokens, lambda x: F.transform(x["near"], key)))


def _both(left: Column, right: Column, key: Callable[[Column, Column], Column]) -> Column:
    """Keys of partners of two tokens, the second one behind the first."""
    return F.flatten(F.transform(left, lambda i: F.flatten(F.transform(
        F.filter(right, lambda j: j["before"] > i["before"]),
        lambda j: F.flatten(F.transform(i["near"], lambda u: F.transform(j["near"], lambda v: key(u, v))))))))


def _single(kind: str) -> Callable[[Column], Column]:
    return lambda u: F.xxhash64(F.lit(kind), u)


def _pair(u: Column, v: Column) -> Column:
    return F.xxhash64(F.lit("two"), F.least(u, v), F.greatest(u, v))


def _token_candidates(names: DataFrame, dictionary: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose fuzzy Jaccard may reach `threshold`.

    Reaching it means that on one side at least the share 2t / (1 + t) of the
    tokens has a partner on the other side. Names meet the dictionary on its own
    tokens: where two must have partners on a pair of them, else on one. A name
    whose tokens have very many partners meets on single ones, which finds no
    less, rather than on all their pairs.
    """
    share = 2 * threshold / (1 + threshold)
    a, b = _name_tokens(names, "q"), _name_tokens(dictionary, "p")
    near = _near_tokens(a, b)
    # How common a token is counts what it would be joined with.
    in_a, in_b = (side.groupBy("t").agg(F.count("*").alias("df")) for side in (a, b))
    of_a = near.join(in_b.withColumnRenamed("t", "u"), "u").groupBy("t").agg(F.sum("df").alias("df"), F.collect_list("u").alias("near"))
    of_b = near.join(in_a, "t").groupBy("u").agg(F.sum("df").alias("df")).select(F.col("u").alias("t"), "df", F.array("u").alias("near"))
    # A token of the dictionary that no name is near to has no partner, but other names of the dictionary's side may share it.
    of_b = in_b.select("t").join(of_b, "t", "left").select("t", F.coalesce("df", F.lit(0)).alias("df"), F.array("t").alias("near"))
    left, right = _ranked(a, "q", of_a, share), _ranked(b, "p", of_b, share)
    few = lambda tokens, most: F.aggregate(tokens, F.lit(0), lambda n, x: n + F.size(x["near"])) <= most
    own = F.array_distinct(_each(F.col("all"), lambda u: u))
    # The share of the name's tokens has partners.
    chosen = left.select("q", F.explode(F.array_distinct(F.when(F.col("one") | ~few(F.col("second"), 64), _each(F.col("first"), _single("one"))).otherwise(
        _both(F.col("first"), F.col("second"), _pair)))).alias("k"))
    offered = right.select("p", own.alias("own")).select("p", F.explode(F.concat(
        F.transform("own", _single("one")), _pairs_of(F.col("own"), True))).alias("k"))
    one = chosen.join(offered, "k").select("q", "p")
    # The share of the dictionary name's tokens has partners.
    chosen = right.select("p", F.explode(F.array_distinct(F.when(F.col("one"), _each(F.col("first"), _single("one"))).otherwise(F.concat(
        _both(F.col("first"), F.col("second"), _pair), _each(F.col("first"), _single("many")))))).alias("k"))
    offered = left.select("q", own.alias("own")).select("q", F.explode(F.concat(F.transform("own", _single("one")), F.when(
        F.size("own") <= 64, _pairs_of(F.col("own"), False)).otherwise(F.transform("own", _single("many"))))).alias("k"))
    return one.unionAll(offered.join(chosen, "k").select("q", "p"))


def _pairs_of(tokens: Column, twice: bool) -> Column:
    """Keys of all pairs of tokens, with `twice` of each token with itself too."""
    rest = lambda i: F.slice(tokens, i + (1 if twice else 2), F.size(tokens))
    return F.flatten(F.transform(tokens, lambda u, i: F.transform(rest(i), lambda v: _pair(u, v))))


def lookalikes(names: DataFrame, packages: DataFrame, name_col: str = "name", top_n: int = 10,
               max_distance: int = 2, min_similarity: float = 0.6) -> DataFrame:
    """The best `top_n` dictionary matches of every suspicious name.

    A name that equals a dictionary name, ignoring case, is not suspicious and
    has no matches. Otherwise an entry matches within 1..`max_distance` edits
    (neighbour swaps count one) or by fuzzy token Jaccard >= `min_similarity`;
    the edit distance decides the method when both hold.
    """
    if not 1 <= max_distance <= 5:
        raise ValueError("max_distance must be between 1 and 5")
    if not 0 < min_similarity <= 1:
        raise ValueError("min_similarity must be above 0, or every package would match every name")
    queries = names.select(F.lower(strip(F.col(name_col))).alias("q")).filter(F.col("q").isNotNull()).distinct()
    known = packages.select(F.lower("name").alias("p")).distinct()
    fresh = queries.join(known.withColumnRenamed("p", "q"), "q", "left_anti")
    # A pair's copies come from different keys, so folding before the shuffle would be in vain.
    # The partition count is explicit because the rows are small but costly to measure.
    width = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = _edit_candidates(fresh, known, max_distance).unionAll(
        _token_candidates(fresh, known, min_similarity)).repartition(width, "q", "p").distinct()
    tokens = pairs.select("q", "p", tokenize(F.col("q")).alias("_a"), tokenize(F.col("p")).alias("_b"))
    scored = with_fuzzy_jaccard(tokens, "_a", "_b")
    # Built-in tests first; the distance itself is worked out for what is left.
    possible = (F.levenshtein("q", "p", 2 * max_distance) >= 0) | (F.col("jaccard") >= min_similarity)
    measured = scored.filter(possible).select("q", "p", "jaccard", osa_distance()("q", "p").alias("distance"))
    near = F.col("distance").between(1, max_distance)
    longest = F.greatest(F.length("q"), F.length("p"), F.lit(1))
    kept = measured.filter(near | (F.col("jaccard") >= min_similarity)).select(
        "q", "p", "distance",
        F.when(near, "damerau-levenshtein").otherwise("fuzzy-jaccard").alias("method"),
        F.bround(F.when(near, F.greatest(F.lit(0.0), 1 - F.col("distance") / longest)).otherwise(
            F.col("jaccard")), 4).alias("confidence"))
    hits = kept.join(packages.select(F.lower("name").alias("p"), F.col("name").alias("matched_package"),
                                     "ecosystem").distinct(), "p")
    order = Window.partitionBy("q").orderBy(F.desc("confidence"), "matched_package", "ecosystem")
    top = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_n)
    originals = names.select(F.col(name_col).alias("package_name")).distinct().withColumn(
        "q", F.lower(strip(F.col("package_name"))))
    return originals.join(top, "q").select(
        "package_name", "matched_package", "ecosystem", "distance", "method", "confidence", "rank")


def name_verdicts(names: DataFrame, packages: DataFrame, name_col: str = "name", **options) -> DataFrame:
    """Per distinct name: is it known, is it suspicious, how many matches it kept."""
    matches = lookalikes(names, packages, name_col, **options).groupBy("package_name").agg(
        F.count("*").alias("match_count"))
    known = packages.select(F.lower("name").alias("q"), F.lit(True).alias("known")).distinct()
    distinct = names.select(F.col(name_col).alias("package_name")).filter(F.col(name_col).isNotNull()).distinct()
    return (distinct.withColumn("q", F.lower(strip(F.col("package_name"))))
            .join(known, "q", "left").join(matches, "package_name", "left")
            .select("package_name", F.coalesce("known", F.lit(False)).alias("exact_match_found"),
                    (F.coalesce("match_count", F.lit(0)) > 0).alias("is_suspicious"),
                    F.coalesce("match_count", F.lit(0)).alias("match_count")))


# ------------------------------------------------------------ import verdicts
def popular_frame(spark: SparkSession, names=config.POPULAR_PACKAGES) -> DataFrame:
    """The popular names in list order; a fixed list, so small enough to broadcast."""
    values = ", ".join(f"({i}, '{n}')" for i, n in enumerate(names))
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(position, popular)")


def import_verdicts(imports: DataFrame, registry: DataFrame | None = None,
                    popular=config.POPULAR_PACKAGES, max_distance: int = 2) -> DataFrame:
    """Risk of every imported (package, language).

    Runtime modules are safe; otherwise the first popular name, in list order,
    within 1..`max_distance` plain edits makes it a danger; otherwise presence
    in the registry snapshot decides. Without a snapshot the result is unknown.
    """
    distinct = imports.select("package", "language").distinct()
    builtin = ((F.col("language") == "python") & F.col("package").isin(*config.PYTHON_STDLIB)) | (
        (F.col("language") == "node") & F.col("package").isin(*config.NODE_BUILTINS))
    candidates = F.array(*[F.lit(p) for p in popular])
    lower = F.lower("package")
    close = F.filter(candidates, lambda p: F.levenshtein(lower, F.lower(p)).between(1, max_distance))
    judged = distinct.select("package", "language", builtin.alias("is_stdlib"),
                             F.when(~builtin, F.get(close, F.lit(0))).alias("typosquat_of"))
    if registry is not None:
        listed = registry.select("package", "language", F.lit(True).alias("listed")).distinct()
        judged = judged.join(listed, ["package", "language"], "left").withColumn(
            "listed", F.coalesce("listed", F.lit(False)))
    else:
        judged = judged.withColumn("listed", F.lit(None).cast("boolean"))
    typo = F.col("typosquat_of").isNotNull()
    return judged.select(
        "package", "language", "is_stdlib", "typosquat_of",
        F.when(F.col("is_stdlib"), True).when(typo, None).otherwise(F.col("listed")).alias("exists"),
        F.when(F.col("is_stdlib"), "safe").when(typo, "danger").when(F.col("listed"), "safe")
        .when(~F.col("listed"), "danger").otherwise("unknown").alias("risk"),
        F.when(F.col("is_stdlib") & (F.col("language") == "python"), "Standard library")
        .when(F.col("is_stdlib"), "Node.js builtin")
        .when(typo, F.concat(F.lit("Possible typosquat of '"), "typosquat_of", F.lit("'")))
        .when(F.col("listed"), "Found in registry")
        .when(~F.col("listed"), "Not in registry").otherwise("No registry snapshot").alias("message"))
