import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from usagelens.functions import similarity as s
from usagelens.operators import packages as k


def osa(a, b):
    d = np.zeros((len(a) + 1, len(b) + 1), int)
    d[:, 0], d[0, :] = range(len(a) + 1), range(len(b) + 1)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            c = int(a[i - 1] != b[j - 1])
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + c)
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + c)
    return int(d[-1, -1])


def tokens(name):
    return [t for t in re.split(r"[-_.\s]+", name.lower()) if t]


def jaccard(a, b):
    x, y = tokens(a), tokens(b)
    if not x or not y:
        return 1.0 if not x and not y else 0.0
    hits = (sum(min(osa(t, u) for u in y) <= 1 for t in x) + sum(min(osa(t, u) for u in x) <= 1 for t in y)) / 2
    union = len(x) + len(y) - hits
    return 1.0 if union <= 0 else hits / union


@pytest.mark.parametrize("a,b,want", [
    ("", "", 0), ("", "abc", 3), ("abc", "", 3), ("same", "same", 0), ("reqeusts", "requests", 1), ("ca", "abc", 3),
    ("numppy", "numpy", 1), ("kitten", "sitting", 3), ("ab", "ba", 1), ("日本", "本日", 1)])
def test_distance(a, b, want):
    assert s.osa_batch([a, "pad"], [b, "padding"]).tolist() == [want, 4]


def test_built_in_forms(spark):
    random.seed(5)
    words = ["".join(random.choice("ab-c") for _ in range(random.randint(0, 6))) for _ in range(60)]
    pairs = [(a, b) for a in words[:30] for b in words[30:]]
    frame = spark.createDataFrame(pairs, "a string, b string").select(
        "a", "b", s.tokenize(F.col("a")).alias("x"), s.tokenize(F.col("b")).alias("y"),
        s.within_one_edit(F.col("a"), F.col("b")).alias("near"))
    for row in s.with_fuzzy_jaccard(frame, "x", "y").collect():
        assert row["near"] == (osa(row["a"], row["b"]) <= 1), row
        assert row["jaccard"] == pytest.approx(jaccard(row["a"], row["b"])), row
        assert row["x"] == tokens(row["a"])


def service(spark, *names, **options):
    packages = spark.createDataFrame([
        ("requests", "pypi"), ("numpy", "pypi"), ("pandas", "pypi"), ("flask", "pypi"), ("flask-sqlalchemy", "pypi"),
        ("python-dateutil", "pypi"), ("express", "npm"), ("lodash", "npm"), ("react", "npm")], "name string, ecosystem string")
    frame = spark.createDataFrame([(n,) for n in names], "name string")
    found = [(r["package_name"], r["matched_package"], r["ecosystem"]) for r in k.lookalikes(frame, packages, **options).collect()]
    verdicts = {r["package_name"]: (r["exact_match_found"], r["is_suspicious"]) for r in
                k.name_verdicts(frame, packages, **options).collect()}
    return found, verdicts


def test_service(spark):
    found, verdicts = service(spark, "requests", "Requests", "reqeusts", "numppy", "zzzzzzzzzzz", "recat",
                              "flask_sqlaclhemy", "flask_sqlalchemy")
    assert verdicts["requests"] == verdicts["Requests"] == (True, False)
    assert verdicts["zzzzzzzzzzz"] == (False, False)
    for name, package in (("reqeusts", "requests"), ("numppy", "numpy"), ("flask_sqlaclhemy", "flask-sqlalchemy"),
                          ("flask_sqlalchemy", "flask-sqlalchemy")):
        assert verdicts[name] == (False, True) and (name, package, "pypi") in found
    assert ("recat", "react", "npm") in found
    assert len(service(spark, "a", top_n=2)[0]) <= 2
    with pytest.raises(ValueError):
        service(spark, "a", max_distance=6)
    with pytest.raises(ValueError):
        service(spark, "a", min_similarity=0)


@pytest.mark.parametrize("distance,similarity", [(2, 0.6), (1, 0.9), (3, 0.34)])
def test_lookalikes_equal_brute_force(spark, distance, similarity):
    random.seed(3)
    parts = ["python", "js", "flask", "sql", "alchemy", "react", "dom", "ab", "a", "data", "node", "core", "pythn", "flsk"]
    known = [(random.choice("-_.").join(random.choice(parts) for _ in range(random.randint(1, 5))),
              random.choice(["pypi", "npm"])) for _ in range(100)] + [("-", "pypi"), ("A", "npm")]

    def mutate(word):
        chars = list(word)
        for _ in range(random.randint(0, 3)):
            i = random.randrange(max(1, len(chars)))
            action = random.randint(0, 3)
            if action == 0 and chars:
                del chars[i]
            elif action == 1:
                chars.insert(i, random.choice("abx-"))
            elif action == 2 and chars:
                chars[i] = random.choice("abx")
            elif len(chars) > 1:
                i %= len(chars) - 1
                chars[i], chars[i + 1] = chars[i + 1], chars[i]
        return "".join(chars)

    asked = [mutate(random.choice(known)[0]) for _ in range(100)] + ["_", "zzzz", " Flask "]
    want, exact = set(), {n.lower() for n, _ in known}
    for name in set(asked):
        low = name.lower().strip()
        for package, ecosystem in set() if low in exact else set(known):
            d = osa(low, package.lower())
            if 0 < d <= distance:
                want.add((name, package, ecosystem, d, "damerau-levenshtein", round(1 - d / max(len(low), len(package), 1), 4)))
            elif jaccard(low, package) >= similarity:
                want.add((name, package, ecosystem, d, "fuzzy-jaccard", round(jaccard(low, package), 4)))
    got = k.lookalikes(spark.createDataFrame([(a,) for a in asked], "name string"),
                       spark.createDataFrame(known, "name string, ecosystem string"), top_n=10**6,
                       max_distance=distance, min_similarity=similarity)
    assert {(r["package_name"], r["matched_package"], r["ecosystem"], r["distance"], r["method"], r["confidence"])
            for r in got.collect()} == {(*w[:5], max(0.0, w[5])) for w in want}


def test_import_verdicts(spark):
    imports = spark.createDataFrame([("os", "python"), ("fs", "node"), ("numpi", "python"), ("requests", "python"),
                                     ("ghostlib", "python"), ("fs", "python")], "package string, language string")
    registry = spark.createDataFrame([("requests", "python")], "package string, language string")
    got = {(r["package"], r["language"]): (r["risk"], r["typosquat_of"]) for r in k.import_verdicts(imports, registry).collect()}
    assert got == {("os", "python"): ("safe", None), ("fs", "node"): ("safe", None), ("numpi", "python"): ("danger", "numpy"),
                   ("requests", "python"): ("safe", None), ("ghostlib", "python"): ("danger", None), ("fs", "python"): ("danger", None)}
    unknown = {r["package"]: r["risk"] for r in k.import_verdicts(imports).collect()}
    assert unknown["ghostlib"] == "unknown"


def test_ngram_cosine(spark):
    pairs = spark.createDataFrame([(1, "hello world", "hello world"), (2, "ab", "ab"), (3, "abc", "xyz"), (4, "", ""),
                                   (5, "banana", "bananas"), (6, "a", "aaaa")], "id int, a string, b string")

    def grams(x, n=3):
        out = {}
        for g in ([x] if len(x) < n else [x[i:i + n] for i in range(len(x) - n + 1)]):
            out[g] = out.get(g, 0) + 1
        return out

    def cosine(a, b):
        x, y = grams(a), grams(b)
        dot = sum(v * y.get(g, 0) for g, v in x.items())
        return round(dot / (sum(v * v for v in x.values()) ** .5 * sum(v * v for v in y.values()) ** .5), 3)

    got = {r["id"]: r["similarity"] for r in s.ngram_cosine(pairs, ["id"], "a", "b", 0).collect()}
    assert got == {r["id"]: cosine(r["a"], r["b"]) for r in pairs.collect()}


def test_names_that_share_one_common_token_do_not_meet(spark):
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnprst"]
    known = spark.createDataFrame([(f"lib-{w}-{v}core{i}",) for i, (w, v) in enumerate(zip(words, words[::-1]))], "p string")
    asked = spark.createDataFrame([(f"lib-{w}{w}-{v}",) for w, v in zip(words, words[3:])], "q string")
    pairs = k._token_candidates(asked, known, 0.6).distinct().count()
    assert pairs < 0.02 * len(words) ** 2


def test_tokens_with_many_partners_meet_all_the_same(spark):
    short = [chr(c) for c in range(97, 123)] + [f"{chr(c)}{chr(d)}" for c in range(97, 105) for d in range(97, 105)]
    packages = spark.createDataFrame([(f"{a}-{b}", "npm") for a, b in zip(short, short[1:])], "name string, ecosystem string")
    names = [f"{a}.{b}" for a, b in zip(short[::3], short[5::3])] + ["a-b-c-d", "a.a.b"]
    got = k.lookalikes(spark.createDataFrame([(n,) for n in names], "name string"), packages, top_n=10**6, max_distance=1, min_similarity=0.6)
    exact = {r.name for r in packages.collect()}
    want = {(n, r.name) for n in names if n not in exact for r in packages.collect() if 0 < osa(n, r.name) <= 1 or jaccard(n, r.name) >= 0.6}
    assert {(r.package_name, r.matched_package) for r in got.collect()} == want and len(want) > 100
