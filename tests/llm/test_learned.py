"""Toxicity, quality, nearest neighbours, the pipeline, and registered queries beside their SQL."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import sentencepiece

import check
import corpus_pipeline
from test_near_copies import plain_kept
from usagelens.llm import ann, pieces, quality, queries, sql, toxicity
from usagelens.llm.exact_dedup import exact_dedup
from usagelens.llm.mixing import mix
from usagelens.llm.simhash import near_duplicates

BAD, GOOD = "vile rotten filthy crude".split(), "kind warm gentle bright".split()


@pytest.fixture(scope="module")
def judged(spark):
    """Documents whose label hangs on a few words among noise, and repeated or missing labels."""
    rng = np.random.RandomState(3)
    docs, labels = [], []
    for i in range(900):
        words = [f"n{rng.randint(400)}" for _ in range(60)]
        bad = i % 5 == 0
        for w in rng.choice(BAD if bad else GOOD, 3):
            words.insert(rng.randint(60), w)
        docs.append((i, " ".join(words) if not bad or i % 2 else " ".join(words).upper() + " !!! !!!", "x"))
        labels.append((i, int(not bad), int(bad)))
    docs += [(9000, None, "x"), (9001, "", "x"), (9002, "vile " * 100_000, "x"), (None, "kind warm", "x"), (9002, "gentle", "x")]
    labels += [(0, None, None), (None, 1, 1), (12345, 1, 0), (5, None, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def hold(i):
    return i is not None and zlib.crc32(str(i).encode()) % 3 == 1


@pytest.mark.parametrize("module,column,threshold", [(toxicity, "toxic", 0.7), (quality, "quality", 0.5)])
def test_classifiers(judged, module, column, threshold):
    docs, labels = judged
    got = module.score(docs, module.fit(docs, labels)).collect()
    assert len(got) == docs.count()
    truth = {i: int(i % 5 == 0) if column == "toxic" else int(i % 5 != 0) for i in range(900)}
    apart = [r for r in got if r.doc_id is not None and r.doc_id < 900 and r.held_out]
    assert len(apart) > 200 and all(r.held_out == hold(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= threshold) for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in apart]) > 0.9
    if column == "toxic":
        assert {r.predicted for r in got if r.doc_id in (9000, 9001)} == {0}
        assert max(r.score for r in got if r.doc_id == 9002) > 0.7


def test_labels_of_held_out_rows_are_not_read(judged):
    docs, labels = judged
    cut = labels.filter("crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1")
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, cut)
    assert a.bias == b.bias and (a.places == b.places).all() and (a.weights == b.weights).all()


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifiers_without_rows(judged, module):
    docs, labels = judged
    blind = module.fit(docs.limit(3), labels.limit(0))
    assert {r.score for r in module.score(docs.limit(3), blind).collect()} == {0.5}
    assert module.score(docs.limit(0), blind).collect() == []


def test_clean_documents(judged):
    docs, labels = judged
    got = toxicity.clean_documents(docs, labels)
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).filter("predicted = 0")
    assert got.columns == docs.columns
    assert Counter(r.doc_id for r in got.collect()) == Counter(r.doc_id for r in scored.collect())


def test_features_hold_pairs_and_skips():
    n = len(toxicity.features("aa bb cc dd"))
    assert n == 4 + 0 + 3 + 2 and len(toxicity.features("")) == 0
    assert set(toxicity.features("Aa BB")) == set(toxicity.features("aa bb")) and len(toxicity.features("longer words")) == 2 + 2 + 1


def test_network_learns_what_a_line_cannot():
    rng = np.random.RandomState(0)
    x = rng.randn(3000, 4)
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    net = quality.train(x, y, np.arange(3000) % 10 == 0)
    fresh = rng.randn(1000, 4)
    assert ((net.scores(fresh) > 0.5) == (fresh[:, 0] * fresh[:, 1] > 0)).mean() > 0.9 and 0.25 <= net.temperature <= 8


def vectors(n=1200, d=16, seed=1):
    rng = np.random.RandomState(seed)
    v = np.where(np.arange(n)[:, None] % 3 == 0, rng.randn(n, d), rng.randn(7, d)[np.arange(n) % 7] + 0.02 * rng.randn(n, d)).astype(np.float32)
    return [(i, [float(x) for x in r], "x") for i, r in enumerate(v)]


ODD = [(2000, None, "x"), (2050, [0.0] * 16, "x"), (2051, [float("nan")] + [1.0] * 15, "x"), (2052, [float("inf")] + [1.0] * 15, "x"), (2053, [None] + [1.0] * 15, "x"),
       (2054, [1.0] * 3, "x"), (2055, [], "x"), (None, [1.0] * 16, "x"), (100, vectors()[100][1], "x")]


def plain_nearest(rows, queries_, k=5):
    good = {i: np.array(v, dtype=np.float64) for i, v, _ in rows if i is not None and v is not None and len(v) == 16 and None not in v
            and np.isfinite(v).all() and np.any(v)}
    ids = np.array(sorted(good))
    unit = np.array([good[i] / np.sqrt(good[i] @ good[i]) for i in ids])
    out = {}
    for q in queries_:
        if q in good:
            s = np.where(ids == q, -9, unit @ unit[np.searchsorted(ids, q)])
            out[q] = [(int(ids[n]), s[n]) for n in np.lexsort((ids, -s.round(12)))[:k] if ids[n] != q]
    return out


def test_nearest(spark):
    copies = [(3000 + i, vectors()[50][1], "x") for i in range(40)]  # many equal vectors
    rows = vectors() + ODD + copies
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, node string")
    wanted = plain_nearest(rows, [r[0] for r in rows if r[0] is not None and r[0] % 50 == 0])
    found = {}
    for r in ann.nearest(frame, ann.F.col("vec_id") % 50 == 0).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(found) == set(wanted)
    hits = 0
    for q, near in found.items():
        near.sort()
        assert [n[0] for n in near] == [1, 2, 3, 4, 5] and q not in [n[1] for n in near]
        assert [(-n[2], n[1]) for n in near] == sorted((-n[2], n[1]) for n in near)
        hits += len({n[1] for n in near} & {i for i, _ in wanted[q]})
    assert hits >= 0.95 * 5 * len(wanted)
    assert [n[1] for n in found[50]] == [3000, 3001, 3002, 3003, 3004] and [n[1] for n in found[3000]] == [50, 3001, 3002, 3003, 3004]


def test_nearest_among_few(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (50, [-1.0, 0.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in ann.nearest(frame, ann.F.col("vec_id") % 50 == 0).collect())
    assert got == [(0, 1, 3, 0.707107), (0, 2, 50, -1.0), (50, 1, 3, -0.707107), (50, 2, 0, -1.0)]
    assert ann.nearest(frame.limit(0), ann.F.col("vec_id") % 50 == 0).collect() == []
    assert ann.nearest(frame.limit(1), ann.F.col("vec_id") % 50 == 0).collect() == []


def test_toxic_documents_go(spark, judged, tmp_path):
    docs, labels = judged
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    left = Counter(r.doc_id for r in corpus_pipeline.toxic_out(spark, docs, str(tmp_path)).collect())
    bad, good = [i for i in range(900) if i % 5 == 0], [i for i in range(900) if i % 5]
    assert sum(i in left for i in bad) <= 0.05 * len(bad) and sum(i in left for i in good) >= 0.98 * len(good)
    assert left[None] == 1 and left[9000] == left[9001] == 1 and left[9002] <= 1  # nulls, empty and clean stay, the toxic row of 9002 goes


def plain_copies(docs):
    """How often the mix may emit each document, from the statement of the contract's mixture run by another engine."""
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    return {i: round(taken / size) if size else None for i, size, taken in con.execute(f"SELECT doc_id, size, taken FROM ({sql.OP8})").fetchall()}


def test_pipeline_against_plain_stages(spark, folder):
    """Every stage's rows follow from its own input, as plain versions that share no code with the stages have them."""
    docs = queries.table(spark, folder, "documents")
    library = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    for name, stage in corpus_pipeline.STAGES:
        made = corpus_pipeline.materialise(stage(spark, docs, folder), "test")
        before, after = docs.collect(), made.collect()
        left = Counter(r.doc_id for r in after)
        if name == "toxicity":
            toxic = {r.doc_id: r.toxic for r in queries.table(spark, folder, "labels").collect()}
            good = [r.doc_id for r in before if toxic.get(r.doc_id) == 0]  # test_toxic_documents_go has enough toxic ones to learn from
            assert len(good) > 50 and sum(i in left for i in good) >= 0.95 * len(good)
        elif name == "exact_dedup":
            groups = {}
            for r in before:
                lowered = (r.text or "").encode().lower()
                groups[lowered] = max(r.doc_id, groups.get(lowered, r.doc_id))
            assert sorted(r.doc_id for r in after) == sorted(groups.values())
        elif name == "near_dedup":
            assert sorted((r.doc_id for r in after), key=repr) == plain_kept([(r.doc_id, r.text) for r in before])
        elif name == "mix":
            wanted = plain_copies(docs)
            assert left == Counter({i: n for i, n in wanted.items() if n}) + Counter({i: left[i] for i, n in wanted.items() if n is None and left[i]})
        else:
            assert sorted((r.doc_id, list(r.ids)) for r in after) == sorted((r.doc_id, library.encode(r.text or "")) for r in before)
        if name != "tokens":
            assert made.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            texts = {(r.doc_id, r.text) for r in before}
            assert after and all((r.doc_id, r.text) in texts for r in after)
        docs = made


def test_pipeline_stages_with_odd_documents(spark, odd, none, folder):
    for start in (odd, none):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.materialise(stage(spark, docs, folder), "odd")
            assert name == "tokens" or docs.columns == start.columns
        assert docs.count() > 0 if start is odd else docs.count() == 0


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_registered_query(spark, folder, name):
    text, good = check.compare(spark, folder, name, queries.queries()[name], queries.oracle_sql().get(name))
    assert good, text


def test_results_fit_the_contracts(spark, folder):
    docs = queries.table(spark, folder, "documents")
    assert exact_dedup(docs).count() == docs.count() == near_duplicates(docs).count()
    assert pieces.digests(pieces.encode(docs, queries.piece_model())).dtypes == [
        ("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
