"""The near_dedup stage of the pipeline beside all pairs by exact five-word Jaccard."""

import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from usagelens import session
from usagelens.llm import common, near_copies, queries, simhash


def plain_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_kept(docs):
    """(id, text) rows: the smallest id of each component, all pairs compared; None where no member has one."""
    ids = defaultdict(list)
    for i, t in docs:
        ids[plain_set(t)].append(i)
    root = {s: s for s in ids}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    for a, b in combinations(ids, 2):
        if a and b and 5 * len(a & b) >= 4 * len(a | b):
            root[find(a)] = find(b)
    groups = defaultdict(list)
    for s, members in ids.items():
        groups[find(s)] += [i for i in members if i is not None]
    return sorted((min(g, default=None) for g in groups.values()), key=repr)


def kept(frame):
    return sorted((r.doc_id for r in near_copies.representatives(frame).collect()), key=repr)


def test_stage_against_all_pairs(spark, folder):
    docs = queries.table(spark, folder, "documents")
    got = sorted((r.doc_id for r in corpus_pipeline.near_copies_out(spark, docs, folder).collect()), key=repr)
    assert got == plain_kept([(r.doc_id, r.text) for r in docs.collect()])


def edited(words, *places):
    return " ".join(f"x{i}" if i in places else w for i, w in enumerate(words))


def test_planted_copies_go_and_others_stay(spark):
    words = [f"w{i}" for i in range(64)]
    rows = [(5, edited(words)), (4, edited(words, 30)),  # 55 of 65 shingles: a copy
            (9, edited(words, 30, 60)),  # reached only through document 4
            (7, edited(words[::-1])), (8, edited(words[::-1], 15, 45)),  # 50 of 70: no copy
            (20, "same words"), (21, "Same  WORDS"), (None, "same words"), (None, "only here"), (None, "ONLY here"), (30, None), (31, " ")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert kept(frame) == plain_kept(rows) == sorted([4, 7, 8, 20, 30, None], key=repr)


def test_one_row_of_each_group(odd, none, texts):
    assert kept(odd) == plain_kept(texts)  # lists, so that repeats are seen
    assert near_copies.representatives(odd).columns == odd.columns and near_copies.representatives(none).collect() == []


def test_pair_missed_by_no_band():
    hit = 0
    for n in range(300):
        words = [f"{n}-{i}" for i in range(64)]
        a, b = (set(near_copies.band_keys(near_copies.shingles(t.encode()))) for t in (edited(words), edited(words, 30)))
        hit += bool(a & b)
    assert hit == 300


def test_a_bucket_of_near_misses(spark):
    """600 texts that share most of their words, hardly any two of them at 0.8: all pairs are compared, few rows are made."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = [(n, " ".join(w if rng.random() > 0.02 else f"x{rng.randint(0, 40)}" for w in base)) for n in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = plain_kept(rows)
    assert 1 < len(wanted) < 600 and kept(frame) == wanted


@pytest.mark.parametrize("block", [3, 50])
def test_blocks_of_a_bucket_meet(spark, block):
    rng = random.Random(7)
    sets = [sorted(rng.sample(range(100_000 * (n % 4), 100_000 * (n % 4) + 14), 12)) for n in range(40)]
    held = spark.createDataFrame(list(enumerate(sets)), "v long, hashes array<int>")
    met = spark.createDataFrame([(9, n, n % 8) for n in range(40)], "key long, v long, label long")
    got = [(r.a, r.b) for r in near_copies.linked(met, held, block=block).collect()]
    pairs = [(a, b) for a, b in combinations(range(40), 2) if a % 8 != b % 8 and len({*sets[a]} & {*sets[b]}) >= 0.8 * len({*sets[a]} | {*sets[b]})]
    assert groups_of(got) == groups_of(pairs) and len(pairs) > 0 and len(got) < 40 * 15


def groups_of(pairs):
    root = list(range(40))
    for a, b in pairs:
        x, y = root[a], root[b]
        root = [min(x, y) if r in (x, y) else r for r in root]
    return root


def test_overlaps():
    rng = np.random.RandomState(2)
    sets = [np.unique(rng.randint(0, 60_000, n)).astype(np.int32) for n in (0, 1, 30_000, 30_000, 5)]
    got = near_copies.overlaps(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i, j in combinations(range(5), 2))


def test_repeated_rows_among_near_copies(spark):
    words = [f"w{i}" for i in range(64)]
    rows = [(4, edited(words)), (4, edited(words)), (5, edited(words, 30)), (5, edited(words, 30)), (6, "other text"), (None, "other text")]
    assert kept(spark.createDataFrame(rows, "doc_id long, text string")) == [4, 6]


def test_fingerprints_alone_bring_copies_together(spark, monkeypatch):
    """Two texts without a band in common are found by the components of their SimHash, and its links are verified too."""
    monkeypatch.setattr(near_copies, "band_keys", lambda hashes: [])
    words = [f"w{i}" for i in range(4000)]
    rows = [(1, edited(words)), (2, edited(words, 100, 120)), (3, "another text of seven words in all"), (4, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    prints = [simhash.fingerprint(t.encode(), 5) % 2**64 for _, t in rows[:2]]
    assert 0 < (prints[0] ^ prints[1]).bit_count() <= simhash.RADIUS and kept(frame) == [1, 3, 4]


def test_components_meet_by_their_labels(spark):
    """Links that come in three parts give the components of all links, and later parts bring in no earlier one."""
    rng = random.Random(3)
    parts = [[tuple(sorted(rng.sample(range(40), 2))) for _ in range(9)] for _ in range(3)]
    labels = None
    for part in parts:
        labels = near_copies._merged(labels, spark.createDataFrame(part, "a long, b long"))
    want = groups_of([p for part in parts for p in part])
    assert {r.v: r.label for r in labels.collect()} == {v: want[v] for part in parts for p in part for v in p}


def test_batches_are_taken_in_slices():
    """Work that keeps something of every row of a batch held that of 10,000 texts at a time."""
    batches = [pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64())], ["v"]) for n in (2500, 0, 3)]
    parts = list(common.sliced(iter(batches)))
    assert [p.num_rows for p in parts] == [1000, 1000, 500, 3]
    assert [v for p in parts for v in p.column(0).to_pylist()] == [*range(2500), *range(3)]


@pytest.mark.parametrize("stage", ["toxic_out", "near_copies_out", "tokens"])
def test_stages_get_few_whole_texts_at_once(spark, folder, stage):
    """Tasks held 10,000 texts at a time, in the executor and in its Python workers."""
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    before = spark.conf.get(session.BATCH_ROWS)
    try:
        spark.conf.set(session.BATCH_ROWS, 10_000)
        getattr(corpus_pipeline, stage)(spark, queries.table(spark, folder, "documents"), folder)
        assert max(r.n for r in spark.range(0, 2500, 1, 1).mapInArrow(sizes, "n long").collect()) <= 1000
    finally:
        spark.conf.set(session.BATCH_ROWS, before)


def test_links_meet_in_few_steps(spark, monkeypatch):
    """Linking what earlier links had joined took two tables besides those of the rounds."""
    written, plain = [], session.materialise
    monkeypatch.setattr(near_copies, "materialise", lambda df, label: written.append(label) or plain(df, label))
    first = near_copies._merged(None, spark.createDataFrame([(1, 2), (5, 6)], "a long, b long"))
    second = near_copies._merged(first, spark.createDataFrame([(2, 6), (8, 9)], "a long, b long"))
    assert {r.v: r.label for r in second.collect()} == {1: 1, 2: 1, 5: 1, 6: 1, 8: 8, 9: 8} and not written


def test_rounds_are_written_as_few_files(spark, monkeypatch):
    """Each round wrote a file for every partition of a shuffle, however few edges there were."""
    monkeypatch.setattr(near_copies, "FILE_ROWS", 40)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 30)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = near_copies._merged(None, spark.createDataFrame([(i, i + 1) for i in range(30)], "a long, b long"))
        assert {r.v: r.label for r in found.collect()} == dict.fromkeys(range(31), 0) and len(found.inputFiles()) <= 2
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
