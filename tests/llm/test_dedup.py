"""Exact dedup, its cuckoo filter, and SimHash near-dedup."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from usagelens.llm import exact_dedup as X
from usagelens.llm import simhash as S
from usagelens.llm.components import connected_components
from usagelens.llm.cuckoo import CuckooFilter


def key(n):
    return hashlib.sha256(str(n).encode()).digest()


def test_filter_inserts_deletes_and_grows():
    small = CuckooFilter(8)
    stored = []
    for n in range(200):
        if not small.insert(key(n)):
            break
        stored.append(n)
    assert 16 <= len(stored) <= 32 and all(key(n) in small for n in stored)  # a failed insert leaves all entries in place
    large = CuckooFilter.of([key(n) for n in range(5000)], 8)
    assert all(key(n) in large for n in range(5000))
    assert sum(key(n) in large for n in range(5000, 15_000)) < 20
    for n in range(0, 5000, 2):
        assert large.delete(key(n))
    assert all(key(n) in large for n in range(1, 5000, 2))
    assert sum(key(n) in large for n in range(0, 5000, 2)) < 10
    again = CuckooFilter.from_bytes(large.to_bytes())
    assert all(key(n) in again for n in range(1, 5000, 2))


def lowered(text):
    return (text or "").encode().lower()


def test_exact_dedup(odd, texts):
    got = X.exact_dedup(odd).collect()
    groups = defaultdict(list)
    for i, t in texts:
        groups[hashlib.sha256(lowered(t)).hexdigest()].append(i)
    assert len(got) == len(texts)
    for r in got:
        members = groups[r.text_sha256]
        known = [i for i in members if i is not None]
        assert r.doc_id in members and r.group_size == len(members)
        assert r.keep_id == (max(known) if known else None) and r.kept == (r.doc_id == r.keep_id)


def test_exact_dedup_of_nothing(none):
    assert X.exact_dedup(none).collect() == [] and X.kept_documents(none).columns == none.columns


def test_kept_documents(odd):
    got = X.kept_documents(odd)
    assert got.columns == odd.columns
    assert sorted(r.doc_id for r in got.collect()) == [3, *range(5, 19)]


def test_index_inserts_and_deletes(spark):
    frame = lambda items: spark.createDataFrame([(i, key(k)) for i, k in items], "doc_id long, digest binary")
    facts = lambda index: {(bytes(r.digest), r.keep_id, r.group_size) for r in index.groups().collect()}
    index = X.build(frame([(1, "a"), (2, "a"), (3, "b")]))
    assert facts(index) == {(key("a"), 2, 2), (key("b"), 3, 1)}
    index = X.insert(index, frame([(9, "a"), (4, "c"), (5, "c")]))
    assert facts(index) == {(key("a"), 9, 3), (key("b"), 3, 1), (key("c"), 5, 2)}
    index = X.delete(index, spark.createDataFrame([(9,), (3,)], "doc_id long"))
    assert facts(index) == {(key("a"), 2, 2), (key("c"), 5, 2)}
    filters = [CuckooFilter.from_bytes(bytes(r.filter)) for r in index.table.filter("filter is not null").collect()]
    holds = lambda k: any(key(k) in f for f in filters)
    assert holds("a") and holds("c") and not holds("b")
    index = X.insert(index, frame([(3, "b")]))
    assert facts(index) == {(key("a"), 2, 2), (key("b"), 3, 1), (key("c"), 5, 2)}


def plain_print(text):
    words = lowered(text).split()
    if not words:
        return 0
    runs = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@given(st.lists(st.sampled_from(["a", "B", "é", " ", "long"]), max_size=30))
@settings(max_examples=60, deadline=None)
def test_fingerprint(words):
    text = " ".join(words)
    assert S.fingerprint(text.encode()) % 2**64 == plain_print(text)


def plain_components(prints, radius=2):
    """prints: {id: fingerprint}; {id: smallest id reachable}."""
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if bin(prints[a] ^ prints[b]).count("1") <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near_duplicates(odd, texts):
    got = S.near_duplicates(odd).collect()
    prints = {i: plain_print(t) for i, t in texts if i is not None}
    wanted = plain_components(prints)
    assert len(got) == len(texts)
    for r in got:
        if r.doc_id is not None:
            assert int(r.fingerprint, 16) == prints[r.doc_id] and r.component_id == wanted[r.doc_id]
    assert {r.component_id for r in got if r.doc_id is None} == {12, 4}  # by fingerprint alone


def test_near_duplicates_of_nothing(none):
    assert S.near_duplicates(none).collect() == [] and S.representatives(none).columns == none.columns


def test_representatives_are_one_per_group(odd, texts):
    got = sorted(r.doc_id for r in S.representatives(odd).collect())
    wanted = plain_components({i: plain_print(t) for i, t in texts if i is not None})
    assert sorted(set(got)) == sorted(set(wanted.values()))


def scattered(n, seed):
    """Fingerprints in balls around few centres, so that buckets are full."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(4)]
    out = set()
    while len(out) < n:
        f = rng.choice(centres)
        for _ in range(rng.randint(0, 6)):
            f ^= 1 << rng.randrange(64)
        out.add(f)
    return sorted(out)


def test_links_are_all_pairs_within_the_radius():
    prints = np.array(scattered(300, 3), dtype=np.uint64)
    bucket = np.repeat([0, 1, 2], 100)
    found = {(int(i), int(j)) for a, b in S.links(bucket, prints) for i, j in zip(a, b)}
    wanted = {(i, j) for i in range(300) for j in range(i + 1, 300) if bucket[i] == bucket[j] and bin(int(prints[i] ^ prints[j])).count("1") <= 2}
    assert found == wanted


def test_split_buckets_lose_no_link(spark):
    prints = scattered(250, 5)
    signed = [(f - 2**64 if f >> 63 else f, i) for i, f in enumerate(prints)]
    vertices = spark.createDataFrame(signed, "fp long, v long")
    for most in (2_000, 3):
        near = S.candidate_rows(vertices, most).repartition("kind", "key").sortWithinPartitions("kind", "key", "v")
        labels = {r.v: r.label for r in connected_components(near.mapInArrow(S._bucket_edges, "a long, b long")).collect()}
        wanted = plain_components(dict(enumerate(prints)))
        assert {i: labels.get(i, i) for i in range(250)} == wanted


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7)]
    labels = {r.v: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert labels == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}}


def test_rows_without_id_link_others(spark, monkeypatch):
    prints = spark.createDataFrame([(1, 0), (None, 3), (2, 15), (None, 15 << 40), (7, -1), (None, -1), (3, 15)], "doc_id long, fp long")
    monkeypatch.setattr(S, "fingerprints", lambda docs, id_col, text_col: prints)
    got = sorted(((r.doc_id, r.fingerprint[-2:], r.component_id) for r in S.near_duplicates(prints).collect()), key=repr)
    assert got == sorted([(1, "00", 1), (None, "03", 1), (2, "0f", 1), (3, "0f", 1), (None, "00", None), (7, "ff", 7), (None, "ff", 7)], key=repr)
