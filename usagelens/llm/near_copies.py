"""Near copies by the similarity of their word shingles, for stages that remove them.

Two texts are near copies if the sets of their five-word shingles have a Jaccard
similarity of 0.8 or more; groups are the connected components. Texts with the
same set fold to one vertex. Vertices meet in buckets: the components of their
SimHash fingerprints, by the operator of `simhash.py` over five-word shingles,
and, for the copies that differ in more bits than it links, equal MinHash bands
(`BANDS` of `ROWS` minima: a pair at 0.8 meets nowhere with a chance of 5 in
100,000). Every link is verified by the exact Jaccard of the sets.

A bucket's members meet one centre first, another one each round, as long as that
links enough of them. Buckets whose members are then still in different components
are compared whole inside tasks, in blocks of members, and only a spanning forest
of the links leaves a task: rows grow with members, never with pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import attach_by_key, sliced, text_of, unused
from usagelens.llm.components import connected_components
from usagelens.llm.simhash import _forest, grouped, majority
from usagelens.session import materialise

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
BANDS, ROWS = 25, 5
#: Another centre is tried while more than this share of the pairs are links; it changes the work, not the result.
WORTH = 0.05
#: Members of a bucket that are compared with as many others in one task.
BLOCK = 256
#: Edges for each file that a round of component labels is written to.
FILE_ROWS = 100_000
_RANDOM = np.random.RandomState(SEED)
FACTORS, OFFSETS = (_RANDOM.randint(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingle hashes of a UTF-8 text, sorted; a shorter text is one shingle, a text without words has none."""
    words = text.lower().split()  # bytes know ASCII case and ASCII white space only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    runs = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) >= size else [b" ".join(words)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(r, SEED) for r in runs), dtype=np.uint64))


def band_keys(hashes: np.ndarray) -> list[int]:
    """One key per band, the number of the band included; none for an empty set."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[at:at + 1024, None] * FACTORS + OFFSETS).min(axis=0), out=least)
    packed = least.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(packed[b].tobytes(), b) - 2**63 for b in range(BANDS)]


def _texts(docs: DataFrame) -> DataFrame:
    text = text_of(F.col("text"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.cast("binary").alias("t"))


def _vertex(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED) - 2**63


def _print(hashes: np.ndarray) -> int:
    return majority(hashes.astype(">u8").view(np.uint8).reshape(-1, 8)) if len(hashes) else 0


def signatures(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, th, v, n, fp, keys) of every row: hash of the text, vertex (hash of the shingle set), size of the set, SimHash, band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = [shingles(t.as_py(), shingle) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(map(_vertex, sets), pa.int64()), pa.array(map(len, sets), pa.int64()),
                 pa.array(map(_print, sets), pa.int64()), pa.array(map(band_keys, sets), pa.list_(pa.int64()))], ["doc_id", "th", "v", "n", "fp", "keys"])

    return _texts(docs).mapInArrow(run, "doc_id long, th long, v long, n long, fp long, keys array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(v, hashes) for the texts whose hash is in `wanted` (th); hashes of 32 bits, half of what travels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = [shingles(t.as_py(), shingle) for t in batch.column(0)]
            short = [np.unique((s >> np.uint64(32)).astype(np.uint32)).view(np.int32) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(map(_vertex, sets), pa.int64()), pa.array(short, pa.list_(pa.int32()))], ["v", "hashes"])

    found = _texts(docs).join(wanted, "th", "left_semi").select("t").mapInArrow(run, "v long, hashes array<int>")
    return found.groupBy("v").agg(F.first("hashes").alias("hashes"))


def verified(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    left = attach_by_key(pairs.select("a", "b"), sets.select(F.col("v").alias("a"), F.col("hashes").alias("ha")), "a", "b")
    both = attach_by_key(left, sets.select(F.col("v").alias("b"), F.col("hashes").alias("hb")), "b", "a")
    common = both.select("a", "b", F.size(F.array_intersect("ha", "hb")).alias("i"), (F.size("ha") + F.size("hb")).alias("s"))
    return common.filter(F.col("i") >= similarity * (F.col("s") - F.col("i")) - 1e-9).select("a", "b")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections; only values that two sets share are laid out as bits, some thousand at a time."""
    owner = np.repeat(np.arange(len(sets)), list(map(len, sets)))
    values, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[place] > 1
    column = np.cumsum(times > 1)[place[shared]] - 1
    owner, out = owner[shared], np.zeros((len(sets), len(sets)), dtype=np.int64)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, 1 << 14):
        here = slice(*np.searchsorted(column, [low, low + (1 << 14)]))
        bits = np.zeros((len(sets), 1 << 14), dtype=bool)
        bits[owner[here], column[here] - low] = True
        words = np.packbits(bits, axis=1).view(np.uint64)
        for i in range(len(sets) - 1):
            out[i, i + 1:] += np.bitwise_count(words[i] & words[i + 1:]).sum(axis=1, dtype=np.int64)
    return out


def _linked(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Spanning edges between labels in each block pair; rows (key, i, j, block, v, label, hashes) come sorted by the first three."""

    def edges(rows: list[tuple]) -> tuple[list[int], list[int]]:
        label = np.array([r[5] for r in rows])
        if (label == label[0]).all():
            return [], []
        sets = [r[6] for r in rows]
        block, sizes = np.array([r[3] for r in rows]), np.array(list(map(len, sets)))
        common = overlaps(sets)
        near = np.triu((common >= similarity * (sizes[:, None] + sizes - common) - 1e-9) & (label[:, None] != label), 1)
        if rows[0][1] != rows[0][2]:
            near &= block[:, None] != block  # pairs within a block meet elsewhere
        root = _forest(len(rows), iter([np.nonzero(near)]))
        moved = np.flatnonzero(root != np.arange(len(rows)))
        return [rows[i][4] for i in moved], [rows[i][4] for i in root[moved]]

    def found() -> Iterator[tuple[list[int], list[int]]]:
        held: list[tuple] = []
        for batch in batches:
            plain = [batch.column(c).to_pylist() for c in range(6)]
            values, ends = batch.column(6).values.to_numpy(), batch.column(6).offsets.to_numpy()
            for n, row in enumerate(zip(*plain)):
                if held and held[0][:3] != row[:3]:
                    yield edges(held)
                    held = []
                held.append((*row, values[ends[n]:ends[n + 1]]))
            held = [(*r[:6], np.array(r[6])) for r in held]
        if held:
            yield edges(held)

    for a, b in found():
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def linked(met: DataFrame, sets: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(a, b): links that connect whatever the members of each bucket of `met` (key, v, label) connect, all its pairs compared.

    A bucket of more than `block` members is dealt into blocks, and every two of them meet in one group of a task.
    """
    parts = met.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    dealt = attach_by_key(met.select("key", "v", "label"), parts, "key", "v").withColumn("block", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int"))
    other = dealt.select("key", "v", "label", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    groups = other.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "v", "label")
    placed = groups.join(sets, "v").select("key", "i", "j", "block", "v", "label", "hashes").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return placed.mapInArrow(lambda batches: _linked(batches, similarity), "a long, b long").distinct()


def _far_in_size(similarity: float) -> Column:
    """Sets whose sizes differ too much to be similar."""
    return F.least("na", "nb") < similarity * F.greatest("na", "nb") - 1e-9


def _centre_pairs(met: DataFrame, turn: int) -> DataFrame:
    """Each bucket's members (key, v, n, label) with one centre of the bucket, where their labels differ."""
    centres = met.groupBy("key").agg(F.min_by(F.struct("v", "n", "label"), F.xxhash64("v", F.lit(turn))).alias("c"))
    paired = attach_by_key(met, centres, "key", "v").filter("label <> c.label")
    return paired.select(F.least("v", "c.v").alias("a"), F.greatest("v", "c.v").alias("b"), F.col("n").alias("na"), F.col("c.n").alias("nb"))


def _still_open(keyed: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The members (key, v, n, label) of buckets that hold more than one component."""
    named = keyed.withColumn("label", F.col("v"))
    if labels is not None:
        known = keyed.select("v").distinct().join(labels, "v", "left").select("v", F.coalesce("label", "v").alias("label"))
        named = attach_by_key(keyed, known, "v", "key")
    open_ = named.groupBy("key").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).filter("_low <> _high").select("key")
    return materialise(named.join(open_, "key", "left_semi"), "copies-met")


def _merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """(v, label) of every vertex linked so far. Of links taken in before only a vertex's edge to its label comes back."""
    if labels is not None:
        links = links.select("a", "b").unionByName(labels.select(F.col("v").alias("a"), F.col("label").alias("b")))
    return connected_components(links, label="copies", file_rows=FILE_ROWS)


def _buckets(vertices: DataFrame) -> DataFrame:
    """(v, n, key): the buckets of each vertex, one per band and one for the component of its fingerprint."""
    known = vertices.filter("n > 0")
    groups = grouped(materialise(known.select("fp").distinct(), "copies-prints"), "copies-simhash", FILE_ROWS)
    bands = known.select("v", "n", F.explode("keys").alias("key"))
    return bands.unionByName(attach_by_key(known.select("v", "n", "fp"), groups, "fp", "v").select("v", "n", F.xxhash64(F.lit("simhash"), "label").alias("key")))


def components(docs: DataFrame, rows: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(v, label) of the vertices of `rows` that are linked to another."""
    vertices = materialise(rows.groupBy("v").agg(F.min("th").alias("th"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "copies-vertices")
    keyed = _buckets(vertices)
    shared = keyed.groupBy("key").agg(F.count("*").alias("_n")).filter("_n > 1").select("key")
    keyed = materialise(keyed.join(shared, "key", "left_semi"), "copies-buckets")
    # Written first, so that its size is known: a small table goes to the texts, and only a large one makes the texts move.
    wanted = materialise(vertices.select("v", "th").join(keyed.select("v").distinct(), "v", "left_semi").select("th"), "copies-wanted")
    sets = materialise(shingle_sets(docs, wanted, shingle), "copies-sets")
    tried = labels = None
    turn, worth = 0, True
    while worth:
        met = _still_open(keyed, labels)
        pairs = _centre_pairs(met, turn).filter(~_far_in_size(similarity)).select("a", "b").distinct()
        pairs = materialise(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "copies-pairs")
        found = materialise(verified(pairs, sets, similarity), "copies-links")
        n_found, n_pairs = found.count(), pairs.count()
        if n_found:
            labels = _merged(labels, found)
        tried = pairs if tried is None else tried.unionByName(pairs)
        turn, worth = turn + 1, n_found > WORTH * n_pairs
    found = materialise(linked(_still_open(keyed, labels), sets, similarity), "copies-links")
    if not found.isEmpty():
        labels = _merged(labels, found)
    return vertices.select("v", F.col("v").alias("label")).limit(0) if labels is None else labels


def representatives(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group of near copies, with its own columns: the smallest id, a null id only if the group has no other.

    Null texts are empty, and texts without words are one group.
    """
    rows = materialise(signatures(docs, shingle), "copies-rows")
    labels = components(docs, rows, shingle, similarity)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "th"))
    vertices = rows.groupBy("v").agg(best.alias("best"))
    kept = vertices.join(labels, "v", "left").groupBy(F.coalesce("label", "v").alias("label")).agg(F.min("best").alias("best"))
    kept = kept.select("best.doc_id", "best.th").withColumn("_stays", F.lit(True))
    # (id, text) pairs that go, or that several rows have: few beside the rest, whose texts then need not move.
    texts = rows.groupBy("doc_id", "th").agg(F.count("*").alias("_n"))
    judged = texts.join(kept, texts["doc_id"].eqNullSafe(kept["doc_id"]) & (texts["th"] == kept["th"]), "left").select(
        texts["doc_id"], texts["th"], "_n", F.coalesce("_stays", F.lit(False)).alias("_stays"))
    th, own, wanted, text = (unused(docs, name) for name in ("_th", "_own", "_keptid", "_kepttext"))
    apart = materialise(judged.filter("_n > 1 or not _stays").select(F.col("doc_id").alias(wanted), F.col("th").alias(text), "_stays"), "copies-apart")
    found = docs.withColumn(th, F.xxhash64(text_of(F.col("text")))).withColumn(own, F.col("doc_id").cast("long"))
    same = F.col(own).eqNullSafe(F.col(wanted)) & (F.col(th) == F.col(text))
    single = found.join(apart.select(wanted, text), same, "left_anti")
    repeated = found.join(apart.filter("_stays").select(wanted, text), same, "left_semi").dropDuplicates([own, th])
    return single.unionByName(repeated).select(*docs.columns)
