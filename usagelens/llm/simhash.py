"""SimHash near-duplicates with bit-sliced comparison.

Equal fingerprints fold to one vertex first, whether or not their rows have ids. Two fingerprints at most RADIUS
bits apart agree on at least two of four 16-bit quarters, so each meets the
others in six buckets of 32 shared bits. A bucket above BUCKET_ROWS is split on
pairs of the remaining four bytes, by the same argument: then 48 bits are shared
and no bucket can hold more than 65,536 distinct fingerprints, whatever the
data. Within a bucket fingerprints are compared in bit planes (`links`), and only
a spanning forest of the links leaves the task, so nothing grows with pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import attach_by_key, semi_by_id, text_of
from usagelens.llm.components import connected_components
from usagelens.session import materialise

SHINGLE, SEED, RADIUS = 3, 42, 2
BUCKET_ROWS = 2_000
PAIRS = 1 << 16
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Planes in an order that leaves any two quarters early.
PLANES = [q * 16 + i for i in range(16) for q in range(4)]


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a UTF-8 text as a signed 64-bit number."""
    words = text.lower().split()  # bytes know ASCII case and ASCII white space only
    if not words:
        return 0
    runs = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    return majority(np.frombuffer(b"".join([xxhash.xxh64_digest(r, SEED) for r in runs]), dtype=np.uint8).reshape(-1, 8))


def majority(digests: np.ndarray) -> int:
    """The bits that are set in over half of the digests (rows of 8 bytes), as a signed number."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(digests), 4096):
        ones += np.unpackbits(digests[at:at + 4096], axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(digests)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(F.col(text_col)).cast("binary").alias("t")).mapInArrow(
        run, "doc_id long, fp long")


def links(bucket: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (i < j) of one bucket at most `radius` bits apart; rows come sorted by bucket.

    Members stand in blocks of 64. Plane k of a block is one word that holds bit
    k of each member, so one XOR compares a fingerprint with 64 others; carry-save
    counters, one word per counter bit, add up the 64 distances at once. A block
    is abandoned once all its members are beyond the radius.
    """
    n = len(fp)
    new = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    sizes = np.diff(np.r_[new, n])
    within = np.arange(n) - np.repeat(new, sizes)
    slot = (within % 64).astype(np.uint64)
    starts = np.flatnonzero(slot == 0)
    block_of = np.cumsum(slot == 0) - 1
    last_block = np.repeat(block_of[new + sizes - 1], sizes)
    one = np.uint64(1)
    planes = np.array([np.bitwise_or.reduceat(((fp >> np.uint64(k)) & one) << slot, starts) for k in range(64)])
    lanes = np.bitwise_or.reduceat(one << slot, starts)
    spans = last_block - block_of + 1  # each row meets its own block and the later ones of its bucket
    ends = np.cumsum(spans)
    bits = radius.bit_length()
    for at in range(0, int(ends[-1]) if n else 0, PAIRS):
        place = np.arange(at, min(at + PAIRS, int(ends[-1])))
        row = np.searchsorted(ends, place, side="right")
        block = block_of[row] + place - (ends[row] - spans[row])
        own, out = fp[row], ~lanes[block]
        same = block == block_of[row]
        out[same] |= (one << slot[row[same]]) | ((one << slot[row[same]]) - one)  # a row meets later rows only
        count = [np.zeros(len(row), dtype=np.uint64) for _ in range(bits)]
        for turn, k in enumerate(PLANES):
            carry = planes[k][block] ^ (np.uint64(0) - ((own >> np.uint64(k)) & one))
            for c in range(bits):
                count[c], carry = count[c] ^ carry, count[c] & carry
            out |= carry
            if turn % 8 == 7:
                over, equal = out, ALL
                for c in reversed(range(bits)):
                    if radius >> c & 1:
                        equal = equal & count[c]
                    else:
                        over, equal = over | (equal & count[c]), equal & ~count[c]
                alive = np.flatnonzero(over != ALL)
                if not len(alive):
                    row = row[:0]
                    break
                if len(alive) < len(row):
                    row, block, own, out, over = row[alive], block[alive], own[alive], out[alive], over[alive]
                    count = [c[alive] for c in count]
        if len(row):
            pair, lane = np.nonzero(np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            yield row[pair], starts[block[pair]] + lane


def _forest(n: int, found: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest row that each row reaches."""
    root = np.arange(n)
    for i, j in found:
        while True:
            a, b = root[i], root[j]
            if (a == b).all():
                break
            low = np.minimum(a, b)
            np.minimum.at(root, np.r_[a, b], np.r_[low, low])
            while (root[root] != root).any():
                root = root[root]
    return root


def _bucket_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning edges of each bucket; rows come sorted by (kind, key, v). A bucket may continue in the next batch."""

    def edges(rows: np.ndarray) -> pa.RecordBatch:
        bucket = np.cumsum(np.r_[0, (np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)])
        root = _forest(rows.shape[1], links(bucket, rows[2].view(np.uint64)))
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(rows[3][moved]), pa.array(rows[3][root[moved]])], ["a", "b"])

    held: list[np.ndarray] = []
    for batch in batches:
        rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(4)])
        if not rows.shape[1]:
            continue
        begins = np.flatnonzero((rows[0] != rows[0, -1]) | (rows[1] != rows[1, -1]))
        cut = int(begins[-1]) + 1 if len(begins) else 0
        if cut or (held and (held[-1][0, -1] != rows[0, 0] or held[-1][1, -1] != rows[1, 0])):
            yield edges(np.concatenate([*held, rows[:, :cut]], axis=1))
            held = [rows[:, cut:]]
        else:
            held.append(rows)
    if held:
        yield edges(np.concatenate(held, axis=1))


def _masks(parts: list[int], take: int) -> list[int]:
    return [sum(p) for p in combinations(parts, take)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def candidate_rows(vertices: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(kind, key, fp, v): every vertex once per bucket with company, large buckets split."""
    quarters = [0xFFFF << (16 * q) for q in range(4)]
    kinds = _masks(quarters, 2)
    keyed = vertices.select("fp", "v", F.inline(F.array(*[F.struct(
        F.lit(i).alias("kind"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(kinds)])))
    sizes = keyed.groupBy("kind", "key").agg(F.count("*").alias("n")).filter("n > 1")
    met = keyed.join(sizes, ["kind", "key"])
    finer = F.lit(None)
    for i, mask in enumerate(kinds):
        rest = [0xFF << (8 * b) for b in range(8) if not mask >> (8 * b) & 1]
        split = F.array(*[F.struct(F.lit(6 + 6 * i + j).alias("kind"), F.col("fp").bitwiseAND(F.lit(_signed(mask | m))).alias("key"))
                          for j, m in enumerate(_masks(rest, 2))])
        finer = F.when(F.col("kind") == i, split).otherwise(finer)
    whole = F.array(F.struct("kind", "key"))
    chosen = F.when(F.col("n") > bucket_rows, finer).otherwise(whole)
    return met.select("fp", "v", F.inline(chosen)).select("kind", "key", "fp", "v")


def grouped(prints: DataFrame, label: str = "simhash", file_rows: int | None = None) -> DataFrame:
    """`prints`, one row per fingerprint (fp), with the `label` of its component: the smallest fingerprint reachable in steps of RADIUS bits."""
    vertices = prints.select("fp", F.col("fp").alias("v"))
    near = candidate_rows(vertices).repartition("kind", "key").sortWithinPartitions("kind", "key", "v")
    edges = materialise(near.mapInArrow(_bucket_edges, "a long, b long"), f"{label}-edges")
    labels = connected_components(edges, label=label, file_rows=file_rows).withColumnRenamed("v", "_v")
    return materialise(prints.join(labels, F.col("fp") == F.col("_v"), "left").select(*prints.columns, F.coalesce("label", "fp").alias("label")), f"{label}-placed")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Shingles of three words (ASCII white space between, A-Z lower-cased),
    repeats counted; a shorter text is one shingle, a text without words has
    fingerprint zero. Fingerprints link at most RADIUS bits apart and the
    component is the smallest id reachable. Null texts are empty; a row without
    id links like any other, and only where no row reachable has one is the
    component null. Repeated rows get equal results.
    """
    rows = materialise(fingerprints(docs, id_col, text_col), "simhash-prints")
    prints = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-vertices")
    placed = grouped(prints)
    least = placed.groupBy("label").agg(F.min("least").alias("component_id"))
    named = attach_by_key(placed.select("fp", "label"), least, "label", "fp").select("fp", "component_id")
    return attach_by_key(rows, named, "fp", "doc_id").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """The documents whose id is their component's, with their own columns.

    Rows that share such an id all stay, and so does a document without id that
    is linked to none with one.
    """
    kept = near_duplicates(docs).filter("doc_id <=> component_id").select("doc_id").distinct()
    return semi_by_id(docs, kept)
