"""Token ids in files of canonical, length-limited Huffman codes.

A token file is a folder of three Parquet tables, written and read by Spark only:

    codes   id, length, n       lengths of all ids that occur, from global counts
    blocks  shard, block, first, n, step, rows, numbers, doc_ids, sizes, marks, payload
    sizes   shard, total        tokens of each shard

Codes are canonical (ordered by length, then id), so the lengths say everything.
Shards follow each other in the order of the ids of the documents, blocks follow
each other in a shard. A block holds whole documents, or parts of one that is
longer, of `BLOCK` tokens at most; every part begins at a byte. `marks` are
checkpoints, the bit at which every `STEP`-th token of a part begins: a block is
read on its own, all its checkpoints at once, by one table look-up per token.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.llm.byte_tokens import ByteTokens, uncollected
from usagelens.llm.common import prefix_before, text_of
from usagelens.session import scratch_path

#: The longest code, so that a table of 2^LIMIT entries reads any of them.
LIMIT = 20
BLOCK, STEP = 1 << 16, 256
#: Characters that a task hands to the tokenizer at once, and tokens in an Arrow batch.
TEXT_CHARS, TOKENS = 1_000_000, 1 << 18


# --------------------------------------------------------------------- codes
class Codes(NamedTuple):
    """Ids in the order of their codes, and the lengths of those; at most one entry per id of the vocabulary."""

    ids: np.ndarray
    lengths: np.ndarray

    @classmethod
    def of_lengths(cls, ids: np.ndarray, lengths: np.ndarray) -> Codes:
        order = np.lexsort((ids, lengths))
        return cls(np.asarray(ids, dtype=np.int32)[order], np.asarray(lengths, dtype=np.uint8)[order])

    @property
    def limit(self) -> int:
        return int(self.lengths.max(initial=1))

    def values(self) -> np.ndarray:
        """The code of each entry: in units of the longest code they follow each other without a gap."""
        spans = np.int64(1) << (self.limit - self.lengths.astype(np.int64))
        return (np.cumsum(spans) - spans) >> (self.limit - self.lengths.astype(np.int64))

    def encoder(self) -> tuple[np.ndarray, np.ndarray]:
        """(code, length) by id; ids that do not occur have length 0."""
        size = int(self.ids.max(initial=-1)) + 1
        code, length = np.zeros(size, dtype=np.uint64), np.zeros(size, dtype=np.int64)
        code[self.ids], length[self.ids] = self.values(), self.lengths
        return code, length

    def decoder(self) -> tuple[np.ndarray, np.ndarray]:
        """(id, length) by the next `limit` bits."""
        spans = np.int64(1) << (self.limit - self.lengths.astype(np.int64))
        missing = (1 << self.limit) - int(spans.sum())  # one single id leaves half of the table without a code
        return np.append(np.repeat(self.ids, spans), np.zeros(missing, np.int32)), np.append(np.repeat(self.lengths, spans), np.ones(missing, np.uint8))


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of at most `limit` bits with the least sum of count x length (package-merge)."""
    n = len(counts)
    if not 1 <= limit <= 25 or n > 1 << limit:
        raise ValueError(f"{n} ids have no codes of {limit} bits that one 32-bit window holds")
    if n < 2:
        return np.ones(n, dtype=np.uint8)
    order = np.argsort(counts, kind="stable")
    single = np.asarray(counts, dtype=np.int64)[order]
    levels, merged = [], single
    for _ in range(limit - 1):
        pairs = merged[:len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([single, pairs])
        place = np.argsort(both, kind="stable")
        levels.append(place < n)
        merged = both[place]
    lengths, take = np.zeros(n, dtype=np.uint8), 2 * n - 2
    for single_at in reversed(levels):
        singles = int(np.count_nonzero(single_at[:take]))
        lengths[:singles] += 1
        take = 2 * (take - singles)
    lengths[:take] += 1
    out = np.empty(n, dtype=np.uint8)
    out[order] = lengths
    return out


def pack(ids: np.ndarray, code: np.ndarray, length: np.ndarray, step: int = STEP) -> tuple[bytes, np.ndarray]:
    """The codes of `ids` as bytes, first bit first, and the bit at which every `step`-th begins."""
    sizes = length[ids]
    ends = np.cumsum(sizes)
    begins = ends - sizes
    total = int(ends[-1]) if len(ends) else 0
    window = code[ids] << (64 - sizes - (begins & 31)).astype(np.uint64)
    word = begins >> 5
    # Bits of different codes never meet, so sums of 32-bit halves are exact.
    words = np.bincount(word, weights=(window >> np.uint64(32)).astype(np.float64), minlength=(total >> 5) + 2)
    words += np.bincount(word + 1, weights=(window & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=len(words))[:len(words)]
    return words.astype(np.uint32).astype(">u4").tobytes()[:-(-total // 8)], begins[::step]


def unpack(payload: bytes, marks: np.ndarray, sizes: np.ndarray, ids: np.ndarray, lengths: np.ndarray, limit: int) -> np.ndarray:
    """The ids behind all checkpoints, in order: `sizes[i]` of them begin at bit `marks[i]`.

    Every checkpoint is a lane; a step reads one token in each lane.
    """
    raw = np.frombuffer(payload + bytes(8), dtype=np.uint8).astype(np.uint32)
    window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    bit, place, left = marks[order].astype(np.int64), starts[order], sizes[order]
    out = np.empty(int(sizes.sum()), dtype=np.int32)
    mask = (1 << limit) - 1
    for turn in range(int(left[0]) if len(left) else 0):
        lanes = np.searchsorted(-left, -turn, side="left")  # lanes with more than `turn` tokens
        now = bit[:lanes]
        entry = (window[now >> 3] >> (32 - limit - (now & 7)).astype(np.uint32)) & mask
        out[place[:lanes] + turn] = ids[entry]
        bit[:lanes] += lengths[entry]
    return out


# --------------------------------------------------------------------- write
def tokens(docs: DataFrame, tokenizer: str, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, tie, ids of every row, without special tokens put in and with `end_id` behind each document.

    `ids` are the bytes of little-endian 32-bit numbers, which Spark copies whole; lists it would walk through token by token.
    `tokenizer` is a path that every executor has. Null and empty texts have the
    end id only. `tie` orders rows of one id (by a hash of the text); rows that
    are equal in both are told apart by their position in the input.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = ByteTokens(tokenizer)
        last = np.array([] if end_id is None else [end_id], dtype=np.int32)

        def encoded(texts: list[str]) -> Iterator[np.ndarray]:
            cut = [library.pieces(t) for t in texts]
            flat, at, made = [p for pieces in cut for p in pieces], 0, []
            while at < len(flat):
                to, size = at, 0
                while to < len(flat) and (to == at or size + len(flat[to]) <= TEXT_CHARS):
                    size, to = size + len(flat[to]), to + 1
                made += library.encode(flat[at:to])
                at = to
            at = 0
            for pieces in cut:
                yield np.concatenate([*made[at:at + len(pieces)], last])
                at += len(pieces)

        def some(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            """Rows of about TEXT_CHARS characters, so that few tokens wait at a time."""
            sizes = np.cumsum([len(t.as_py()) for t in batch.column(3)])
            at = 0
            while at < batch.num_rows:
                done = int(sizes[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(sizes, done + TEXT_CHARS, side="right")))
                yield batch.slice(at, to - at)
                at = to

        for batch in batches:
            for part in some(batch):
                with uncollected():
                    made = list(encoded(part.column(3).to_pylist()))
                ends = np.cumsum([0, *map(len, made)], dtype=np.int64)
                ids = pa.BinaryArray.from_buffers(pa.binary(), len(made), [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(np.concatenate(made).astype("<i4"))])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), ids], ["row", "doc_id", "tie", "ids"])

    text = text_of(F.col(text_col))
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("t"))
    return source.mapInArrow(run, "row long, doc_id long, tie long, ids binary")


def _flat(column: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of a column of ids as `tokens` writes them, without nulls."""
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    ids = np.frombuffer(data, dtype="<i4", count=int(offsets[-1] - offsets[0]) // 4, offset=int(offsets[0])) if offsets[-1] > offsets[0] else np.zeros(0, "<i4")
    return ids, (offsets - offsets[0]) // 4


def id_counts(rows: DataFrame) -> DataFrame:
    """(id, n) over all documents; a task sends one row per id it has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, _ = _flat(batch.column(0))
            now = np.bincount(ids, minlength=len(total))
            now[:len(total)] += total
            total = now
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    return rows.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


_CODED = "row long, doc_id long, tie long, part int, n int, marks array<int>, payload binary"
_BLOCKS = ("shard int, block int, first long, n long, step int, rows array<long>, numbers array<int>, doc_ids array<long>, sizes array<int>, "
           "marks array<int>, payload binary")


def coded(rows: DataFrame, codes: Codes, block: int = BLOCK, step: int = STEP) -> DataFrame:
    """Documents as coded parts of at most `block` tokens, before the shuffle, which so moves a third of the bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, length = codes.encoder()

        def parts() -> Iterator[tuple]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, offsets = _flat(batch.column(3))
                for i, key in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
                    low, high = int(offsets[i]), int(offsets[i + 1])
                    for part, at in enumerate(range(low, max(high, low + 1), block)):
                        own = ids[at:min(at + block, high)]
                        payload, marks = pack(own, code, length, step)
                        yield (*key, part, len(own), marks.tolist(), payload)

        yield from _tables(parts(), _CODED, 4)

    return rows.select("row", "doc_id", "tie", "ids").mapInArrow(run, _CODED)


def _tables(rows: Iterator[tuple], ddl: str, weight: int) -> Iterator[pa.RecordBatch]:
    """Rows as batches of at most some TOKENS (column `weight` counts them)."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    names, types = zip(*(field.split() for field in ddl.split(", ")))
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += row[weight] + 16
        if size >= TOKENS:
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, k in zip(zip(*held), types)], list(names))
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, k in zip(zip(*held), types)], list(names))


def blocks(parts: DataFrame, block: int = BLOCK, step: int = STEP) -> DataFrame:
    """Coded parts in the order of the documents' ids (a null id last), packed into blocks of at most `block` tokens.

    Ranges are over (id, tie, row), so one id's rows may fill many shards, while
    the parts of a row stay in one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()

        def made() -> Iterator[tuple]:
            held, size, number, first, n_blocks, bits = [], 0, -1, 0, 0, 0

            def flush() -> tuple:
                return (shard, n_blocks, first, size, step, *(list(c) for c in zip(*(h[:4] for h in held))),
                        [m for h in held for m in h[4]], b"".join(h[5] for h in held))

            for batch in batches:
                for _, doc_id, _, part, n, marks, payload, in zip(*(c.to_pylist() for c in batch.columns)):
                    if held and size + n > block:
                        yield flush()
                        held, first, size, n_blocks, bits = [], first + size, 0, n_blocks + 1, 0
                    number += part == 0
                    held.append((number, part, doc_id, n, [bits + m for m in marks], payload))
                    size, bits = size + n, bits + 8 * len(payload)
            if held:
                yield flush()

        yield from _tables(made(), _BLOCKS, 3)

    keys = [F.asc_nulls_last("doc_id"), F.col("tie"), F.col("row")]
    return parts.repartitionByRange(*keys).sortWithinPartitions(*keys, "part").mapInArrow(run, _BLOCKS)


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int | None = 0, limit: int = LIMIT, block: int = BLOCK, step: int = STEP,
          id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every document and write the token file at `path`.

    Ids wait in a table of their own until the counts are known, since encoding
    is the costly part; that table is emptied at the end. What comes to the
    driver is one count per id of the vocabulary.
    """
    spark = docs.sparkSession
    staged = scratch_path(spark, "token-ids")
    made = tokens(docs, tokenizer, end_id, id_col, text_col)
    made.write.option("compression", "zstd").parquet(staged)
    rows = spark.read.schema(made.schema).parquet(staged)
    counts = id_counts(rows).toPandas().sort_values("id")
    lengths = code_lengths(counts["n"].to_numpy(), limit)
    codes = Codes.of_lengths(counts["id"].to_numpy(), lengths)
    table = pa.table({"id": counts["id"].to_numpy().astype(np.int32), "length": lengths.astype(np.int32), "n": counts["n"].to_numpy().astype(np.int64)})
    spark.createDataFrame(table).coalesce(1).write.parquet(f"{path}/codes")
    blocks(coded(rows, codes, block, step), block, step).write.option("compression", "none").parquet(f"{path}/blocks")
    sizes = spark.read.parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("n").alias("total"))
    sizes.write.parquet(f"{path}/sizes")
    rows.limit(0).write.mode("overwrite").parquet(staged)


# ---------------------------------------------------------------------- read
def read_codes(spark: SparkSession, path: str) -> Codes:
    table = spark.read.parquet(f"{path}/codes").toPandas()
    return Codes.of_lengths(table["id"].to_numpy(), table["length"].to_numpy())


def _parts(spark: SparkSession, path: str, schema: str, make) -> DataFrame:
    """`make(key, ids)` of every part of every block; the key is (shard, row, part, doc_id, first token within the shard)."""
    codes = read_codes(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths = codes.decoder()

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for shard, first, step, numbers, parts, doc_ids, sizes, marks, payload in zip(*(batch.column(c) for c in range(9))):
                    step = step.as_py()
                    sizes = np.array(sizes.as_py(), dtype=np.int64)
                    lanes = -(-sizes // step)
                    lane_sizes = np.full(int(lanes.sum()), step, dtype=np.int64)
                    ends = np.cumsum(lanes)
                    some = sizes > 0
                    lane_sizes[ends[some] - 1] = (sizes - (lanes - 1) * step)[some]
                    read = unpack(payload.as_py(), marks.values.to_numpy(), lane_sizes, ids, lengths, codes.limit)
                    starts = np.cumsum(sizes) - sizes
                    for row, part, doc_id, at, n in zip(numbers.as_py(), parts.as_py(), doc_ids.as_py(), starts.tolist(), sizes.tolist()):
                        yield (shard.as_py(), row, part, doc_id, first.as_py() + at, n, *make(read[at:at + n]))

        yield from _tables(rows(), schema, 5)

    table = spark.read.parquet(f"{path}/blocks").select("shard", "first", "step", "rows", "numbers", "doc_ids", "sizes", "marks", "payload")
    return table.mapInArrow(run, schema)


_PART = "shard int, row long, part int, doc_id long, first long, n long"


def _started(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """Adds `start`: tokens of all shards before, and of the documents before in the shard. The joined table has a row per shard."""
    sizes = prefix_before(spark.read.parquet(f"{path}/sizes"), [], "shard", "total", "_base").select("shard", "_base")
    return rows.join(sizes, "shard").withColumn("start", F.col("first") + F.col("_base"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids of every document in the file; `start` is the number of tokens before it."""
    parts = _parts(spark, path, f"{_PART}, ids array<int>", lambda ids: (ids,))
    whole = parts.groupBy("shard", "row").agg(
        F.any_value("doc_id").alias("doc_id"), F.min("first").alias("first"),
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("part", "ids"))), lambda p: p["ids"])).alias("ids"))
    return _started(spark, path, whole).select("doc_id", "start", "ids")


def joined_crc(parts: list[tuple[int, int]]) -> int:
    """The crc32 of bytes that follow each other, from (number of bytes, crc32) of each.

    The register after some bytes is linear in what it held before, so zeros of
    the same number carry the earlier part over.
    """
    out = 0
    for size, crc in parts:
        zeros = bytes(size)
        out = zlib.crc32(zeros, out) ^ zlib.crc32(zeros) ^ crc
    return out


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian 32-bit numbers) of every document in the file."""
    parts = _parts(spark, path, f"{_PART}, crc long", lambda ids: (zlib.crc32(ids.astype("<u4").tobytes()),))
    whole = parts.groupBy("shard", "row").agg(
        F.any_value("doc_id").alias("doc_id"), F.min("first").alias("first"), F.sum("n").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("part", "n", "crc"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs = [p[0]["crc"] if len(p) == 1 else joined_crc([(4 * x["n"], x["crc"]) for x in p]) for p in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    started = _started(spark, path, whole).select("doc_id", "start", "n_tokens", "parts")
    return started.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
