"""Fill-in-middle transformation by secondary sort.

A document is cut into units (a word with the white space before it; white space
at the end is one more). Two hashed cuts divide them into prefix, middle and
suffix. Every part leaves as pieces: runs of whole units of at most some bytes,
keyed by the document's row and the place in the output, between the marks of the
form. One shuffle on the row brings the pieces of a document together and a sort
within the partition puts them in order, so tasks read them as a stream into
incremental digests and never need a whole document.

Restoration reads the same stream: the marks say which part follows, the pieces
get the part's place in the original, and a second sort within the same
partitions (no shuffle) streams them in the order of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import text_of

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED, RATE, SPM_RATE = 42, 50, 80
#: Bytes of text in a piece, and in an Arrow batch of pieces.
PIECE, BATCH = 1 << 16, 1 << 22
#: Order of the marks in each form; the parts that follow them are put back as prefix, middle, suffix.
FORMS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
RANK = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_KEYS = "row long, doc_id long, n long, form string, prefix_chars long, middle_chars long"
_PIECES = f"{_KEYS}, place long, piece binary"
_PARTS = f"{_KEYS}, rank int, place long, piece binary, output_sha256 string"


def unit_ends(text: bytes) -> np.ndarray:
    """Byte offsets at which the units of a UTF-8 text end."""
    space = _SPACE[np.frombuffer(text, dtype=np.uint8)]
    ends = np.flatnonzero(~space & np.append(space[1:], True)[:len(space)]) + 1
    return np.append(ends, len(text)) if len(text) and space[-1] else ends


def _chars(text: bytes) -> int:
    """Code points of UTF-8 bytes."""
    return int(np.count_nonzero((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80))


def _runs(text: bytes, ends: np.ndarray, low: int, high: int, size: int) -> Iterator[bytes]:
    """text[low:high] in pieces of at most `size` bytes that end with a unit, unless one unit is longer."""
    while high - low > size:
        at = int(ends[max(np.searchsorted(ends, low + size, side="right") - 1, 0)])
        at = at if low < at <= low + size else low + size
        yield text[low:at]
        low = at
    if high > low:
        yield text[low:high]


def _planned(doc_id: int | None, text: bytes, seed: int, rate: int, spm_rate: int, size: int) -> tuple[tuple, Iterator[bytes]]:
    """(n, form, prefix_chars, middle_chars) and the output's pieces in order."""
    ends = unit_ends(text)
    n = len(ends)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in range(0, 32, 8))
    if not text or any(mark in text for mark in RANK) or h3 % 100 >= rate:
        return (n, "plain", None, None), iter([*_runs(text, ends, 0, len(text), size)] or [b""])
    form = "spm" if h4 % 100 < spm_rate else "psm"
    offsets = np.append(0, ends)
    low, high = (int(offsets[cut]) for cut in sorted((h1 % (n + 1), h2 % (n + 1))))
    spans = {PREFIX: (0, low), MIDDLE: (low, high), SUFFIX: (high, len(text))}

    def output() -> Iterator[bytes]:
        for mark in FORMS[form]:
            yield mark
            yield from _runs(text, ends, *spans[mark], size)

    return (n, form, _chars(text[:low]), _chars(text[low:high])), output()


def _batches(rows: Iterator[tuple], schema: pa.Schema, weight: int) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded bytes; column `weight` holds the bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + len(row[weight] or b"")
        if size >= BATCH:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in ddl.split(", "))])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def pieces(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, size: int = PIECE,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, n, form, prefix_chars, middle_chars, place, piece: the output of every document in pieces.

    `rate` percent of the documents are transformed, `spm_rate` percent of those
    put the suffix first. Null and empty texts are plain with one empty piece, as
    are texts that hold a mark. A null id is hashed as the empty string. Rows are
    told apart by their position in the input, so repeated ids and texts do not mix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for row, doc_id, text in zip(*(batch.column(c) for c in range(3))):
                    doc_id = doc_id.as_py()
                    said, output = _planned(doc_id, text.as_py(), seed, rate, spm_rate, size)
                    for place, piece in enumerate(output):
                        yield (row.as_py(), doc_id, *said, place, piece)

        yield from _batches(rows(), _schema(_PIECES), 7)

    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"),
                         text_of(F.col(text_col)).cast("binary").alias("t"))
    return source.mapInArrow(run, _PIECES)


def arranged(cut: DataFrame) -> DataFrame:
    """Pieces of a document next to each other in one partition, in the order of the output."""
    return cut.repartition("row").sortWithinPartitions("row", "place")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts of the original as read from the stream of the output, each document closed by a row with its digest."""

    def rows() -> Iterator[tuple]:
        keys, sha, rank = None, None, 0
        for *now, place, piece in _rows(batches):
            if keys is None or now[0] != keys[0]:
                if keys is not None:
                    yield (*keys, 3, 0, None, sha.hexdigest())
                keys, sha, rank = now, hashlib.sha256(), 0
            sha.update(piece)
            if keys[3] != "plain" and piece in RANK:
                rank = RANK[piece]
            else:
                yield (*keys, rank, place, piece, None)
        if keys is not None:
            yield (*keys, 3, 0, None, sha.hexdigest())

    yield from _batches(rows(), _schema(_PARTS), 8)


def _restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document, from its parts in the order of the text."""

    def rows() -> Iterator[tuple]:
        sha = hashlib.sha256()
        for *keys, rank, _, piece, output in _rows(batches):
            if rank < 3:
                sha.update(piece)
            else:
                yield (*keys[1:], output, sha.hexdigest())
                sha = hashlib.sha256()

    yield from _batches(rows(), _schema(_DIGESTS), 5)


_DIGESTS = f"{_KEYS[len('row long, '):]}, output_sha256 string, restored_sha256 string"


def digests(cut: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of each document in `pieces`.

    `restored_sha256` is of the text rebuilt from the output's pieces and the form.
    """
    parts = arranged(cut).mapInArrow(_read, _PARTS)
    return parts.sortWithinPartitions("row", "rank", "place").mapInArrow(_restored, _DIGESTS)


def texts(cut: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output: the transformed texts themselves."""
    schema = f"{_KEYS[len('row long, '):]}, output string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            keys, held = None, []
            for *now, _, piece in _rows(batches):
                if keys is not None and now[0] != keys[0]:
                    yield (*keys[1:], b"".join(held).decode())
                    held = []
                keys = now
                held.append(piece)
            if keys is not None:
                yield (*keys[1:], b"".join(held).decode())

        yield from _batches(rows(), _schema(schema), 5)

    return arranged(cut).mapInArrow(run, schema)
