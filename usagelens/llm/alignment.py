"""Alignment of two tokenizers over the same texts, and how often their ids overlap.

Token ends are byte offsets in the text. An interval of the text whose two ends
are token ends of both is divided at a common end near its middle: the middle
token's end is looked up in the other tokenizer's ends by bisection, then those
around it at growing distance; both halves are divided further. An interval
without a common end inside is a leaf, one group of tokens that align only as a
whole. All intervals of many documents are divided together, a level at a time.

Counts over the corpus never travel with the links. A block holds the links of
many documents as its distinct id pairs, and for each pair the documents that
have it; pairs meet their corpus-wide count in joins, the counts go back to the
block, and the block gives each document its sums. So a pair that every document
has is one row per block, and nothing that is shuffled grows with the links.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.llm.byte_tokens import SINGLE, ByteTokens, WordTable, encoded_words, laid_out, plain_words, uncollected
from usagelens.llm.common import text_of
from usagelens.llm.pieces import MARK, Words
from usagelens.session import materialise

#: White space that the second side may hold in the middle of a token.
OTHER_SPACE = re.compile(r"[^\S \n]")
#: Characters of text whose words are looked up together, tokens aligned together, and links of a block.
TEXT_CHARS, ALIGNED, LINKS = 1_000_000, 125_000, 1 << 20


# ------------------------------------------------------------------ alignment
def _member(sorted_: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, is there) of each value in a sorted array, by bisection."""
    place = np.searchsorted(sorted_, values)
    return place, sorted_[np.minimum(place, len(sorted_) - 1)] == values


def _common_near_middle(a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each range [low, high) of ends in `a` (not empty) the one nearest to its middle that is in `b`: (place in a or -1, place in b).

    Distances 0, 1, 2-3, 4-7, ... are looked up in turn for the ranges that have
    found none, so a range costs no more look-ups than four times the distance.
    """
    middle = (low + high) // 2
    found, other = np.full(len(low), -1), np.full(len(low), -1)
    place, there = _member(b, a[middle])
    found[there], other[there] = middle[there], place[there]
    open_, near = np.flatnonzero(~there), 1
    while len(open_):
        open_ = open_[(middle[open_] - near >= low[open_]) | (middle[open_] + near < high[open_])]
        if not len(open_):
            break
        m, far = middle[open_], 2 * near  # distances near .. far - 1 on both sides
        left, right = np.clip(m - far + 1, low[open_], None), np.clip(m + far, None, high[open_])
        sizes = np.stack([np.clip(m - near + 1 - left, 0, None), np.clip(right - m - near, 0, None)], axis=1).ravel()
        firsts = np.stack([left, m + near], axis=1).ravel()
        at = np.arange(int(sizes.sum())) + np.repeat(firsts - (np.cumsum(sizes) - sizes), sizes)
        owner = np.repeat(np.arange(len(sizes)) // 2, sizes)
        place, there = _member(b, a[at])
        at, owner, place = at[there], owner[there], place[there]
        nearest = np.lexsort((at, np.abs(at - m[owner]), owner))
        first = nearest[np.append(True, np.diff(owner[nearest]) > 0)[:len(nearest)]]
        found[open_[owner[first]]], other[open_[owner[first]]] = at[first], place[first]
        open_ = open_[found[open_] < 0]
        near = far
    return found, other


def groups(a: np.ndarray, b: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Leaf groups as rows (a from, a to, b from, b to), in order.

    `a` and `b` are ends of tokens; `spans` are such rows of token places whose last ends agree.
    """
    leaves, work = [], spans
    while len(work):
        single = (work[:, 1] - work[:, 0] < 2) | (work[:, 3] - work[:, 2] < 2)  # no end inside
        leaves.append(work[single])
        work = work[~single]
        at, other = _common_near_middle(a, b, work[:, 0], work[:, 1] - 1)
        leaves.append(work[at < 0])
        work, at, other = work[at >= 0], at[at >= 0] + 1, other[at >= 0] + 1
        work = np.concatenate([np.stack([work[:, 0], at, work[:, 2], other], axis=1), np.stack([at, work[:, 1], other, work[:, 3]], axis=1)])
        work = work[np.argsort(work[:, 0], kind="stable")]
    out = np.concatenate(leaves) if leaves else np.zeros((0, 4), dtype=np.int64)
    return out[np.argsort(out[:, 0], kind="stable")]


def links(a: np.ndarray, b: np.ndarray, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in a, place in b, leaf) of all pairs of tokens whose bytes overlap.

    In a leaf of m and n tokens every end, of either side, closes one pair, and only the last is common.
    """
    m, n = leaves[:, 1] - leaves[:, 0], leaves[:, 3] - leaves[:, 2]
    number = np.arange(len(leaves))
    plain = (m == 1) | (n == 1)
    sizes = np.maximum(m, n)[plain]
    within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left = np.repeat(leaves[plain, 0], sizes) + np.where(np.repeat(m[plain] > 1, sizes), within, 0)
    right = np.repeat(leaves[plain, 2], sizes) + np.where(np.repeat(n[plain] > 1, sizes), within, 0)
    leaf = np.repeat(number[plain], sizes)
    mixed, out = ~plain, [(left, right, leaf)]
    for size, first, own, others, own_first in ((m, 0, a, b, True), (n - 1, 2, b, a, False)):
        sizes = size[mixed]
        at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(leaves[mixed, first], sizes)
        place = np.searchsorted(others, own[at])
        out.append((at, place, np.repeat(number[mixed], sizes)) if own_first else (place, at, np.repeat(number[mixed], sizes)))
    return tuple(np.concatenate(c) for c in zip(*out))


def _spelled(rows: list[np.ndarray], words: list[bytes]) -> list[bytes]:
    """The bytes that each row of ids stands for."""
    sizes = np.array(list(map(len, words)), dtype=np.int64)
    ids = np.concatenate([np.zeros(0, dtype=np.int32), *rows])
    ends = np.cumsum(sizes[ids])
    place = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat((np.cumsum(sizes) - sizes)[ids] - ends + sizes[ids], sizes[ids])
    spelled = np.frombuffer(b"".join(words), dtype=np.uint8)[place].tobytes()
    cuts = np.append(0, ends)[np.cumsum([0, *map(len, rows)])].tolist()
    return [spelled[low:high] for low, high in zip(cuts, cuts[1:])]


class Span(NamedTuple):
    """An aligned piece: its document, the number of groups, the ids of all links, the groups as text."""

    doc: int
    n_groups: int
    a: np.ndarray
    b: np.ndarray
    text: bytes


class Pair:
    """Both tokenizers, their token bytes and how ids are written."""

    def __init__(self, byte_model: str, piece_model: str):
        self.a = ByteTokens(byte_model, plain=True)
        words = Words(piece_model)
        self.processor, self.before = words.processor, words.before
        #: Words are borders of both sides, and the first gives all bytes back.
        self.cuttable = self.a.lossless and words.separable
        self.words = WordTable(self._learn)
        sp = self.processor
        self.bytes_a = self.a.bytes_of()
        self.bytes_b = [bytes([int(sp.id_to_piece(i)[1:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace(MARK, " ").encode()
                        for i in range(sp.get_piece_size())]
        self.sizes_a, self.sizes_b = (np.array(list(map(len, t)), dtype=np.int64) for t in (self.bytes_a, self.bytes_b))
        #: Which bytes follow each other in a token of the second side.
        self.meets = np.zeros((256, 256), dtype=bool)
        for token in self.bytes_b:
            self.meets[list(token[:-1]), list(token[1:])] = True
        #: Written id and what follows it, zeros before: within a side, after the first side, after a group.
        self.text = np.array([f"{i}{s}" for n, ends in ((len(self.bytes_a), ",|"), (len(self.bytes_b), ",;")) for s in ends for i in range(n)], dtype=bytes)
        self.text_sizes = np.char.str_len(self.text)
        self.text = self.text.view(np.uint8).reshape(len(self.text), -1)

    def tokens(self, texts: list[str | None]) -> list[list[tuple[np.ndarray, np.ndarray]]]:
        """For each text the ids of both sides, piece by piece; none where a side does not say space + text byte for byte.

        A piece begins with the space before a word, or the one that is put before the text.
        """
        cut = [(self.a.pieces(" " + t) if self.cuttable else [" " + t]) if t else [] for t in texts]
        made = self._tokens([p for pieces in cut for p in pieces])
        out, at = [], 0
        for pieces in cut:
            here = made[at:at + len(pieces)]
            out.append(here if all(ids is not None for ids in here) else [])
            at += len(pieces)
        return out

    def _tokens(self, pieces: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """The ids of both sides; None where one of them says something else than the piece."""
        by_word = [self.cuttable and not OTHER_SPACE.search(p) and not self.a.added.search(p) for p in pieces]
        words, number = plain_words([p for p, good in zip(pieces, by_word) if good], self.meets)
        coded = words.dictionary_encode()
        found = self.words.values_of(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        a, b = zip(*found) if found else ((), ())
        place = coded.indices.to_numpy()
        other = np.append(0, np.cumsum(np.array([ids is None for ids in b], dtype=bool)[place]))
        said = np.diff(other[np.append(0, np.cumsum(number))]) == 0
        sides = zip(laid_out(list(a), place, number), laid_out([ids or b"" for ids in b], place, number))
        made = iter([ids if same else None for ids, same in zip(sides, said)])
        whole = iter(self._whole([p for p, good in zip(pieces, by_word) if not good]))
        return [next(made) if good else next(whole) for good in by_word]

    def _whole(self, pieces: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        a, b = self.a.encode(pieces), [np.array(self.processor.encode(p[1:]), dtype=np.int32) for p in pieces]
        said = [p.encode() for p in pieces]
        spelled = zip(_spelled(a, self.bytes_a), _spelled(b, self.bytes_b))
        return [(x, y) if p == q == r else None for x, y, p, (q, r) in zip(a, b, said, spelled)]

    def _learn(self, words: list[str]) -> list[tuple[bytes, bytes | None]]:
        """The ids of words (with their white space before) as bytes; None where the second side says something else than the word."""
        lead = self.before
        encode = lambda text: np.array(self.processor.encode("\n" + text)[len(lead):], dtype=np.int32)
        # Words without white space before are set behind line feeds, which are tokens of their own.
        spaced, bare = [w for w in words if w[0].isspace()], [w for w in words if not w[0].isspace()]
        known = {}
        for some, lines in ((spaced, False), (bare, True)):
            made = encoded_words(["\n" + w for w in some] if lines else some, encode, self.sizes_b)
            if made is None:  # a word holds what the model rewrites
                made = [encode(w).tobytes() for w in some]
            elif lines:
                made = [ids[4:] for ids in made]
            known.update(zip(some, made))
        b = [known[w] for w in words]
        rows, said = [np.frombuffer(b"".join(b), dtype=np.int32)], "".join(words).encode()
        if _spelled(rows, self.bytes_b)[0] != said:
            right = _spelled([np.frombuffer(ids, dtype=np.int32) for ids in b], self.bytes_b)
            b = [ids if w.encode() == z else None for w, ids, z in zip(words, b, right)]
        single = [SINGLE.fullmatch(w) is not None for w in words]
        whole = iter(self.a.learn([w for w, one in zip(words, single) if one]))
        divided = (ids.tobytes() for ids in self.a.encode([w for w, one in zip(words, single) if not one]))
        return [(next(whole if one else divided), ids) for one, ids in zip(single, b)]

    def align(self, rows: list[list[tuple[np.ndarray, np.ndarray]]]) -> Iterator[Span]:
        """The pieces of `tokens` in order, aligned together up to some number of tokens."""
        held, size = [], 0
        for doc, pieces in enumerate(rows):
            for piece in pieces:
                held.append((doc, *piece))
                size += len(piece[0])
                if size >= ALIGNED:
                    yield from self._aligned(held)
                    held, size = [], 0
        if held:
            yield from self._aligned(held)

    def _aligned(self, held: list[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[Span]:
        a, b = (np.concatenate([h[side] for h in held]) for side in (1, 2))
        ends_a, ends_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        cuts = [np.append(0, np.cumsum([len(h[side]) for h in held])) for side in (1, 2)]
        spans = np.stack([cuts[0][:-1], cuts[0][1:], cuts[1][:-1], cuts[1][1:]], axis=1)
        leaves = groups(ends_a, ends_b, spans)
        left, right, leaf = links(ends_a, ends_b, leaves)
        span = np.repeat(np.arange(len(spans)), np.diff(np.searchsorted(leaves[:, 0], cuts[0])))
        order = np.argsort(span[leaf], kind="stable")
        to = np.cumsum(np.bincount(span[leaf], minlength=len(spans))).tolist()
        left, right, n_groups = a[left[order]], b[right[order]], np.bincount(span, minlength=len(spans)).tolist()
        for i, text in enumerate(self.written(a, b, leaves, spans)):
            at = to[i - 1] if i else 0
            yield Span(held[i][0], n_groups[i], left[at:to[i]], right[at:to[i]], text)

    def written(self, a: np.ndarray, b: np.ndarray, leaves: np.ndarray, spans: np.ndarray) -> Iterator[bytes]:
        """The groups of each span as text, each group closed by a semicolon."""
        last = np.zeros(len(a), dtype=bool), np.zeros(len(b), dtype=bool)
        last[0][leaves[:, 1] - 1], last[1][leaves[:, 3] - 1] = True, True
        whole = np.empty(len(a) + len(b), dtype=np.int64)
        # A token of either side stands behind the tokens of both sides in earlier groups.
        whole[np.arange(len(a)) + np.repeat(leaves[:, 2], leaves[:, 1] - leaves[:, 0])] = a + len(self.bytes_a) * last[0]
        whole[np.arange(len(b)) + np.repeat(leaves[:, 1], leaves[:, 3] - leaves[:, 2])] = 2 * len(self.bytes_a) + b + len(self.bytes_b) * last[1]
        letters = self.text[whole]
        text = letters[letters != 0].tobytes()
        ends = np.append(0, np.cumsum(self.text_sizes[whole]))
        for low, high in zip(ends[spans[:, 0] + spans[:, 2]].tolist(), ends[spans[:, 1] + spans[:, 3]].tolist()):
            yield text[low:high]


# --------------------------------------------------------------------- blocks
_FIGURES = ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
_BLOCK = ("rows array<long>, docs array<struct<row:long,doc_id:long,n_a:long,n_b:long,n_groups:long,n_links:long,groups_sha256:string>>, "
          "pairs array<struct<a:int,b:int,n:long>>, holders binary")
_DOC_TYPE = pa.struct([(name, pa.string() if name == "groups_sha256" else pa.int64()) for name in _FIGURES])
_PAIR_TYPE = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])


def _squeezed(*columns: np.ndarray) -> bytes:
    """Three columns of counts as compressed bytes: equal bytes of all numbers stand together."""
    planes = np.concatenate(columns).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return zstandard.ZstdCompressor(level=3).compress(np.array([len(c) for c in columns], dtype="<u4").tobytes() + planes)


def _expanded(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    sizes = np.frombuffer(raw[:12], dtype="<u4").astype(int)
    numbers = np.frombuffer(raw[12:], dtype=np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)
    return np.split(numbers, np.cumsum(sizes)[:-1])


class _Block:
    """Links with the rows that have them, and the figures of the documents that ended here."""

    def __init__(self):
        self.rows, self.docs, self.a, self.b, self.holder, self.size = [], [], [], [], [], 0

    def add(self, row: int, a: np.ndarray, b: np.ndarray) -> None:
        if not self.rows or self.rows[-1] != row:
            self.rows.append(row)
        self.a.append(a)
        self.b.append(b)
        self.holder.append((len(self.rows) - 1, len(a)))
        self.size += len(a)

    def batch(self) -> pa.RecordBatch:
        none = np.zeros(0, dtype=np.int64)
        a, b = (np.concatenate([none, *c]).astype(np.int64) for c in (self.a, self.b))
        holder = np.repeat(*np.array(self.holder, dtype=np.int64).reshape(-1, 2).T)
        of_b, of_row = int(b.max(initial=0)) + 1, max(len(self.rows), 1)
        entries, times = np.unique((a * of_b + b) * of_row + holder, return_counts=True)
        pair, holder = np.divmod(entries, of_row)
        first = np.flatnonzero(np.append(True, np.diff(pair) > 0)[:len(pair)])
        # Holders of a pair ascend: the first stands as it is, the others as steps from the one before.
        steps = np.diff(holder, prepend=0)
        steps[first] = holder[first]
        left, right = np.divmod(pair[first], of_b)
        n = np.add.reduceat(times, first) if len(first) else none
        pairs = pa.StructArray.from_arrays([pa.array(left, pa.int32()), pa.array(right, pa.int32()), pa.array(n, pa.int64())], fields=list(_PAIR_TYPE))
        lists = [pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values) for values in (
            pa.array(self.rows, pa.int64()), pa.array(self.docs, _DOC_TYPE), pairs)]
        held = _squeezed(np.diff(np.append(first, len(pair))), steps, times)
        return pa.RecordBatch.from_arrays([*lists, pa.array([held], pa.binary())], ["rows", "docs", "pairs", "holders"])


def sums(holders: bytes, counts: np.ndarray, best: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(sum of counts, links that are best) of each row of a block, from the counts of its pairs."""
    runs, steps, times = _expanded(holders)
    first = np.cumsum(runs) - runs
    total = np.cumsum(steps)
    holder = total - np.repeat(total[first] - steps[first], runs) if len(runs) else total
    pair = np.repeat(np.arange(len(runs)), runs)
    count_sum, n_best = np.zeros(n_rows, dtype=np.int64), np.zeros(n_rows, dtype=np.int64)
    np.add.at(count_sum, holder, times * counts[pair])
    np.add.at(n_best, holder, times * best[pair])
    return count_sum, n_best


def blocks(docs: DataFrame, byte_model: str, piece_model: str, id_col: str = "doc_id", text_col: str = "text", size: int = LINKS) -> DataFrame:
    """rows, docs, pairs, holders: blocks of about `size` links; the links of a longer document fill several."""

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        """Rows of TEXT_CHARS characters or a little more."""
        held, chars = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c) for c in range(3))):
                held.append(tuple(v.as_py() for v in row))
                chars += len(held[-1][2])
                if chars >= TEXT_CHARS:
                    yield held
                    held, chars = [], 0
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with uncollected():
            yield from filled(batches)

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, block = Pair(byte_model, piece_model), _Block()
        for rows in some(batches):
            tokens = both.tokens([text for _, _, text in rows])
            figures = [dict(zip(_FIGURES, (row, doc_id, sum(len(a) for a, _ in t), sum(len(b) for _, b in t), 0, 0, "")))
                       for (row, doc_id, _), t in zip(rows, tokens)]
            block.docs += [f for f, t in zip(figures, tokens) if not t]
            left, shas = [len(t) for t in tokens], {}
            for span in both.align(tokens):
                figure, sha = figures[span.doc], shas.setdefault(span.doc, hashlib.sha256())
                sha.update((b";" if figure["n_groups"] else b"") + span.text[:-1])
                figure["n_groups"] += span.n_groups
                figure["n_links"] += len(span.a)
                left[span.doc] -= 1
                for at in range(0, len(span.a), size):
                    block.add(figure["row"], span.a[at:at + size], span.b[at:at + size])
                    if block.size >= size and at + size < len(span.a):
                        yield block.batch()
                        block = _Block()
                if not left[span.doc]:
                    figure["groups_sha256"] = shas.pop(span.doc).hexdigest()
                    block.docs.append(figure)
                if block.size >= size:
                    yield block.batch()
                    block = _Block()
        if block.docs or block.rows:
            yield block.batch()

    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), text_of(F.col(text_col)).alias("t"))
    return source.mapInArrow(run, _BLOCK)


def pair_counts(made: DataFrame) -> DataFrame:
    """a, b, n, best of every id pair that a link holds: n links corpus-wide, best if no other a has more with b."""
    totals = materialise(made.select(F.inline("pairs")).groupBy("a", "b").agg(F.sum("n").alias("n")), "align-totals")
    # One row per id of the second vocabulary, whatever the corpus.
    most = totals.groupBy("b").agg(F.max("n").alias("_most"))
    return totals.join(F.broadcast(most), "b").select("a", "b", "n", (F.col("n") == F.col("_most")).alias("best"))


_SUMS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, count_sum long, n_best long"


def _block_sums(blocks_: pa.Table, pairs: pa.Table) -> pa.Table:
    """One block with the counts of its pairs: a line per row with links in it, a line per document that ended in it."""
    pairs = pairs.sort_by("at")
    counts, best = (pairs.column(c).to_numpy() for c in ("n", "best"))
    out = {name: [] for name in (*_FIGURES, "count_sum", "n_best")}
    for rows, docs, holders in zip(*(blocks_.column(c).to_pylist() for c in ("rows", "docs", "holders"))):
        count_sum, n_best = sums(holders, counts, best.astype(np.int64), len(rows))
        for row, c, n in zip(rows, count_sum.tolist(), n_best.tolist()):
            for name, value in zip(out, (row, *[None] * 6, c, n)):
                out[name].append(value)
        for doc in docs:
            for name in out:
                out[name].append(doc.get(name, 0))
    schema = pa.schema([*_DOC_TYPE, ("count_sum", pa.int64()), ("n_best", pa.int64())])
    return pa.table(out, schema=schema)


def align(docs: DataFrame, byte_model: str, piece_model: str, id_col: str = "doc_id", text_col: str = "text", size: int = LINKS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    `byte_model` (a) reads space + text with strings of special tokens as plain
    text; `piece_model` (b) reads the text and adds the space itself. Both are
    paths that every executor has. Null and empty texts, and those which one side
    does not give back byte for byte, have zeros, no links and an empty digest.
    Rows are told apart by their position, so repeated ids and texts do not mix.
    """
    made = materialise(blocks(docs, byte_model, piece_model, id_col, text_col, size).withColumn("block", F.monotonically_increasing_id()), "align-blocks")
    own = made.select(F.col("block").alias("own"), F.posexplode("pairs").alias("at", "p")).select("own", "at", "p.a", "p.b")
    judged = own.join(pair_counts(made), ["a", "b"]).select("own", "at", "n", "best")
    held = made.select("block", "rows", "docs", "holders")
    lines = held.groupBy("block").cogroup(judged.groupBy("own")).applyInArrow(_block_sums, _SUMS)
    figures = [F.max(name).alias(name) for name in _FIGURES[1:]]
    return lines.groupBy("row").agg(*figures, F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best")).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def groups_of(docs: DataFrame, byte_model: str, piece_model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, groups (text as `a1,a2|b1;a3|b2,b3`) of every row; empty where there are no tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Pair(byte_model, piece_model)
        for batch in batches:
            for i in range(batch.num_rows):
                spans = both.align(both.tokens([batch.column(1)[i].as_py()]))
                text = b"".join([s.text for s in spans])[:-1].decode()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([text], pa.string())], ["doc_id", "groups"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(F.col(text_col)).alias("t"))
    return source.mapInArrow(run, "doc_id long, groups string")
