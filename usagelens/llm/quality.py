"""Quality: random-indexing word vectors, pooled, under a small calibrated network.

Every hashed word has a fixed sparse random vector (two of DIM places, +1 or
-1). A word's context vector is the sum of the random vectors of its neighbours
over the whole corpus: tasks add up their share, shares are added by word, and
the table of 2^WORD_BITS vectors has a fixed size. A document is the mean of its
words' vectors; a two-layer numpy network, fitted on at most TRAIN_ROWS pooled
documents, scores it, and a temperature fitted on a tenth kept aside calibrates
the probability.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import held_out, text_of
from usagelens.llm.samples import labelled, sigmoid

TRAIN_ROWS = 20_000
WORD_BITS, DIM, WINDOW = 14, 32, 2
HIDDEN, STEPS, BATCH, RATE, DECAY = 32, 3_000, 256, 0.01, 1e-4
THRESHOLD = 0.5
STATS_WORDS = 1_000_000
TOKEN = re.compile(rb"[A-Za-z0-9\x80-\xff]+|[^A-Za-z0-9\x80-\xff\s]+|\n")


def word_ids(text: bytes) -> np.ndarray:
    """Hashed ids of words, runs of punctuation and line breaks, case kept."""
    words = TOKEN.findall(text)
    if not words:
        return np.zeros(0, dtype=np.int64)
    h = np.frombuffer(b"".join([xxhash.xxh64_digest(w) for w in words]), dtype=">u8").astype(np.uint64)
    return (h >> np.uint64(64 - WORD_BITS)).astype(np.int64)


def random_index() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of every word's random vector, the same everywhere."""
    rng = np.random.RandomState(7)
    places = np.argsort(rng.rand(1 << WORD_BITS, DIM), axis=1)[:, :2]
    return places, rng.randint(0, 2, places.shape) * 2.0 - 1.0


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's share of the context vectors."""
    places, signs = random_index()
    total = np.zeros((1 << WORD_BITS) * DIM)
    held: list[np.ndarray] = []
    apart = np.full(WINDOW, -1, dtype=np.int64)

    def add() -> None:
        ids = np.concatenate(held) if held else apart
        for step in range(1, WINDOW + 1):
            a, b = ids[:-step], ids[step:]
            both = (a >= 0) & (b >= 0)
            for word, near in ((a[both], b[both]), (b[both], a[both])):
                for k in range(places.shape[1]):
                    total[:] += np.bincount(word * DIM + places[near, k], signs[near, k], minlength=len(total))
        held.clear()

    size = 0
    for batch in batches:
        for t in batch.column(0):
            ids = word_ids(t.as_py())
            held.extend((ids, apart))
            size += len(ids)
            if size >= STATS_WORDS:
                add()
                size = 0
    add()
    table = total.reshape(-1, DIM)
    used = np.flatnonzero(np.abs(table).sum(axis=1))
    yield _vectors(used, table[used])


def _vectors(words: np.ndarray, table: np.ndarray) -> pa.RecordBatch:
    lists = pa.FixedSizeListArray.from_arrays(pa.array(table.astype(np.float32).ravel()), DIM).cast(pa.list_(pa.float32()))
    return pa.RecordBatch.from_arrays([pa.array(words.astype(np.int32)), lists], ["word", "vector"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((1 << WORD_BITS, DIM))
    for b in batches:
        if b.num_rows:
            np.add.at(total, b.column(0).to_numpy(), b.column(1).flatten().to_numpy().reshape(-1, DIM))
    used = np.flatnonzero(np.abs(total).sum(axis=1))
    yield _vectors(used, total[used])


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Context vectors of all hashed words over all whole texts, centred and of unit length."""
    shares = docs.select(text_of(F.col(text_col)).cast("binary").alias("t")).mapInArrow(_contexts, "word int, vector array<float>")
    rows = shares.repartition("word").mapInArrow(_added, "word int, vector array<float>").toPandas()  # at most 2^WORD_BITS rows
    table = np.zeros((1 << WORD_BITS, DIM), dtype=np.float32)
    if len(rows):
        raw = np.stack(rows["vector"].to_list())
        raw /= np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-9)
        raw -= raw.mean(axis=0)
        table[rows["word"].to_numpy()] = raw / np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-9)
    return table


def pooled(text: bytes, table: np.ndarray) -> np.ndarray:
    """Mean word vector, and how far the words spread around it; zeros without words."""
    ids = word_ids(text)
    if not len(ids):
        return np.zeros(2 * DIM)
    total, squares = np.zeros(DIM), np.zeros(DIM)
    for at in range(0, len(ids), 65_536):
        part = table[ids[at:at + 65_536]].astype(np.float64)
        total += part.sum(axis=0)
        squares += np.square(part).sum(axis=0)
    mean = total / len(ids)
    return np.r_[mean, np.sqrt(np.maximum(squares / len(ids) - mean * mean, 0.0))]


@dataclass
class Network:
    """x -> tanh layer -> logit, over standardised input; `temperature` divides the logit."""

    shift: np.ndarray
    scale: np.ndarray
    layers: list
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return (np.tanh((x - self.shift) / self.scale @ w1 + b1) @ w2 + b2).ravel()

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x) / self.temperature)


def train(x: np.ndarray, y: np.ndarray, aside: np.ndarray) -> Network:
    """Fit on rows outside `aside`, the temperature on those inside. Without rows every score is 0.5."""
    width = x.shape[1] if x.ndim == 2 and x.shape[1] else 2 * DIM
    rng = np.random.RandomState(11)
    layers = [rng.randn(width, HIDDEN) / np.sqrt(width), np.zeros(HIDDEN), np.zeros((HIDDEN, 1)), np.zeros(1)]
    if not (~aside).any():
        return Network(np.zeros(width), np.ones(width), layers)
    xs, ys = x[~aside], y[~aside]
    net = Network(xs.mean(axis=0), xs.std(axis=0) + 1e-3, layers)
    xs = (xs - net.shift) / net.scale
    moment, second = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers]
    for step in range(1, STEPS + 1):
        pick = rng.randint(0, len(xs), BATCH)
        w1, b1, w2, b2 = layers
        hidden = np.tanh(xs[pick] @ w1 + b1)
        error = (sigmoid((hidden @ w2 + b2).ravel()) - ys[pick])[:, None] / BATCH
        back = error @ w2.T * (1 - hidden * hidden)
        grads = [xs[pick].T @ back + DECAY * w1, back.sum(axis=0), hidden.T @ error + DECAY * w2, error.sum(axis=0)]
        rate = RATE * (1 - step / (STEPS + 1))
        for k, g in enumerate(grads):
            moment[k] = 0.9 * moment[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            layers[k] -= rate * (moment[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    if aside.any():
        logits, known = net.logits(x[aside]), y[aside]
        choices = np.exp(np.linspace(np.log(0.25), np.log(8.0), 60))
        loss = [np.logaddexp(0, -np.where(known == 1, logits, -logits) / t).mean() for t in choices]
        net.temperature = float(choices[int(np.argmin(loss))])
    return net


@dataclass
class Model:
    table: np.ndarray
    network: Network


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", rows: int = TRAIN_ROWS) -> Model:
    """Word vectors of all documents; the network from at most `rows` labelled ones outside the held-out third."""
    table = word_vectors(docs)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = [pooled(t.as_py(), table).astype(np.float32).tobytes() for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3).cast(pa.int32()), pa.array(codes, pa.binary())], ["key", "label", "rest", "code"])

    found = labelled(docs, labels, column, rows).withColumn("t", F.col("t").cast("binary")).mapInArrow(pool, "key long, label int, rest int, code binary").toPandas()
    found = found.sort_values(["key", "code"], kind="stable")
    x = np.frombuffer(b"".join(found["code"]), dtype=np.float32).reshape(-1, 2 * DIM).astype(np.float64)
    return Model(table, train(x, found["label"].to_numpy(np.float64), found["rest"].to_numpy() == 0))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted of every row; a null text scores as an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([pooled(t.as_py(), model.table) for t in b.column(1)]).reshape(-1, 2 * DIM)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.network.scores(x), pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(F.col(text_col)).cast("binary").alias("t")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
