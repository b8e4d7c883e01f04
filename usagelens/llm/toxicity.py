"""Toxicity: FTRL-proximal logistic regression over hashed n-grams and skip-grams.

Features are the distinct words, their stems (first STEM letters of longer
words), pairs of neighbours and pairs with one word between, hashed to 2^BITS
places. FTRL keeps a learning rate per place. L1 is above EPOCHS, the most that
one document can add to a place, so a place needs evidence from several
documents to leave zero; the model is a short list of (place, weight) that goes
to every task. Fitting reads at most TRAIN_ROWS labelled documents,
hashed in parallel, learned in one stream; everything else is scored in one
narrow pass over whole texts.
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

TRAIN_ROWS = 12_000
BITS = 22
STEM = 4
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, EPOCHS + 0.5, 0.1
THRESHOLD = 0.7
MOST_WEIGHTS = 1_000_000
WORD = re.compile("[a-z0-9\x80-\U0010ffff]+")
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def _hashes(words: list[str], seed: int) -> np.ndarray:
    return np.frombuffer(b"".join([xxhash.xxh64_digest(w, seed) for w in words]), dtype=">u8").astype(np.uint64)


def features(text: str) -> np.ndarray:
    """Hashed places of words, stems, word pairs and skip-grams, with repeats."""
    words = WORD.findall(text.lower())
    if not words:
        return np.zeros(0, dtype=np.int32)
    h, stems = _hashes(words, 0), _hashes([w[:STEM] for w in words if len(w) > STEM], 1)
    pairs = (h[:-1] * MIX[0] + h[1:]) * MIX[1]
    skips = (h[:-2] * MIX[2] + h[2:]) * MIX[0]
    return (np.concatenate([h * MIX[2], stems * MIX[1], pairs, skips]) >> np.uint64(64 - BITS)).astype(np.int32)


@dataclass
class Model:
    places: np.ndarray
    weights: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        table = np.zeros(1 << BITS, dtype=np.float32)
        table[self.places] = self.weights
        return table


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """FTRL over the documents in the order they come; yields the weights that aren't zero, the bias at place -1."""
    docs = [(label.as_py(), np.frombuffer(code.as_buffer(), dtype=np.int32)) for b in batches for label, code in zip(b.column(0), b.column(1))]
    z, n = np.zeros(1 << BITS, dtype=np.float32), np.zeros(1 << BITS, dtype=np.float32)
    share = np.clip(np.mean([label for label, _ in docs]) if docs else 0.5, 0.01, 0.99)
    bias, bias_n = float(np.log(share / (1 - share))) if docs else 0.0, 1.0

    def weights(zi, ni):
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for label, places in docs:
            zi, ni = z[places], n[places]
            w = weights(zi, ni)
            g = float(sigmoid(bias + w.sum())) - label
            z[places] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[places] = ni + g * g
            bias_n += g * g
            bias -= ALPHA / np.sqrt(bias_n) * g
    w = weights(z, n)
    kept = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, kept].astype(np.int32)), pa.array(np.r_[bias, w[kept]].astype(np.float64))], ["place", "weight"])


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", rows: int = TRAIN_ROWS) -> Model:
    """The model learned from at most `rows` labelled documents outside the held-out third; without any, all weights are 0."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = [np.unique(features(t.as_py())).astype(np.int32).tobytes() for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(codes, pa.binary())], ["key", "label", "code"])

    coded = labelled(docs, labels, column, rows).drop("rest").mapInArrow(hashed, "key long, label int, code binary")
    learned = coded.repartition(1).sortWithinPartitions("key", "code").select("label", "code").mapInArrow(_learn, "place int, weight double").limit(MOST_WEIGHTS + 1).toPandas()
    if len(learned) > MOST_WEIGHTS:
        raise ValueError(f"more than {MOST_WEIGHTS} weights; raise L1")
    body = learned[learned["place"] >= 0]
    bias = learned.loc[learned["place"] < 0, "weight"]
    return Model(body["place"].to_numpy(np.int32), body["weight"].to_numpy(np.float32), float(bias.iloc[0]) if len(bias) else 0.0)


def _score(text: str, bias: float, table: np.ndarray) -> float:
    places = features(text)
    places = np.unique(places[table[places] != 0])
    return float(sigmoid(bias + float(table[places].sum(dtype=np.float64))))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted of every row; a null text scores as an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.dense()
        for b in batches:
            scores = [_score(t.as_py(), model.bias, table) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(F.col(text_col)).alias("t")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with their own columns.

    Rows are judged in place, so nothing is joined and repeated ids do no harm.
    """
    model, at = fit(docs, labels), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.dense()
        for b in batches:
            yield b.filter(pa.array([_score(t.as_py() or "", model.bias, table) < threshold for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
