"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its distinct words and their stems, neighbouring pairs, triples, and pairs with one or two words between,
hashed into 2**bits slots (words are lower-cased and stripped of marks at their ends; all words of the text count).  In
training a slot counts once ``min_docs`` texts of the sample have it.  FTRL-proximal keeps
a learning rate per coordinate, and its L1 term leaves most weights at zero, so the model that is broadcast is the short
list of non-zero slots.

The model is fitted on a bounded sample of the labelled rows: at most about ``max_rows`` documents, drawn by
a hash of the doc_id; copies of a text in it count once.  Scoring covers every row and all of its words.

Defined cases: null and empty texts have the bias alone; rows without a label, or with a null one, teach nothing; with no label of
one kind the score is the share of the other (0.0 with no labels); repeated rows are scored each; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Numbered, records, slices

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
#: (first, second) offsets of the pairs, each with its own salt.
GAPS = (1, 2, 3)
#: Lengths of the beginnings of a word that count as its stems.
STEMS = (3, 5, 7)
MARKS = ".,;:!?\"'()[]{}|*#$%&-_"
REMEMBERED = 400_000


class Words(Numbered):
    """Rows: 64-bit hashes of a word without case and marks at its ends, and of its stems."""

    def __init__(self) -> None:
        super().__init__(1 + len(STEMS), np.uint64, REMEMBERED)

    def rows(self, words: list[str]) -> np.ndarray:
        digest, cores = xxhash.xxh64_intdigest, [w.lower().strip(MARKS) or w for w in words]
        return np.array([[digest(c, 7), *[digest(c[:k], k) for k in STEMS]] for c in cores], np.uint64)


@cache
def own_words() -> Words:
    """One for all tasks of a worker."""
    return Words()


def slots(words: Words, texts: list[str | None], bits: int) -> Iterator[np.ndarray]:
    """For each text the slots of its features, repeats included."""
    words.room()
    numbers = [words.numbers((t or "").split()) for t in texts]
    words.settle()
    for k in numbers:
        h = words.table[k]
        parts = [(h * _A).ravel()]
        h = h[:, 0]
        for k, gap in enumerate(GAPS):
            if len(h) > gap:
                parts.append((h[:-gap] * _B + h[gap:] + np.uint64(k + 1)) * _A)
        if len(h) > 2:
            parts.append(((h[:-2] * _B + h[1:-1]) * _C + h[2:]) * _A)
        yield np.concatenate(parts) >> np.uint64(64 - bits)


@dataclass
class Model:
    bits: int
    bias: float
    slots: np.ndarray
    weights: np.ndarray


def ftrl(rows: list[tuple[np.ndarray, int]], bits: int, *, alpha: float = 1.0, beta: float = 1.0, l1: float = 15.0, l2: float = 1.0, epochs: int = 10, min_docs: int = 6) -> Model:
    """Fit over (distinct slots, 0 or 1)."""
    positive = sum(y for _, y in rows)
    if not positive or positive == len(rows):
        return Model(bits, 40.0 if positive else -40.0, np.zeros(0, np.int64), np.zeros(0))
    seen = np.bincount(np.concatenate([slot for slot, _ in rows]), minlength=1 << bits) >= min_docs
    rows = [(slot[seen[slot]], y) for slot, y in rows]
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias = float(np.log(positive / (len(rows) - positive)))
    zb, nb = -bias * beta / alpha, 0.0  # such that the bias begins at the odds of the labels

    def weights(slot: np.ndarray) -> np.ndarray:
        zs = z[slot]
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(n[slot])) / alpha + l2))

    rng = np.random.default_rng(1)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            slot, y = rows[k]
            w = weights(slot)
            bias = -zb / ((beta + np.sqrt(nb)) / alpha)
            g = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -40, 40))) - y
            sigma = (np.sqrt(n[slot] + g * g) - np.sqrt(n[slot])) / alpha
            z[slot] += g - sigma * w
            n[slot] += g * g
            sb = (np.sqrt(nb + g * g) - np.sqrt(nb)) / alpha
            zb, nb = zb + g - sb * bias, nb + g * g
    every = weights(np.arange(1 << bits))
    kept = np.flatnonzero(every)
    return Model(bits, float(-zb / ((beta + np.sqrt(nb)) / alpha)), kept, every[kept])


def sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """h, text, y of at most about ``max_rows`` labelled documents, copies of a text once.

    The draw is by a hash of the doc_id over the labels alone, so what is broadcast is the drawn ids, whose number
    the parameter bounds, and no text moves but that of the sample.
    """
    own = labels.filter("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    n = own.count()
    if n > max_rows:
        own = own.filter(F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("draw")), 1) < ((1 << 63) - 1) * max_rows // n)
    drawn = docs.select("doc_id", "text").join(F.broadcast(own), "doc_id")
    return drawn.groupBy(F.xxhash64("text").alias("h")).agg(F.max("y").alias("y"), F.first("text").alias("text")).select("h", "text", "y")


def train(docs: DataFrame, labels: DataFrame, *, max_rows: int = 8000, bits: int = 21, **options: float) -> Model:
    """A model from documents (doc_id, text) and labels (doc_id, y: 0 or 1)."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = own_words()
        for batch in slices(batches, "text"):
            found = [np.unique(x).astype(np.int32) for x in slots(words, batch.column(1).to_pylist(), bits)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32())), batch.column(2)], names=["h", "slots", "y"])

    rows = sample(docs, labels, max_rows).select("h", "text", F.col("y").cast("int")).mapInArrow(features, "h long, slots array<int>, y int").toArrow().combine_chunks()
    order = np.argsort(rows.column("h").to_numpy())
    found, y = rows.column("slots"), rows.column("y").to_pylist()
    return ftrl([(found[int(k)].values.to_numpy().astype(np.int64), y[k]) for k in order], bits, **options)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, words = held.value, own_words()
        dense = np.zeros(1 << m.bits, np.float32)
        dense[m.slots] = m.weights
        for batch in slices(batches, "text"):
            out = []
            for slot in slots(words, batch.column(1).to_pylist(), m.bits):
                slot = np.unique(slot[dense[slot] != 0])
                out.append(float(1 / (1 + np.exp(-np.clip(m.bias + dense[slot].sum(dtype=np.float64), -40, 40)))))
            yield records(schema, [batch.column(0).to_pylist(), out, [int(x >= 0.5) for x in out]])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")
