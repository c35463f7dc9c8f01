"""Quality by weak supervision.

Ten heuristic labellers vote good, bad or abstain on each whole text.  The votes of all documents are counted by pattern (at
most 3**10 of them, whatever the corpus' size), and expectation-maximisation over the counted patterns estimates each
labeller's accuracy and each pattern's posterior, without gold labels.  The posteriors of a bounded sample of documents (at most
about ``max_rows`` different texts, drawn by a hash of the text, copies once) then train a hashed linear scorer over words and word
shapes, averaged over a text's words, and how repetitive it is as a whole; it scores every document.

Defined cases: null, empty and white texts have no words, score 0 and are rejected; texts of under five words are voted on by
no labeller and get the scorer's opinion; the variety of words is judged from 50 words on, stop words and sentences are missed from 20 and
100 words on, repeated lines from four lines on; repeated rows are scored each; extra columns are dropped; an empty
table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import records, slices, trim

BAD, GOOD, ABSTAIN = 0, 1, 2
#: Very frequent words of the languages in use.
STOP = frozenset("the of and to in is it that for on was as with be by this at from or an are de la le et les des un une du en que qui dans pour par sur au il el los las y se del al su con no der die und das ein eine zu den nicht von mit ist im dem auf für".split())
LABELLERS = ("symbols", "bars", "capitals", "shouts", "stop_words", "word_length", "variety", "echoes", "lines", "sentences")
#: Labellers that only ever detect faults; when they abstain they found none.  What the others don't judge tells nothing.
DETECTORS = np.array([name not in ("stop_words", "word_length", "sentences") for name in LABELLERS])
REMEMBERED = 150_000
#: Words of a stretch in which the different ones are counted.
STRETCH = 500
_BYTES = {name: np.frombuffer(chars, np.uint8) for name, chars in (("symbols", b"#$%&*@^~"), ("bars", b"|<>{}[]\\_="), ("shouts", b"!?"), ("stops", b"."), ("capitals", bytes(range(65, 91))), ("small", bytes(range(97, 123))))}


def _above(x: float, bad: float) -> int:
    """A detector's vote: bad or nothing."""
    return BAD if x > bad else ABSTAIN


def variety(words: list[str]) -> float:
    """The share of different words, on the mean over stretches of STRETCH words, so that it doesn't fall with a text's length."""
    n = len(words)
    if n <= STRETCH:
        return len(set(words)) / max(1, n)
    whole = n - n % STRETCH
    return sum(len(set(words[k : k + STRETCH])) for k in range(0, whole, STRETCH)) / whole


def votes(text: str | None) -> list[int]:
    """The labellers' votes on a text."""
    words = (text or "").split()
    n = len(words)
    if n < 5:
        return [ABSTAIN] * len(LABELLERS)
    histogram = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    count = {name: int(histogram[b].sum()) for name, b in _BYTES.items()}
    lower = list(map(str.lower, words))
    lines = [x for x in text.split("\n") if x.strip()]
    stops, length = sum(map(STOP.__contains__, lower)) / n, sum(map(len, words)) / n
    return [
        _above(count["symbols"] / n, 0.2),
        _above(count["bars"] / n, 0.2),
        _above(count["capitals"] / max(1, count["capitals"] + count["small"]), 0.4),
        _above(count["shouts"] / n, 0.2),
        GOOD if 0.08 <= stops <= 0.6 else BAD if stops < 0.02 and n >= 20 else ABSTAIN,
        GOOD if 3 <= length <= 8 else BAD if length > 12 or length < 2 else ABSTAIN,
        _above(-variety(lower), -0.12) if n >= 50 else ABSTAIN,
        _above(sum(map(eq, lower, lower[1:])) / n, 0.3),
        _above(-len(set(lines)) / len(lines), -0.5) if len(lines) >= 4 else ABSTAIN,
        ABSTAIN if n < 20 else GOOD if 0.01 <= count["stops"] / n <= 0.3 else BAD if not count["stops"] and n >= 100 else ABSTAIN,
    ]


def encoded(vote: list[int]) -> int:
    out = 0
    for v in vote:
        out = 3 * out + v
    return out


def decoded(pattern: int) -> list[int]:
    out = []
    for _ in LABELLERS:
        pattern, v = divmod(pattern, 3)
        out.append(v)
    return out[::-1]


def patterns(docs: DataFrame) -> DataFrame:
    """doc_id, pattern: the votes of each text as one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = np.array([encoded(votes(t)) for t in batch.column(1).to_pylist()], np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "pattern"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, pattern int")


def informed(table: np.ndarray) -> np.ndarray:
    """What each vote of a labeller (classes x votes) adds to the log odds of good."""
    return np.log(table[GOOD] / table[BAD])


@dataclass
class LabelModel:
    prior: float
    #: labellers x classes (bad, good) x votes (bad, good, abstain)
    table: np.ndarray

    def posterior(self, pattern: int) -> float:
        """Probability that a text with these votes is good."""
        odds = np.log(self.prior) - np.log(1 - self.prior)
        for k, v in enumerate(decoded(pattern)):
            odds += informed(self.table[k])[v]
        return float(1 / (1 + np.exp(-np.clip(odds, -40, 40))))


def fit_labels(counts: dict[int, int], rounds: int = 50) -> LabelModel:
    """Expectation-maximisation over counted patterns, from a suspicious start."""
    if not counts:
        return LabelModel(0.5, np.full((len(LABELLERS), 2, 3), 1 / 3))
    vote = np.array([decoded(p) for p in counts])
    n = np.array(list(counts.values()), float)
    # the start: who is suspected by anyone is likely bad; different detectors find different faults
    q = np.array([0.95, 0.15, 0.05])[np.minimum((vote == BAD).sum(1), 2)]
    for _ in range(rounds):
        table = np.full((len(LABELLERS), 2, 3), 1.0)
        for k in range(len(LABELLERS)):
            for v in range(3):
                hit = vote[:, k] == v
                table[k, GOOD, v] += (n * q)[hit].sum()
                table[k, BAD, v] += (n * (1 - q))[hit].sum()
        both = table[:, :, :2] / table[:, :, :2].sum(2, keepdims=True)
        table /= table.sum(2, keepdims=True)
        table[~DETECTORS, :, :2], table[~DETECTORS, :, 2] = both[~DETECTORS], 1.0
        prior = float(np.clip((n * q).sum() / n.sum(), 0.01, 0.99))
        odds = np.full(len(n), np.log(prior / (1 - prior)))
        for k in range(len(LABELLERS)):
            odds += informed(table[k])[vote[:, k]]
        q = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
    return LabelModel(prior, table)


_RUN = re.compile(r"[A-ZÀ-ÖØ-Þ]+|[a-zß-öø-ÿ]+|[0-9]+")


def shape(word: str) -> str:
    """Runs of capitals, small letters and digits become X, x and 0; marks stay."""
    return _RUN.sub(lambda m: "X" if m[0][0].isupper() else "0" if m[0][0].isdigit() else "x", word)


def word_slots(word: str, bits: int) -> tuple[int, int]:
    top = 64 - bits
    return xxhash.xxh64_intdigest(word.lower(), 11) >> top, xxhash.xxh64_intdigest("shape " + shape(word), 11) >> top


#: Imagined words without weight that every text has, so that a few words decide little.
DAMPING = 8


def facts(words: list[str]) -> list[str]:
    """Features of a text as a whole: how often a word follows itself, and how varied the words are, in steps."""
    n = len(words)
    again = sum(map(eq, words, words[1:])) / n
    varied = variety(words) if n >= 50 else 1.0
    return [f"again {min(9, int(20 * again))}", f"variety {int(9 * varied)}"]


def fact_slots(words: list[str], bits: int) -> list[int]:
    return [xxhash.xxh64_intdigest(x, 13) >> (64 - bits) for x in facts(words)]


@dataclass
class Scorer:
    bits: int
    bias: float
    weights: np.ndarray

    @cached_property
    def words(self) -> WordWeights:
        """What a worker remembers for all of its tasks."""
        return WordWeights(self)


class WordWeights(dict):
    def __init__(self, scorer: Scorer) -> None:
        self.scorer = scorer

    def __missing__(self, word: str) -> float:
        a, b = word_slots(word, self.scorer.bits)
        w = float(self.scorer.weights[a] + self.scorer.weights[b])
        if len(self) < REMEMBERED:
            self[word] = w
        return w


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray, float]], bits: int, epochs: int = 8, rate: float = 0.5, l2: float = 1e-6) -> Scorer:
    """Logistic regression with AdaGrad over (slots, shares, probability)."""
    w, g2, bias, gb = np.zeros(1 << bits), np.full(1 << bits, 1e-4), 0.0, 1e-4
    rng = np.random.default_rng(1)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            slot, x, y = rows[k]
            e = 1 / (1 + np.exp(-np.clip(bias + w[slot] @ x, -40, 40))) - y
            g = e * x + l2 * w[slot]
            g2[slot] += g * g
            w[slot] -= rate * g / np.sqrt(g2[slot])
            gb += e * e
            bias -= rate * 0.1 * e / np.sqrt(gb)
    return Scorer(bits, float(bias), w)


def train(docs: DataFrame, *, max_rows: int = 6000, bits: int = 16) -> Scorer:
    """The scorer of a corpus (doc_id, text); no gold label is used."""
    counted = {r["pattern"]: r["count"] for r in patterns(docs).groupBy("pattern").count().collect()}
    labels, n = fit_labels(counted), sum(counted.values())
    drawn = docs.filter("text is not null").select(F.xxhash64("text").alias("h"), "text")
    if n > max_rows:
        drawn = drawn.filter(F.shiftrightunsigned("h", 1) < ((1 << 63) - 1) * max_rows // n)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[int, int]] = {}
        for batch in slices(batches, "text"):
            out: list[list] = [[], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = text.split()
                if not words:
                    continue
                if len(cache) > REMEMBERED:
                    cache.clear()
                for w in set(words).difference(cache):
                    cache[w] = word_slots(w, bits)
                slot, n = np.unique(np.array([cache[w] for w in words], np.int32).ravel(), return_counts=True)
                whole = fact_slots(words, bits)
                slot, share = np.concatenate([slot, np.array(whole, np.int32)]), np.concatenate([n / (len(words) + DAMPING), np.ones(len(whole))])
                for column, value in zip(out, (doc, slot, share.astype(np.float32), encoded(votes(text))), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.int32())), pa.array(out[2], pa.list_(pa.float32())), pa.array(out[3], pa.int32())], names=["h", "slots", "shares", "pattern"])

    rows = drawn.mapInArrow(features, "h long, slots array<int>, shares array<float>, pattern int").dropDuplicates(["h"]).toArrow().combine_chunks()
    slot, share, pattern = (rows.column(k) for k in ("slots", "shares", "pattern"))
    order = np.argsort(rows.column("h").to_numpy()).tolist()
    known = {p: labels.posterior(p) for p in set(pattern.to_pylist())}
    scorer = fit_scorer([(slot[k].values.to_numpy(), share[k].values.to_numpy(), known[pattern[k].as_py()]) for k in order], bits)
    del rows, slot, share, pattern
    trim()
    return scorer


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, score (0 to 1, higher: better)."""
    held = docs.sparkSession.sparkContext.broadcast(scorer)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = held.value.words
        for batch in slices(batches, "text"):
            yield records(schema, [batch.column(0).to_pylist(), [score_text(t, weights) for t in batch.column(1).to_pylist()]])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def score_text(text: str | None, weights: WordWeights) -> float:
    words = (text or "").split()
    if not words:
        return 0.0
    m = weights.scorer
    z = m.bias + sum(map(weights.__getitem__, words)) / (len(words) + DAMPING) + sum(float(m.weights[k]) for k in fact_slots(words, m.bits))
    return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def keep(docs: DataFrame, scorer: Scorer, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores ``threshold`` or more, all columns as they are."""
    held = docs.sparkSession.sparkContext.broadcast(scorer)

    def scores(texts: pd.Series) -> pd.Series:
        weights = held.value.words
        return pd.Series([score_text(t, weights) for t in texts], dtype=float)

    return docs.filter(F.pandas_udf(scores, "double")("text") >= threshold)
