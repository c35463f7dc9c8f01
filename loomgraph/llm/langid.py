"""Language identification by segmentation-marginalised unigrams.

The vocabulary is a fixed public one.  A language has a probability for each piece; a word's probability is the sum over all
of its segmentations into pieces, by the forward algorithm, and a text's is the product over its words.  All words of all labelled
rows are counted once by language; each round of expectation-maximisation sums, by forward-backward over the different words,
how often a piece is expected in each language, first under equal probabilities.  A round returns at most languages x pieces
sums per task; they are added up by key, so what reaches the driver is the model and doesn't grow with the corpus.

Words are runs of letters, lower-cased, of any length; all words of a text count.  Words of up to `SHORT` letters go through the
forward algorithm many at a time, longer ones each alone, in logarithms, with the same sums.

Defined cases: a null text or one without letters is ``und`` with score 0; rows with null lang teach nothing; ties go
to the alphabetically first language; with no labelled row everything is ``und``; repeated rows are predicted each;
extra columns are dropped.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Numbered, records, slices, stage

#: Letters, and a few other numbers that `words_of` takes out again.
WORD = re.compile(r"[^\W\d_]+")
START = "▁"
SHORT = 31
#: A letter that no piece covers; also what a piece unseen in a language counts at least.
UNKNOWN = 1e-7
#: Keeps products of probabilities near one: each letter of a word multiplies by it.
SCALE = 40.0
REMEMBERED = 400_000
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_BITS = 19


def vocabulary(path: str) -> list[str]:
    """The pieces of a sentencepiece model that are letters, lower-cased, in order."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    return sorted(p for p in pieces if p.removeprefix(START).isalpha())


class Lattice:
    """Finds the pieces in many words at once: substrings are looked up by a rolling hash."""

    def __init__(self, pieces: list[str]) -> None:
        self.n, self.longest = len(pieces), max(map(len, pieces))
        self.powers = np.array([pow(_BASE, k, 1 << 64) for k in range(self.longest + 1)], np.uint64)
        self.hashes = np.zeros(self.n + 1, np.uint64)
        for k, p in enumerate(pieces):
            h = 0
            for c in p:
                h = (h * _BASE + ord(c) + 1) & (1 << 64) - 1
            self.hashes[k] = h
        self.tables, left = [], np.arange(self.n)
        for mix in _MIX:  # what collides in the first table goes to the second
            table = np.full(1 << _BITS, self.n, np.int32)
            slot = self._slot(self.hashes[left], mix)
            table[slot[::-1]] = left[::-1]
            left = left[table[slot] != left]
            self.tables.append(table)
        self.last = {int(self.hashes[k]): int(k) for k in left}  # a few at most

    @staticmethod
    def _slot(h: np.ndarray, mix: int) -> np.ndarray:
        return ((h ^ (h >> np.uint64(31))) * np.uint64(mix)) >> np.uint64(64 - _BITS)

    def find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), self.n, np.int32)
        for table, mix in zip(self.tables, _MIX, strict=True):
            k = table[self._slot(h, mix)]
            out = np.where(self.hashes[k] == h, k, out)
        for value, k in self.last.items():
            out[h == np.uint64(value)] = k
        return out

    def spans(self, words: list[str]) -> Iterator[tuple[int, int, np.ndarray]]:
        """(start, end, piece) of words of one length, each after the mark that starts a word."""
        n, size = len(words), len(words[0]) + 1
        codes = np.full((n, size), ord(START), np.uint64)
        codes[:, 1:] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(n, size - 1)
        prefix = np.zeros((size + 1, n), np.uint64)
        for j in range(size):
            prefix[j + 1] = prefix[j] * np.uint64(_BASE) + codes[:, j] + np.uint64(1)
        for j in range(1, size + 1):
            for i in range(max(0, j - self.longest), j):
                yield i, j, self.find(prefix[j] - prefix[i] * self.powers[j - i])

    def forward(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """Log-probability (scaled) of words of one length, per language; p: pieces + 1 by languages, its last row zero."""
        n, size = len(words), len(words[0]) + 1
        alpha: list[np.ndarray] = [np.ones((n, p.shape[1]))]
        for i, j, k in self.spans(words):
            if len(alpha) == j:
                alpha.append(alpha[j - 1] * (UNKNOWN * SCALE))
            alpha[j] += alpha[i] * p[k] * SCALE ** (j - i)
        return np.log(alpha[size])

    def expected(self, words: list[str], counts: np.ndarray, p: np.ndarray, sums: np.ndarray) -> None:
        """Add the expected pieces of words of one length (counts: words by languages) to ``sums``.  p may have
        one column for all languages."""
        n, size = len(words), len(words[0]) + 1
        spans = list(self.spans(words))
        alpha, beta = [np.ones((n, p.shape[1]))], [None] * size + [np.ones((n, p.shape[1]))]
        for i, j, k in spans:
            if len(alpha) == j:
                alpha.append(alpha[j - 1] * (UNKNOWN * SCALE))
            alpha[j] += alpha[i] * p[k] * SCALE ** (j - i)
        total = alpha[size]
        for i in range(size - 1, -1, -1):
            beta[i] = beta[i + 1] * (UNKNOWN * SCALE)
            for a, j, k in spans:
                if a == i:
                    beta[i] = beta[i] + beta[j] * p[k] * SCALE ** (j - i)
        weight = counts / total
        for i, j, k in spans:
            hit = np.flatnonzero(k < self.n)
            if len(hit):
                got = alpha[i][hit] * beta[j][hit] * p[k[hit]] * SCALE ** (j - i) * weight[hit]
                for c in range(counts.shape[1]):
                    sums[:, c] += np.bincount(k[hit], got[:, c], self.n)


    # ---- a long word, in logarithms ----

    def ends(self, word: str) -> np.ndarray:
        """The piece that ends with each letter of the marked word (rows), by its length less one."""
        codes = np.concatenate([[ord(START)], np.frombuffer(word.encode("utf-32-le"), np.uint32)]).astype(np.uint64)
        h, out = np.zeros(len(codes), np.uint64), np.full((len(codes), self.longest), self.n, np.int32)
        for d in range(min(self.longest, len(codes))):
            h = h[: len(codes) - d] * np.uint64(_BASE) + codes[d:] + np.uint64(1)
            out[d:, d] = self.find(h)
        return out

    def _chain(self, pieces: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Log of the sums over all segmentations of the first 0, 1, 2, ... letters, where row j has the pieces that join letter j
        with up to ``longest`` letters behind."""
        logs, scale = np.zeros((len(pieces) + 1, p.shape[1])), SCALE ** np.arange(1, self.longest + 1)[:, None]
        for j, k in enumerate(pieces, 1):
            d = min(j, self.longest)
            behind = np.exp(logs[j - d : j][::-1] - logs[j - 1])
            logs[j] = logs[j - 1] + np.log(UNKNOWN * SCALE + (behind * p[k[:d]] * scale[:d]).sum(0))
        return logs

    def forward_long(self, word: str, p: np.ndarray) -> np.ndarray:
        return self._chain(self.ends(word), p)[-1]

    def expected_long(self, word: str, counts: np.ndarray, p: np.ndarray, sums: np.ndarray) -> None:
        """`expected` of one word (counts by language)."""
        ends = self.ends(word)
        size = len(ends)
        starts = np.full_like(ends, self.n)  # the same pieces by their first letter, last letter first
        for d in range(min(self.longest, size)):
            starts[d:, d] = ends[d:, d][::-1]
        alpha, beta = self._chain(ends, p), self._chain(starts, p)[::-1]
        for d in range(min(self.longest, size)):
            k = ends[d:, d]
            hit = np.flatnonzero(k < self.n)
            got = np.exp(alpha[hit] + beta[hit + d + 1] - alpha[-1]) * p[k[hit]] * SCALE ** (d + 1) * counts
            for c in range(len(counts)):
                sums[:, c] += np.bincount(k[hit], got[:, c], self.n)


def words_of(text: str) -> list[str]:
    found = WORD.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [x for w in found for x in "".join(c if c.isalpha() else " " for c in w).split()]


def by_length(words: list[str]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        out.setdefault(len(w), []).append(k)
    return out


def word_counts(labelled: DataFrame) -> DataFrame:
    """lang, word, n over all rows (lang, text).  A task counts what it reads before anything moves."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, c in seen.items():
                words, n = list(c.keys()), list(c.values())
                for at in range(0, len(words), 50_000):
                    yield records(schema, [[lang] * len(words[at : at + 50_000]), words[at : at + 50_000], n[at : at + 50_000]])
            seen.clear()

        for batch in slices(batches, "text"):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if lang not in seen:
                    seen[lang] = Counter()
                seen[lang].update(words_of(text))
            if sum(map(len, seen.values())) > REMEMBERED:
                yield from flush()
        yield from flush()

    return labelled.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _expectation(lattice: Broadcast, model: Broadcast, langs: list[str]):
    """Batches of (lang, word, n) -> (lang, piece, expected count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, p = lattice.value, model.value
        sums, column = np.zeros((pieces.n, len(langs))), {lang: k for k, lang in enumerate(langs)}
        for batch in batches:
            lang = np.array([column[x] for x in batch.column(0).to_pylist()])
            words, n = batch.column(1).to_pylist(), batch.column(2).to_numpy()
            for size, own in by_length(words).items():
                counts = np.zeros((len(own), len(langs)))
                counts[np.arange(len(own)), lang[own]] = n[own]
                if size <= SHORT:
                    pieces.expected([words[k] for k in own], counts, p, sums)
                else:
                    for k, c in zip(own, counts, strict=True):
                        pieces.expected_long(words[k], c, p, sums)
        piece, k = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(sums[piece, k])], names=["lang", "piece", "n"])

    return run


@dataclass
class Model:
    langs: list[str]
    lattice: Lattice
    p: np.ndarray  # pieces + 1 by languages

    @cached_property
    def scores(self) -> Scores:
        """What a worker remembers for all of its tasks."""
        return Scores(self.lattice, self.p)


def train(labelled: DataFrame, vocabulary_path: str, rounds: int = 2) -> Model:
    """A model of rows (text, lang)."""
    spark = labelled.sparkSession
    counted = stage(word_counts(labelled.filter("lang is not null and text is not null").select("lang", "text")), "words")
    langs = sorted(r[0] for r in counted.select("lang").distinct().collect())
    lattice = Lattice(vocabulary(vocabulary_path))
    p = np.vstack([np.full((lattice.n, 1), 1 / lattice.n), np.zeros((1, 1))])
    held = spark.sparkContext.broadcast(lattice)
    for _ in range(rounds if langs else 0):
        model = spark.sparkContext.broadcast(p)
        sums = counted.mapInArrow(_expectation(held, model, langs), "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
        n, table = np.zeros((lattice.n, len(langs))), sums.toArrow()
        n[table.column("piece").to_numpy(), table.column("lang").to_numpy()] = table.column("n").to_numpy()
        n = np.maximum(n / np.maximum(n.sum(0), 1), UNKNOWN)
        p = np.vstack([n / n.sum(0), np.zeros((1, len(langs)))])
    return Model(langs, lattice, p)


class Scores(Numbered):
    """Rows: log-probabilities of a word by language."""

    def __init__(self, lattice: Lattice, p: np.ndarray) -> None:
        super().__init__(p.shape[1], float, REMEMBERED)
        self.lattice, self.p = lattice, p

    def rows(self, words: list[str]) -> np.ndarray:
        logs = np.zeros((len(words), self.p.shape[1]))
        for own in by_length(words).values():
            for at in range(0, len(own), 20_000):
                logs[own[at : at + 20_000]] = self.lattice.forward([words[k] for k in own[at : at + 20_000]], self.p)
        return logs


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (the posterior of the language under equal priors)."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, langs = held.value.scores, held.value.langs
        for batch in slices(batches, "text"):
            scores.room()
            numbers, long = [], {}
            for at, t in enumerate(batch.column(1).to_pylist()):
                words = words_of(t or "")
                if max(map(len, words), default=0) > SHORT:  # these aren't remembered
                    long[at] = [w for w in words if len(w) > SHORT]
                    words = [w for w in words if len(w) <= SHORT]
                numbers.append(scores.numbers(words))
            scores.settle()
            pred, score = [], []
            for at, k in enumerate(numbers):
                if not langs or not len(k) and at not in long:
                    pred.append("und")
                    score.append(0.0)
                    continue
                total = scores.table[k].sum(0) + sum(scores.lattice.forward_long(w, scores.p) for w in long.get(at, ()))
                odds = np.exp(total - total.max())
                best = int(np.argmax(total))
                pred.append(langs[best])
                score.append(float(odds[best] / odds.sum()))
            yield records(schema, [batch.column(0).to_pylist(), pred, score])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
