"""Removal of repeated line runs with a suffix array over line ids.

The corpus is the sequence of its documents' lines, documents in order of doc_id.  Line ids are the ranks of the lines that
occur more than once; all other lines end a run, as the ends of documents do.  Distributed prefix doubling ranks the
suffixes by their first 1, 2, 4, ... lines: a rank of 2h lines is the order-preserving rank of the pair (rank of h lines
here, rank of h lines h lines further on).  Suffixes whose rank is theirs alone are left out of the next round, and the
rounds end when no run of interest is longer.

A run of L lines from a suffix lies in the LCP interval (the suffixes that share their first L lines) named by L and the ranks of
its two overlapping blocks of 2**floor(log2 L) lines.  Every maximal repeated run of at least ``min_words`` words is the union
of the shortest such runs that begin at one of its lines or end at one; so these suffice: in each interval with two suffixes
or more the first one stays, and the lines of the others are deleted.

Defined cases: lines are what newlines separate; null and empty texts are one empty line and stay as they are (null becomes
empty); copies in the same document count; rows that repeat both doc_id and text are one document and are
treated alike; null doc_ids come first; extra columns stay; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import discard, slices, stage

_LINES = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("pos", pa.int32()), ("line", pa.binary()), ("runs", pa.list_(pa.int32()))])
_LINES_DDL = "doc_id long, version long, pos int, line binary, runs array<int>"
KEY = ["doc_id", "version"]


def shortest_runs(words: list[int], min_words: int) -> list[list[int]]:
    """For each line the lengths of the runs that start there: the shortest with ``min_words`` words, and each
    run that is the shortest with its last line.  Two runs for each line of the text at most, all in all."""
    n = len(words)
    total = np.concatenate([[0], np.cumsum(words)])
    runs: list[list[int]] = [[] for _ in range(n)]
    ends = np.searchsorted(total, total[:-1] + min_words).tolist()  # the first prefix that is long enough
    for i, e in enumerate(ends):
        if e <= n:
            runs[i].append(e - i)
    starts = np.searchsorted(total, total[1:] - min_words, side="right") - 1
    for e, s in enumerate(starts.tolist()):
        if s >= 0 and ends[s] != e + 1:
            runs[s].append(e + 1 - s)
    return runs


def lines_of(docs: DataFrame, min_words: int) -> DataFrame:
    """doc_id, version (a hash of the text), pos, line (128-bit digest), runs (their lengths)."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids, versions, count, digests, runs = [], [], [], [], []
            for doc, version, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines = (text or "").split("\n")
                ids.append(doc)
                versions.append(version)
                count.append(len(lines))
                digests += [hashlib.md5(x.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest() for x in lines]
                runs += shortest_runs([len(x.split()) for x in lines], min_words)
            at = np.repeat(np.arange(len(count)), count)
            pos = np.arange(len(digests)) - np.repeat(np.cumsum([0, *count[:-1]]), count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()).take(pa.array(at)), pa.array(versions, pa.int64()).take(pa.array(at)), pa.array(pos, pa.int32()), pa.array(digests, pa.binary()), pa.array(runs, pa.list_(pa.int32()))], schema=_LINES
            )

    return docs.select(_key().alias("doc_id"), _version().alias("version"), "text").mapInArrow(split, _LINES_DDL)


def _key() -> Column:
    """The doc_id; the smallest long stands for null, so that null ids join and come first."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))


def _version() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def ranked(groups: DataFrame, order: list[str], name: str) -> DataFrame:
    """``groups`` with its rows' rank (from 0) in ``order``, by a distributed sort: the number within the
    partition and the rows of the partitions before, of which there is one number each."""
    at = F.monotonically_increasing_id()
    rows = stage(groups.orderBy(*order).select(*groups.columns, F.shiftright(at, 33).alias("part"), at.bitwiseAND((1 << 33) - 1).alias("at")), name)
    sizes = sorted(rows.groupBy("part").count().collect())
    before, n = [], 0
    for part, size in sizes:
        before.append((part, n))
        n += size
    if not before:
        return rows.select(*groups.columns, F.col("at").alias("rank"))
    offsets = groups.sparkSession.createDataFrame(before, "part long, before long")
    return rows.join(F.broadcast(offsets), "part").select(*groups.columns, (F.col("at") + F.col("before")).alias("rank"))


def suffix_ranks(lines: DataFrame) -> list[DataFrame]:
    """For h = 1, 2, 4, ...: (doc_id, version, pos, rank) of the suffixes that share their first h lines with another."""
    repeated = lines.groupBy("line").agg(F.count("*").alias("n")).filter("n > 1").select("line")
    first = lines.select(*KEY, "pos", "line").distinct().join(ranked(repeated, ["line"], "line-ranks"), "line")
    levels = [stage(first.select(*KEY, "pos", "rank"), "suffix-ranks")]
    longest = lines.agg(F.max(F.array_max("runs"))).first()[0] or 0
    while 2 ** len(levels) <= longest:
        h = 2 ** (len(levels) - 1)
        ahead = F.max("rank").over(W.partitionBy(*KEY).orderBy("pos").rangeBetween(h, h))
        # kept while it is read twice; what an executor loses is made again from the level before
        pairs = levels[-1].withColumn("ahead", ahead).filter("ahead is not null").persist(StorageLevel.DISK_ONLY)
        shared = pairs.groupBy("rank", "ahead").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("rank").alias("r1"), F.col("ahead").alias("r2"))
        named = ranked(shared, ["r1", "r2"], "pair-ranks")
        level = stage(pairs.withColumnsRenamed({"rank": "r1", "ahead": "r2"}).join(named, ["r1", "r2"]).select(*KEY, "pos", "rank"), "suffix-ranks")
        pairs.unpersist()
        discard(named)
        if level.isEmpty():
            break
        levels.append(level)
    return levels


def later_copies(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """doc_id, version, pos, length of the runs that occur earlier in the corpus."""
    lines = stage(lines_of(docs, min_words).dropDuplicates([*KEY, "pos"]), "lines")
    levels = suffix_ranks(lines)
    ranks = levels[0].withColumn("level", F.lit(0))
    for k, level in enumerate(levels[1:], 1):
        ranks = ranks.union(level.withColumn("level", F.lit(k)))
    runs = lines.select(*KEY, "pos", F.explode("runs").alias("length")).withColumn("level", F.length(F.bin("length")) - 1)
    runs = runs.withColumn("second", F.expr("pos + length - int(power(2, level))"))
    one = ranks.select(*KEY, "level", "pos", F.col("rank").alias("r1"))
    two = ranks.select(*KEY, "level", F.col("pos").alias("second"), F.col("rank").alias("r2"))
    placed = stage(runs.join(one, [*KEY, "level", "pos"]).join(two, [*KEY, "level", "second"]).select(*KEY, "pos", "length", "r1", "r2"), "runs")
    interval = ["length", "r1", "r2"]
    # written, so that the join has two plain sides and Spark may split an interval that much of the corpus shares
    first = stage(placed.groupBy(*interval).agg(F.min(F.struct(*KEY, "pos")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "intervals")
    discard(lines, *levels)
    return placed.join(first, interval).filter(F.struct(*KEY, "pos") != F.col("first")).select(*KEY, "pos", "length")


def _without(text: pd.Series, cut: pd.Series) -> pd.DataFrame:
    """The texts without the lines of the runs (pos, length, pos, length, ...), and how many lines went.  Runs overlap; what they
    cover is summed up once for a text, so a text of many lines in long runs costs its lines and its runs."""

    def one(t: str, runs: np.ndarray | None) -> tuple[str, int]:
        if runs is None:
            return t, 0
        lines = t.split("\n")
        pos, length = np.asarray(runs, np.int64).reshape(-1, 2).T
        open_runs = np.bincount(pos, minlength=len(lines) + 1) - np.bincount(pos + length, minlength=len(lines) + 1)
        keep = np.cumsum(open_runs)[: len(lines)] == 0
        return "\n".join([lines[i] for i in np.flatnonzero(keep).tolist()]), int(len(lines) - keep.sum())

    return pd.DataFrame([one(t, c) for t, c in zip(text, cut, strict=True)], columns=["text", "n_removed"])


def dedup_lines(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """``docs`` with the later copies deleted from ``text``, and the columns n_lines and n_removed."""
    copies = later_copies(docs, min_words).groupBy(*KEY).agg(F.collect_set(F.struct("pos", "length")).alias("cut"))
    others = [c for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    keyed = docs.select(F.struct(*others).alias("row"), F.coalesce("text", F.lit("")).alias("text"), _key().alias("k1"), _version().alias("k2"))
    flat = F.flatten(F.transform("cut", lambda c: F.array(c["pos"], c["length"])))
    named = copies.select(F.col("doc_id").alias("c1"), F.col("version").alias("c2"), flat.alias("cut"))
    joined = keyed.join(named, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")), "left")
    # so that a filter on n_removed doesn't move below and run the function a second time
    without = F.pandas_udf(_without, "text string, n_removed long").asNondeterministic()
    n_lines = F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines")
    return joined.select("row", n_lines, without("text", "cut").alias("left")).select("row.*", F.col("left.text").alias("text"), "n_lines", F.col("left.n_removed").alias("n_removed"))
