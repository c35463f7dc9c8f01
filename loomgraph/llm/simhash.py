"""Near duplicates by 64-bit SimHash, linked through Golay-code fuzzy hashing.

**Fingerprint.**  Whole texts, A-Z lower-cased, words between ASCII white space, ``shingle``-word shingles with
repeats; a shingle's hash is XXH64 with seed 42; a bit is 1 if over half of the hashes have it.

**Links.**  Two fingerprints link if at most two bits differ.  A fingerprint is cut into three segments of 22, 21
and 21 bits.  With two errors over three segments, one of the ordered pairs (1,2), (2,3), (3,1) has no error in the
first and at most one in the second.  The first segment enters the key as it is; the second enters as codeword
indices of the perfect binary (23,12) Golay code: decoding the segment, and the segment with any one bit
flipped, yields one to six codewords, and two segments at distance one share at least one.  Fingerprints
that share a key are verified by their true distance.

**No pairs.**  Within a bucket links are found by hashing each fingerprint and its 64 one-bit neighbours: two
fingerprints are within two bits exactly if they share such a neighbour.  So a bucket of m fingerprints costs 65 m
and gives at most m - 1 links (a spanning forest of the true links) instead of m squared.  Buckets over
``bucket_rows`` go the same way as rows of a table instead of in one task's memory.  Copies are merged to one
fingerprint before any of this, with partial sums on the map side.

Components are found by alternating large-star and small-star steps, each written to the shared folder.

Defined cases: null and empty texts have fingerprint zero and link like any other; texts with fewer words than a
shingle are one shingle; repeated rows are members of the same component; null doc_ids are kept, a component's id
is the smallest non-null one; extra columns are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, records, slices, stage

#: Bit offset and width of the segments, and the ordered pairs (exact, decoded).
SEGMENTS = ((42, 22), (21, 21), (0, 21))
PAIRS = ((0, 1), (1, 2), (2, 0))
#: Generator polynomial of the binary Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
SEED = 42
CHUNK = 1 << 18


# ---- fingerprints ----------------------------------------------------------------------------------------


def fingerprint(text: str | None, shingle: int = 3) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words) - shingle + 1
    if not words:
        return 0
    if n <= 1:
        h = xxhash.xxh64_intdigest(b" ".join(words), SEED)
        return h
    joined, total = b" ".join(words), np.zeros(64, np.int64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
    ends = (ends - 1).tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        m = min(CHUNK, n - at)
        h = np.fromiter([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + m], ends[at + shingle - 1 : at + shingle - 1 + m], strict=True)], np.uint64, m)
        total += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(m, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fps = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


# ---- Golay keys ------------------------------------------------------------------------------------------


@cache
def golay() -> tuple[np.ndarray, np.ndarray]:
    """The syndrome (11 bits) of each half (upper 12, lower 11 bits) of a word, and each syndrome's error pattern
    of weight three at most."""

    def remainder(x: int) -> int:
        for k in range(22, 10, -1):
            if x >> k & 1:
                x ^= GENERATOR << (k - 11)
        return x

    unit = np.array([remainder(1 << k) for k in range(23)])
    error = np.zeros(2048, np.int64)
    for a in range(23):
        for b in range(a, 23):
            for c in range(b, 23):  # a == b == c: one error; a == b or b == c: one bit again, found below
                bits = {a, b, c}
                s, e = 0, 0
                for k in bits:
                    s ^= int(unit[k])
                    e |= 1 << k
                if error[s] == 0 or bin(e).count("1") < bin(int(error[s])).count("1"):
                    error[s] = e
    high = np.array([remainder(x << 11) for x in range(4096)])
    return high, error


def decode(word: np.ndarray) -> np.ndarray:
    """The index (12 bits) of the one codeword within three bits of each 23-bit word."""
    high, error = golay()
    syndrome = high[word >> 11] ^ (word & 2047)
    return (word ^ error[syndrome]) >> 11


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all distinct keys of each fingerprint."""
    rows, out = [], []
    n = np.arange(len(fps))
    for p, (exact, fuzzy) in enumerate(PAIRS):
        (ea, ew), (fa, fw) = SEGMENTS[exact], SEGMENTS[fuzzy]
        first = (fps >> np.uint64(ea)).astype(np.int64) & ((1 << ew) - 1)
        second = (fps >> np.uint64(fa)).astype(np.int64) & ((1 << fw) - 1)
        near = np.stack([decode(second), *(decode(second ^ (1 << k)) for k in range(fw))], axis=1)
        near.sort(axis=1)
        new = np.ones(near.shape, bool)
        new[:, 1:] = near[:, 1:] != near[:, :-1]
        r, c = np.nonzero(new)
        rows.append(n[r])
        out.append(((p << 22 | first[r]) << 12) | near[r, c])
    return np.concatenate(rows), np.concatenate(out)


def fuzzy_keys(distinct: DataFrame) -> DataFrame:
    """fp -> (bucket, fp), one row per key."""
    schema = pa.schema([("bucket", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            rows, key = keys(fps.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[rows])], schema=schema)

    return distinct.select("fp").mapInArrow(run, "bucket long, fp long")


# ---- verified links --------------------------------------------------------------------------------------

_ONE = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)])


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints."""
    if len(fps) == 2:
        return [(0, 1)] if bin(int(fps[0] ^ fps[1])).count("1") <= 2 else []
    near = (fps[:, None] ^ _ONE).ravel()
    owner = np.repeat(np.arange(len(fps)), 65)
    order = np.argsort(near, kind="stable")
    near, owner = near[order], owner[order]
    same = np.flatnonzero(near[1:] == near[:-1])
    parent = list(range(len(fps)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in zip(owner[same].tolist(), owner[same + 1].tolist(), strict=True):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return out


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by bucket."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def links(bucket: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        a, b = [], []
        bounds = np.concatenate([[0], cuts, [len(bucket)]])
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if e - s > 1:
                for x, y in forest(fp[s:e].view(np.uint64)):
                    a.append(int(fp[s + x]))
                    b.append(int(fp[s + y]))
        return records(_LINKS, [a, b])

    for batch in batches:
        bucket, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
        if not len(bucket):
            continue
        if held:
            bucket, fp = np.concatenate([held[0][0], bucket]), np.concatenate([held[0][1], fp])
        last = np.searchsorted(bucket, bucket[-1])  # the last bucket may go on in the next batch
        held = [(bucket[last:], fp[last:])]
        if last:
            yield links(bucket[:last], fp[:last])
    if held:
        yield links(*held[0])


def linked(distinct: DataFrame, bucket_rows: int = 100_000) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect exactly what links of two bits connect."""
    keyed = stage(fuzzy_keys(distinct), "simhash-keys")
    sizes = keyed.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    shared = keyed.join(sizes, "bucket").select("bucket", "fp", "n")
    small = shared.filter(F.col("n") <= bucket_rows).select("bucket", "fp").repartition("bucket").sortWithinPartitions("bucket", "fp").mapInArrow(_bucket_links, "a long, b long")
    flips = F.expr("concat(array(0L), transform(sequence(0, 63), k -> shiftleft(1L, k)))")
    stars = shared.filter(F.col("n") > bucket_rows).select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("near")).distinct()
    hubs = stars.groupBy("near").agg(F.min("fp").alias("hub"))
    large = stars.join(hubs, "near").filter("fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b"))
    return small.union(large).distinct()


# ---- components ------------------------------------------------------------------------------------------


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) of all nodes in ``links``; a component's id is its smallest node.

    Alternating large-star and small-star steps: each node's larger neighbours are linked to its smallest
    neighbour, then its smaller ones, until nothing changes.  The number of links never grows.  Should ``max_rounds`` (far beyond
    the logarithm of any table's size) not do, an error is raised: there is no partial result.
    """
    edges = stage(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "links")
    now = None
    for _ in range(max_rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("m").alias("y")), F.struct(F.col("v").alias("x"), F.col("m").alias("y")))).alias("e"))
        new = stage(small.select(F.col("e.x").alias("u"), F.col("e.y").alias("v")).filter("u <> v").distinct(), "links")
        before, now = now, new.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        discard(edges)
        edges = new
        if now == before:
            break
    else:
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def near_duplicates(docs: DataFrame, shingle: int = 3, bucket_rows: int = 100_000) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that is reachable over links, the document's own included."""
    fps = stage(fingerprints(docs, shingle), "simhash")
    distinct = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    links = linked(distinct, bucket_rows)
    member = components(links).withColumnRenamed("node", "fp")
    named = distinct.join(member, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    ids = named.groupBy("component").agg(F.min("first").alias("component_id"))
    by_fp = named.join(ids, "component").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", "fp", "component_id")


# ---- similar texts ---------------------------------------------------------------------------------------

#: Longs of the smallest mark; texts of a bucket that all meet at once; one text in so many is read for common shingles, which
#: stand in FEW_HOT of those at least; common shingles that are told apart at most; rows of a block of a bucket; candidates of a row
#: that are verified before its others are looked at again.
MARK, FEW, SAMPLE, FEW_HOT, MOST_HOT, BLOCK, NEAREST = 8, 50, 16, 3, 1_000_000, 4096, 2
SLACK = 1e-6


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes], shingle: int) -> np.ndarray:
    """The sorted hashes of the different shingles; fewer words than a shingle are one."""
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64).view(np.int64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    h = np.fromiter([digest(joined[x:y], SEED) for x, y in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=False)], np.uint64, len(words) - shingle + 1)
    return np.unique(h.view(np.int64))


def mark(grams: np.ndarray) -> np.ndarray:
    """Parities of the hashes by their residue, a bit or two for each shingle: two marks of one length differ in no more bits
    than two sets have shingles apart, and half of a mark's longs over the other half are the mark of half the length."""
    bits = 64 * max(MARK, 1 << max(0, (len(grams) - 1).bit_length() - 6))
    odd = np.bincount(grams.view(np.uint64) & np.uint64(bits - 1), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def folded(marks: np.ndarray, longs: int) -> np.ndarray:
    while marks.shape[-1] > longs:
        half = marks.shape[-1] // 2
        marks = marks[..., :half] ^ marks[..., half:]
    return marks


def _text_key(words: list[bytes]) -> int:
    """64 bits of a digest of the words."""
    return int.from_bytes(hashlib.md5(b" ".join(words), usedforsecurity=False).digest()[:8], "big", signed=True)


def _shingle_sets(shingle: int):
    """(k, text) -> (k, grams)."""
    schema = pa.schema([("k", pa.int64()), ("grams", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [shingles(_words(t.as_py()), shingle) for t in batch.column(1)]
            yield records(schema, [batch.column(0).to_pylist(), sets])

    return run


def prefix(n: int, similarity: float) -> int:
    """So many shingles of n, the first in an order that all texts share, have one in common with those of each similar set."""
    return n - int(np.ceil(similarity * n - SLACK)) + 1


_FACTS = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("k", pa.int64()), ("n", pa.int32()), ("mark", pa.list_(pa.int64())), ("rare", pa.list_(pa.int64())), ("common", pa.list_(pa.int64()))])
_FACTS_DDL = "doc_id long, version long, k long, n int, mark array<long>, rare array<long>, common array<long>"


def _facts(shingle: int, similarity: float, hot: np.ndarray):
    """(doc_id, version, text) -> the text's key, the size of its set, its mark, and the rare and the common ones of its first shingles,
    in an order that has the common ones last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out: list[list] = [[] for _ in range(5)]
            for text in batch.column(2):
                words = _words(text.as_py())
                g = shingles(words, shingle)
                known = hot[np.minimum(np.searchsorted(hot, g), len(hot) - 1)] == g if len(hot) else np.zeros(len(g), bool)
                rare, many = g[~known], prefix(len(g), similarity)
                for column, value in zip(out, (_text_key(words), len(g), mark(g), rare[:many], g[known][: max(0, many - len(rare))]), strict=True):
                    column.append(value)
            yield records(_FACTS, [batch.column(0).to_pylist(), batch.column(1).to_pylist(), *out])

    return run


def _meetings(similarity: float):
    """Over rows (bucket, k, n) sorted by bucket and k: all pairs (a, b) of fitting sizes in a bucket of FEW texts; in a
    larger one each text with the first, the first with itself too, under the bucket's name.  Of a bucket that goes on in the
    next batch FEW rows are held, or the first one if it is larger."""
    schema = pa.schema([("bucket", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def stars(bucket: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(a), pa.array(b)], schema=schema)

    def pairs(bucket: np.ndarray, k: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole buckets."""
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
        sizes = np.diff(cuts)
        for m in np.unique(sizes[(sizes > 1) & (sizes <= FEW)]).tolist():  # buckets of one size at a time
            s = cuts[:-1][sizes == m]
            i, j = np.triu_indices(m, 1)
            i, j = (s[:, None] + i).ravel(), (s[:, None] + j).ravel()
            fit = np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - SLACK
            i, j = i[fit], j[fit]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(i), pa.int64()), pa.array(k[i]), pa.array(k[j])], schema=schema)
        large = np.repeat(sizes > FEW, sizes)
        if large.any():
            yield stars(bucket[large], np.repeat(k[cuts[:-1]], sizes)[large], k[large])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]
        star: tuple[int, int, int] | None = None  # bucket, first and last k of a large bucket that may go on
        for batch in batches:
            rows = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns, strict=True)]
            if star and len(rows[0]):
                more = int(np.searchsorted(rows[0], star[0], "right"))
                k = rows[1][:more]
                k = k[np.concatenate([[star[2]], k[:-1]]) != k] if more else k
                if len(k):
                    yield stars(np.full(len(k), star[0]), np.full(len(k), star[1]), k)
                    star = (star[0], star[1], int(k[-1]))
                rows = [c[more:] for c in rows]
            if not len(rows[0]):
                held = rows
                continue
            star = None
            once = np.ones(len(rows[0]), bool)  # copies have one key
            once[1:] = (np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)
            rows = [c[once] for c in rows]
            last = int(np.searchsorted(rows[0], rows[0][-1]))
            yield from pairs(*[c[:last] for c in rows])
            held = [c[last:] for c in rows]
            if len(held[0]) > FEW:
                yield from pairs(*held)
                star, held = (int(held[0][0]), int(held[1][0]), int(held[1][-1])), [c[:0] for c in held]
        yield from pairs(*held)

    return run


def _across(similarity: float, low: int, high: int):
    """(minor rows, rows) of a block of a bucket, columns k, n, component, mark -> pairs (a, b) of a minor row and a row of another
    component whose sizes and marks leave it open whether they are similar: of a minor row's candidates, nearest marks
    first, the ones from ``low`` to ``high``; and a row without b if there are more."""
    share = (1 - similarity) / (1 + similarity)

    def run(minor: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n", kind="stable")
        k, n, component = (rows[c].to_numpy() for c in ("k", "n", "component"))
        longs = rows["mark"].map(len).to_numpy()  # grows with n
        stacks = {int(x): np.stack(rows["mark"].to_numpy()[longs == x]).view(np.uint64) for x in np.unique(longs)}
        a, b, more = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], False
        for own, size, group, m in zip(minor["k"], minor["n"], minor["component"], minor["mark"], strict=True):
            m, open_rows, distances = np.asarray(m).view(np.uint64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            first, last = np.searchsorted(n, similarity * size - SLACK), np.searchsorted(n, size / similarity + SLACK, "right")
            for length, stack in stacks.items():
                base = int(np.searchsorted(longs, length))
                i = np.arange(max(first, base), min(last, base + len(stack)))
                both = min(length, len(m))
                apart = np.bitwise_count(folded(stack[i - base], both) ^ folded(m, both)).sum(1, dtype=np.int64)
                fit = (apart <= share * (n[i] + size) + SLACK) & (k[i] != own)
                open_rows.append(i[fit])
                distances.append(apart[fit])
            i = np.concatenate(open_rows)
            i = i[np.lexsort((k[i], np.concatenate(distances)))]
            other = component[i] != group
            found = i[low:high][other[low:high]]
            more |= bool(other[high:].any())
            a.append(np.minimum(k[found], own))
            b.append(np.maximum(k[found], own))
        out = pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)}, dtype="Int64")
        return pd.concat([out, pd.DataFrame({"a": [0], "b": [None]}, dtype="Int64")]) if more else out

    return lambda minor, rows: run(minor, rows) if len(minor) and len(rows) else pd.DataFrame({"a": [], "b": []}, dtype="Int64")


def _buckets(large: DataFrame, member: DataFrame) -> DataFrame:
    """bucket, k, lead of the rows (bucket, k), where lead is a row of the bucket's largest component.  Of buckets that hold the same rows, as
    those of a passage's shingles do, one stays."""
    own = large.join(member.withColumnRenamed("node", "k"), "k", "left").select("bucket", "k", F.coalesce("component", "k").alias("component"))
    h = F.xxhash64("k")
    parts = own.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.min("k").alias("k"), F.bit_xor(h).alias("x"), F.sum(F.shiftright(h, 20)).alias("s"))
    whole = parts.groupBy("bucket").agg(F.max_by("k", F.struct("n", "k")).alias("lead"), F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.sum("s").alias("s"))
    kept = whole.groupBy("n", "x", "s").agg(F.min(F.struct("bucket", "lead")).alias("b")).select("b.*")
    return stage(large.join(broadcast_if(kept), "bucket").select("bucket", "k", "lead"), "large-buckets")


def _apart(large: DataFrame, member: DataFrame, marks: DataFrame, similarity: float, low: int, high: int) -> tuple[DataFrame, DataFrame]:
    """What `_across` gives for the rows (bucket, k, lead) of buckets that hold more than one component, and these rows.  All rows that
    aren't in the component of their bucket's lead are compared with all rows: in blocks of about BLOCK by BLOCK rows, a task each."""
    names = member.select(F.col("node").alias("k"), "component"), member.select(F.col("node").alias("lead"), F.col("component").alias("major"))
    own = large.join(names[0], "k", "left").join(names[1], "lead", "left").select("bucket", "k", "lead", F.coalesce("component", "k").alias("component"), F.coalesce("major", "lead").alias("major"))
    own = own.withColumn("minor", F.col("component") != F.col("major")).drop("major")
    sizes = own.groupBy("bucket").agg(F.count_if("minor").alias("n_minor"), F.count("*").alias("n_all")).filter("n_minor > 0")
    blocks, pieces = (F.ceil(F.col(c) / BLOCK).cast("int").alias(name) for c, name in (("n_minor", "blocks"), ("n_all", "pieces")))
    rows = stage(own.join(broadcast_if(sizes.select("bucket", blocks, pieces)), "bucket").join(marks, "k"), "open-buckets")
    at = lambda salt, n: F.pmod(F.xxhash64("k", F.lit(salt)), n).cast("int")
    every = lambda n: F.explode(F.expr(f"sequence(0, {n} - 1)"))
    what = ("bucket", "k", "n", "component", "mark")
    minor = rows.filter("minor").withColumn("block", at(1, F.col("blocks"))).select(*what, "block", every("pieces").alias("piece"))
    all_rows = rows.withColumn("piece", at(2, F.col("pieces"))).select(*what, every("blocks").alias("block"), "piece")
    task = ("bucket", "block", "piece")
    found = stage(minor.groupBy(*task).cogroup(all_rows.groupBy(*task)).applyInPandas(_across(similarity, low, high), "a long, b long").distinct(), "apart")
    return found, rows.select("bucket", "k", "lead")


def _similar(pairs: DataFrame, marks: DataFrame, texts: DataFrame, first: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) that are similar, of pairs (a, b): by sizes and marks first, then by the sets of what these leave open."""
    side = lambda t, c, *own: t.select(F.col("k").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in own])
    half = lambda c: f"transform(sequence(1, size({c}_mark) div 2), i -> {c}_mark[i - 1] ^ {c}_mark[i - 1 + size({c}_mark) div 2])"
    same = lambda c, d: f"if(size({c}_mark) > size({d}_mark), {half(c)}, {c}_mark)"
    bits = F.expr(f"aggregate(zip_with({same('a', 'b')}, {same('b', 'a')}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")
    marked = pairs.join(side(marks, "a", "n", "mark"), "a").join(side(marks, "b", "n", "mark"), "b")
    # of two sets that fit, the marks have one length or one is twice the other
    fit = marked.filter(F.least("a_n", "b_n") >= similarity * F.greatest("a_n", "b_n") - SLACK)
    left = stage(fit.filter(bits <= (1 - similarity) / (1 + similarity) * (F.col("a_n") + F.col("b_n")) + SLACK).select("a", "b"), "candidates")
    ids = first.join(left.select(F.explode(F.array("a", "b")).alias("k")).distinct(), "k")
    own = texts.join(broadcast_if(ids), ["doc_id", "version"]).select("k", "text")
    sets = stage(own.mapInArrow(_shingle_sets(shingle), "k long, grams array<long>").groupBy("k").agg(F.first("grams").alias("grams")), "shingle-sets")
    both = left.join(side(sets, "b", "grams"), "b").join(side(sets, "a", "grams"), "a")
    sizes = both.select("a", "b", F.size(F.array_intersect("a_grams", "b_grams")).alias("shared"), (F.size("a_grams") + F.size("b_grams")).alias("total"))
    found = stage(sizes.filter(F.col("shared") >= similarity * (F.col("total") - F.col("shared"))).select("a", "b"), "similar")
    discard(left, sets)
    return found


def _common(texts: DataFrame, shingle: int) -> np.ndarray:
    """Shingles that many texts of a sample have, sorted.  They only order prefixes: links don't depend on them."""
    some = texts.filter(f"pmod(version, {SAMPLE}) = 0").select(F.col("version").alias("k"), "text")
    sets = some.mapInArrow(_shingle_sets(shingle), "k long, grams array<long>").dropDuplicates(["k"])
    n = sets.select(F.explode("grams").alias("gram")).groupBy("gram").count()
    found, least = stage(n.filter(F.col("count") >= FEW_HOT), "common"), FEW_HOT
    while found.filter(F.col("count") >= least).count() > MOST_HOT:
        least *= 2
    hot = np.sort(found.filter(F.col("count") >= least).select("gram").toArrow().column(0).to_numpy())
    discard(found)
    return hot


def similar_texts(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, version (a hash of the text), component: texts that are linked by a Jaccard similarity of ``similarity`` or
    more of their sets of ``shingle``-word shingles have one component.

    Texts that are equal but for case and white space are one node.  Prefixes find all links: of two similar sets in one order of
    shingles, the first `prefix` of each have one in common.  Common shingles come last in that order, so a bucket is small
    unless its texts are made of common shingles.  In a bucket of `FEW` texts all pairs are candidates; in a larger one each text is
    compared with the first, and then what isn't in the bucket's largest component yet with all of it: first its two nearest candidates,
    then, if these left it in another component than some further candidate, the next ones, sixteen times as many each time, to the last one.  So a
    group of copies costs about its size and not its square, and no candidate is left out.  Buckets of common shingles are never gathered: their first text is an aggregate, and what is compared
    later goes in blocks of bounded size.  No candidate is dropped but by bounds: sizes, and marks, which differ in no more bits
    than the sets have shingles apart.  Null doc_ids take no part.
    """
    own = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text")
    facts = stage(own.mapInArrow(_facts(shingle, similarity, _common(own, shingle)), _FACTS_DDL), "text-facts")
    rows = stage(facts.select("doc_id", "version", "k").distinct(), "text-keys")
    first = stage(rows.groupBy("k").agg(F.min(F.struct("doc_id", "version")).alias("t")).select("k", "t.*"), "texts")
    again = rows.join(first.select("doc_id", "version"), ["doc_id", "version"], "left_anti").select("doc_id", "version")  # copies: few, but for odd tables
    one = facts.join(broadcast_if(again), ["doc_id", "version"], "left_anti")
    marks = stage(one.select("k", "n", "mark").dropDuplicates(["k"]), "marks")
    keyed = one.select(F.explode("rare").alias("bucket"), "k", "n").repartition("bucket").sortWithinPartitions("bucket", "k")
    met = stage(keyed.mapInArrow(_meetings(similarity), "bucket long, a long, b long").distinct(), "meetings")
    common = one.select(F.explode("common").alias("bucket"), "k").distinct()
    leads = common.groupBy("bucket").agg(F.min("k").alias("a"), F.count("*").alias("n")).filter("n > 1").select("bucket", "a")
    stars = stage(common.join(broadcast_if(leads), "bucket").select("bucket", "a", F.col("k").alias("b")), "stars")
    discard(facts)
    large = met.filter("bucket is not null").union(stars)
    links = _similar(met.select("a", "b").union(stars.select("a", "b")).filter("a <> b").distinct(), marks, own, first, shingle, similarity)
    member = stage(components(links), "members")
    large = _buckets(large.select("bucket", F.col("b").alias("k")).distinct(), member)
    low, high = 0, NEAREST
    while True:
        found, large = _apart(large, member, marks, similarity, low, high)
        more = _similar(found.filter("b is not null"), marks, own, first, shingle, similarity)
        if not more.isEmpty():
            links = links.union(more)
            member = stage(components(links), "members")
        if found.filter("b is null").isEmpty():
            break
        low, high = high, 16 * high + NEAREST
    return rows.join(member.withColumnRenamed("node", "k"), "k", "left").select("doc_id", "version", F.coalesce("component", "k").alias("component"))


def similar_documents(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, component_id (the smallest doc_id of the component) of `similar_texts`; a doc_id that stands for texts of
    several components is listed with each."""
    found = stage(similar_texts(docs, shingle, similarity), "similar-texts")
    ids = found.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return found.join(ids, "component").select("doc_id", "component_id").distinct()


def near_texts(docs: DataFrame, shingle: int = 3, bucket_rows: int = 100_000, wide: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, version (a hash of the text), component (its smallest version): texts that are linked by `near_duplicates`, i.e. by
    fingerprints of ``shingle`` words met over Golay keys, or by `similar_texts` of ``wide`` words, or over both in turns.  The fingerprints' links all
    count; similarity adds the near copies that fingerprints tell apart.  Null doc_ids take no part.
    """
    texts = docs.filter("doc_id is not null").select(F.xxhash64("text").alias("doc_id"), "text")
    alike = stage(near_duplicates(texts, shingle, bucket_rows).filter("doc_id <> component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")).distinct(), "simhash-groups")
    similar = stage(similar_texts(docs, wide, similarity), "similar-texts")
    leads = similar.groupBy("component").agg(F.min("version").alias("b"), F.max("version").alias("most")).filter("b < most")  # of one text: no link
    found = similar.join(broadcast_if(leads.select("component", "b")), "component").filter("version <> b").select(F.col("version").alias("a"), "b")
    member = components(alike.union(found)).select(F.col("node").alias("version"), F.col("component").alias("_lead"))
    return similar.select("doc_id", "version").join(broadcast_if(member), "version", "left").select("doc_id", "version", F.coalesce("_lead", "version").alias("component"))


def broadcast_if(ids: DataFrame, most: int = 500_000, name: str | None = "ids") -> DataFrame:
    """``ids`` to be broadcast if they are counted to be few; else a join shuffles.  They are written first, unless ``name`` is None
    because they are columns of a table that is."""
    held = stage(ids, name) if name else ids
    return F.broadcast(held) if held.count() <= most else held


def hex64(fp: str | Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
