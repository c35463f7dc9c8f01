"""Exact top-k search by integer inner product over KD-trees.

Vectors are dealt into shards of about ``shard_rows`` rows: cells that are cut at the medians of a bounded sample's widest axes, so that a
shard's box is tight too, and large cells dealt further by a hash.  In a shard a KD-tree splits at the median of its widest
axis and each node keeps the tight box around its vectors.  The best inner product that a box can hold is the sum
of max(q * low, q * high) over the axes; the traversal visits nodes best first by that bound and ends when the bound
is below the kth best score so far.

Two rounds keep the shards from each searching alone: a query first runs in its own shard, and its kth score there goes
with it to the other shards whose box may reach it; there nodes are skipped by their boxes in the same way.  Boxes are tested
before any vector moves.  A shard's tree is built once in a round, and queries stream past it.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part, neither as
query nor as candidate; vectors of different lengths are never compared; a query's own vec_id is no candidate (so no
repeated row of it either); a vec_id that has several vectors asks with each of them, one that repeats a vector asks once with it; repeated rows are candidates each, ties of score go to the smaller vec_id; null vec_ids
take no part; fewer than k candidates give fewer rows; no rows give no rows.  Scores are exact while
|component| < 2**28 after scaling and sums stay below 2**63.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import records, stage

LEAF = 256


class Tree:
    """A KD-tree over integer vectors with a tight box for each node."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> None:
        order = np.lexsort((ids,))
        self.ids, self.vectors = ids[order], vectors[order]
        self.nodes: list[tuple[np.ndarray, int, int]] = []  # rows or None, left, right
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        todo = [(np.arange(len(ids)), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            own = self.vectors[rows]
            low, high = own.min(0), own.max(0)
            k = len(self.nodes)
            self.low.append(low)
            self.high.append(high)
            axis = int(np.argmax(high - low))
            if len(rows) <= leaf or high[axis] == low[axis]:
                self.nodes.append((rows, -1, -1))
            else:
                self.nodes.append((rows[:0], -1, -1))
                part = np.argsort(own[:, axis], kind="stable")
                half = len(rows) // 2
                todo += [(np.sort(rows[part[half:]]), k, 2), (np.sort(rows[part[:half]]), k, 1)]
            if parent >= 0:
                node = list(self.nodes[parent])
                node[side] = k
                self.nodes[parent] = tuple(node)
        self.low_a, self.high_a = np.stack(self.low), np.stack(self.high)

    def search(self, query_id: int, q: np.ndarray, k: int, least: int | None) -> list[tuple[int, int]]:
        """(score, id) of the k best, none below ``least``."""
        positive = np.maximum(q, 0)
        bounds = self.high_a @ positive + self.low_a @ (q - positive)
        best: list[tuple[int, int]] = []  # a heap of (score, -id): the worst first
        todo = [(-int(bounds[0]), 0)]
        while todo:
            bound, at = heapq.heappop(todo)
            bound = -bound
            if least is not None and bound < least or len(best) == k and bound < best[0][0]:
                break
            rows, left, right = self.nodes[at]
            if left >= 0:
                heapq.heappush(todo, (-int(bounds[left]), left))
                heapq.heappush(todo, (-int(bounds[right]), right))
                continue
            scores = self.vectors[rows] @ q
            floor = max([x for x in (least, best[0][0] if len(best) == k else None) if x is not None], default=None)
            hit = np.flatnonzero(scores >= floor) if floor is not None else np.arange(len(rows))
            if len(hit) > 4 * k:  # all that tie with the kth stay; then smaller ids first
                top = np.lexsort((self.ids[rows[hit]], -scores[hit]))[: k + 1 + int((self.ids[rows[hit]] == query_id).sum())]
                hit = hit[top]
            for s, i in zip(scores[hit].tolist(), self.ids[rows[hit]].tolist(), strict=True):
                if i == query_id:
                    continue
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (s, -i))
        return [(s, -i) for s, i in best]


def scaled(embeddings: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id, v: the vectors that take part, each component floor(scale * x) with x as a double."""
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return embeddings.filter(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long")).alias("v"))


def splits(sample: np.ndarray, cells: int) -> list[tuple[int, int, int, int]]:
    """(axis, cut, below, above) of a tree that cuts a sample at medians of widest axes into about ``cells`` cells; a negative
    number -c - 1 below or above is cell c."""
    nodes: list[tuple[int, int, int, int]] = []
    count = 0

    def cut(rows: np.ndarray, want: int) -> int:
        nonlocal count
        own = sample[rows]
        axis = int(np.argmax(own.max(0) - own.min(0))) if len(rows) else 0
        values = np.sort(own[:, axis]) if len(rows) else own[:0, 0]
        if want < 2 or len(rows) < 2 or values[0] == values[-1]:
            count += 1
            return -count
        at = int(values[len(values) // 2])
        at = at if at > values[0] else int(values[np.searchsorted(values, at, "right")])
        k = len(nodes)
        nodes.append((axis, at, 0, 0))
        low = own[:, axis] < at
        nodes[k] = (axis, at, cut(rows[low], want // 2), cut(rows[~low], want - want // 2))
        return k

    cut(np.arange(len(sample)), cells)
    return nodes


def cell_of(vectors: np.ndarray, nodes: list[tuple[int, int, int, int]]) -> np.ndarray:
    out, todo = np.zeros(len(vectors), np.int32), [(np.arange(len(vectors)), 0 if nodes else -1)]
    while todo:
        rows, k = todo.pop()
        if k < 0:
            out[rows] = -k - 1
        elif len(rows):
            axis, at, below, above = nodes[k]
            low = vectors[rows, axis] < at
            todo += [(rows[low], below), (rows[~low], above)]
    return out


#: A shard's name.
SHARD = ["dim", "cell", "sub"]
_FOUND = "query_id long, version long, score long, vec_id long"
_FOUND_SCHEMA = pa.schema([("query_id", pa.int64()), ("version", pa.int64()), ("score", pa.int64()), ("vec_id", pa.int64())])


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _runs(batch: pa.RecordBatch, columns: int) -> list[tuple[int, int]]:
    """The stretches of rows that are equal in the first columns."""
    keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(columns)])
    cuts = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1, [batch.num_rows]]).tolist()
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (dim, cell, sub, v) -> dim, cell, sub, low, high: the boxes of stretches of rows of a shard."""
    for batch in batches:
        for s, e in _runs(batch, 3) if batch.num_rows else ():
            own = _matrix(batch.column(3).slice(s, e - s))
            yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(s, 1) for k in range(3)], pa.array([own.min(0)], pa.list_(pa.int64())), pa.array([own.max(0)], pa.list_(pa.int64()))], names=["dim", "cell", "sub", "low", "high"])


def _search(k: int):
    """Over rows (dim, cell, sub, query, id, version, least, v) sorted so that a shard's vectors come before its queries: its tree is built
    once, and the queries stream past it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, tree = None, [], None
        for batch in batches:
            for s, e in _runs(batch, 4) if batch.num_rows else ():
                part = batch.slice(s, e - s)
                name = tuple(part.column(c)[0].as_py() for c in range(3))
                if name != shard:
                    shard, held, tree = name, [], None
                ids, vectors = part.column(4).to_numpy(zero_copy_only=False), _matrix(part.column(7))
                if not part.column(3)[0].as_py():
                    held.append((ids, vectors))
                    continue
                if tree is None and held:
                    tree, held = Tree(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])), []
                out: list[tuple[int, int, int, int]] = []
                for q, version, least, v in zip(ids.tolist(), part.column(5).to_pylist(), part.column(6).to_pylist(), vectors, strict=True):
                    out += [(q, version, score, i) for score, i in tree.search(q, v, k, least)] if tree else []
                if out:
                    yield records(_FOUND_SCHEMA, [list(c) for c in zip(*out, strict=True)])

    return run


def _answers(table: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, version, score, vec_id of queries (SHARD, query_id, version, least, qv) in their shards."""
    none = F.lit(None).cast("long")
    rows = table.join(queries.select(*SHARD).distinct(), SHARD, "left_semi").select(*SHARD, F.lit(0).alias("query"), F.col("vec_id").alias("id"), none.alias("version"), none.alias("least"), "v")
    asked = queries.select(*SHARD, F.lit(1).alias("query"), F.col("query_id").alias("id"), "version", "least", F.col("qv").alias("v"))
    return rows.union(asked).repartition(*SHARD).sortWithinPartitions(*SHARD, "query").mapInArrow(_search(k), _FOUND)


def reach(queries: DataFrame, boxes: DataFrame, block: int = 32_768) -> DataFrame:
    """query_id, version, least and SHARD of the shards but the query's own (dim, cell, sub) whose box may hold a score of ``least`` or more.
    Boxes go to the tasks in blocks of at most about ``block``; only names and numbers come out."""
    schema = pa.schema([("query_id", pa.int64()), ("version", pa.int64()), ("least", pa.int64()), ("dim", pa.int32()), ("cell", pa.int32()), ("sub", pa.int32())])

    def tests(names: np.ndarray, low: list[np.ndarray], high: list[np.ndarray]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for s, e in _runs(batch, 1) if batch.num_rows else ():  # of one dim
                    part = batch.slice(s, e - s)
                    own = np.flatnonzero(names[:, 0] == part.column(0)[0].as_py())
                    if not len(own):
                        continue
                    q = _matrix(part.column(6)).astype(float)
                    bound = np.maximum(q, 0) @ np.stack([high[i] for i in own]).astype(float).T + np.minimum(q, 0) @ np.stack([low[i] for i in own]).astype(float).T
                    least = np.array([-np.inf if x is None else x for x in part.column(5).to_pylist()], float)
                    home = np.stack([part.column(c).to_numpy(zero_copy_only=False) for c in (1, 2)], 1)
                    away = (names[own][None, :, 1:] != home[:, None]).any(2)
                    at, box = np.nonzero(away & (bound + np.abs(bound) * 1e-9 + 1 >= least[:, None]))  # sums are rounded: a little is added
                    if len(at):
                        at, shard = pa.array(at), names[own[box]]
                        yield pa.RecordBatch.from_arrays([part.column(3).take(at), part.column(4).take(at), part.column(5).take(at), *[pa.array(shard[:, c].astype(np.int32)) for c in range(3)]], schema=schema)

        return run

    blocks = max(1, -(-boxes.count() // block))
    asked = queries.select(*SHARD, "query_id", "version", "least", "qv").sortWithinPartitions("dim")
    out = None
    for b in range(blocks):
        own = boxes.filter(F.pmod(F.xxhash64(*SHARD), F.lit(blocks)) == b).toArrow().combine_chunks()
        names = np.stack([own.column(c).to_numpy() for c in SHARD], 1)
        low, high = ([x.values.to_numpy() for x in own.column(c)] for c in ("low", "high"))
        found = asked.mapInArrow(tests(names, low, high), "query_id long, version long, least long, dim int, cell int, sub int")
        out = found if out is None else out.union(found)
    return out.distinct()


def shards_of(vectors: DataFrame, shard_rows: int, sample_rows: int) -> DataFrame:
    """vec_id, v, version (a hash of v) and SHARD: cells cut at the medians of a sample of at most about ``sample_rows`` vectors, and a
    cell of more than ``shard_rows`` vectors dealt by a hash, so that equal vectors fill many shards."""
    rows = vectors.withColumns({"dim": F.size("v"), "version": F.xxhash64("v")})
    sizes = {r["dim"]: r["count"] for r in rows.groupBy("dim").count().collect()}
    n = sum(sizes.values())
    drawn = rows.filter(F.shiftrightunsigned(F.xxhash64("vec_id", F.lit("draw")), 1) < ((1 << 63) - 1) * min(sample_rows, n) // max(1, n)) if n > sample_rows else rows
    held: dict[int, list] = {}
    for dim, v in drawn.select("dim", "v").toArrow().to_pandas().itertuples(index=False):
        held.setdefault(int(dim), []).append(v)
    trees = {dim: splits(np.stack(own), min(max(1, -(-sizes[dim] // shard_rows)), max(1, len(own) // 16))) for dim, own in held.items()}

    def cells(v: pd.Series) -> pd.Series:
        out = np.zeros(len(v), np.int32)
        dims = v.map(len).to_numpy()
        for dim in np.unique(dims).tolist():
            out[dims == dim] = cell_of(np.stack(v.to_numpy()[dims == dim]), trees.get(dim, []))
        return pd.Series(out)

    celled = stage(rows.withColumn("cell", F.pandas_udf(cells, "int")("v")), "kd-cells")
    parts = celled.groupBy("dim", "cell").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("parts"))  # as many as the sample has cells
    sub = F.pmod(F.xxhash64("vec_id", "version"), F.col("parts")).cast("int")
    dealt = celled.join(F.broadcast(parts), ["dim", "cell"]).withColumn("sub", sub).select("vec_id", "v", "version", *SHARD)
    return stage(dealt.repartition(*SHARD).sortWithinPartitions(*SHARD), "kd-shards")


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, shard_rows: int = 8192, sample_rows: int = 20_000) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best; ``vectors`` as `scaled` gives them.  A task holds
    one shard's tree and a batch of queries."""
    table = shards_of(vectors, shard_rows, sample_rows)
    queries = stage(table.filter(is_query).select(F.col("vec_id").alias("query_id"), "version", F.col("v").alias("qv"), *SHARD).dropDuplicates(["query_id", "version"]), "kd-queries")
    at_home = stage(_answers(table, queries.withColumn("least", F.lit(None).cast("long")), k), "kd-home")
    kth = at_home.groupBy("query_id", "version").agg(F.count("*").alias("n"), F.min("score").alias("score")).select("query_id", "version", F.when(F.col("n") >= k, F.col("score")).alias("least"))
    boxes = stage(table.select(*SHARD, "v").mapInArrow(_boxes, "dim int, cell int, sub int, low array<long>, high array<long>"), "kd-boxes")
    away = stage(reach(queries.join(kth, ["query_id", "version"], "left"), boxes), "kd-away")
    found = at_home.union(_answers(table, away.join(queries.select("query_id", "version", "qv"), ["query_id", "version"]), k))
    order = W.partitionBy("query_id", "version").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
