"""Operators on the graph as a whole: traversal, degrees, union and removal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.columns import span_lines, short_tag, under
from ..model import HUBLESS_KINDS, NOISE_NAMES, Graph
from ..scratch import written


#: Rows of ids that are broadcast at most.
SMALL = 500_000


def traverse(edges: DataFrame, start: DataFrame, direction: str = "outgoing", max_depth: int = 5) -> DataFrame:
    """(node_id, depth) of what is reachable from the rows of ``start`` (node_id) over edges of all kinds, the start
    itself excluded.  The different hops are written once.  A round joins the frontier with them and drops what was seen; a
    frontier that is counted to be small is broadcast, so that a round reads the hops and shuffles what it found.  Each frontier is written, so
    a plan never grows; the rounds end with the frontier."""
    if direction not in ("outgoing", "incoming"):
        raise ValueError(f"no such direction: {direction}")
    here, there = ("src", "dst") if direction == "outgoing" else ("dst", "src")
    hops = written(edges.select(F.col(here).alias("node_id"), F.col(there).alias("next")).filter(F.col(here) != F.col(there)).distinct(), "hops")
    frontier = seen = written(start.select("node_id").distinct().withColumn("depth", F.lit(0)), "frontier")
    small = lambda t: F.broadcast(t) if t.count() <= SMALL else t
    for depth in range(1, max_depth + 1):
        found = hops.join(small(frontier.select("node_id")), "node_id").select(F.col("next").alias("node_id")).distinct()
        frontier = written(found.join(small(seen.select("node_id")), "node_id", "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen.filter("depth > 0")


def degrees(g: Graph) -> DataFrame:
    """(node_id, degree) over edges that aren't Contains; a self-loop counts twice."""
    ends = g.edges.filter("kind <> 'Contains'").select(F.explode(F.array("src", "dst")).alias("node_id"))
    return ends.groupBy("node_id").agg(F.count("*").alias("degree"))


def hubs(g: Graph, k: int = 7) -> DataFrame:
    """name, tag, degree of the k best connected names; of a name's nodes the best connected counts, then the first."""
    nodes = g.nodes.filter(~F.col("kind").isin(*HUBLESS_KINDS) & ~F.col("name").isin(*NOISE_NAMES))
    found = nodes.select("node_id", "name", "kind").join(degrees(g).filter("degree > 1"), "node_id")
    best = found.groupBy("name").agg(F.max(F.struct("degree", (-F.col("node_id")).alias("first"), "kind")).alias("b"))
    return best.select("name", short_tag(F.col("b.kind")).alias("tag"), F.col("b.degree").alias("degree")).orderBy(F.desc("degree"), "name").limit(k)


def edge_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("kind").agg(F.count("*").alias("n"))


def stats(nodes: DataFrame) -> DataFrame:
    """One row: how many nodes of which kind, and the lines of all spans (nested ones count again)."""
    named = {"files": "File", "functions": "Function", "structs": "Struct", "traits": "Trait", "enums": "Enum", "modules": "Module"}
    counts = [F.count_if(F.col("kind") == kind).alias(name) for name, kind in named.items()]
    lines = F.coalesce(F.sum(span_lines(F.col("start_line"), F.col("end_line"))), F.lit(0)).cast("long")
    return nodes.agg(*counts, F.count_if(~F.col("kind").isin(*named.values())).alias("other"), lines.alias("total_lines"))


def union(a: Graph, b: Graph) -> Graph:
    return a.but(nodes=a.nodes.unionByName(b.nodes), edges=a.edges.unionByName(b.edges))


def remove_files(g: Graph, paths: DataFrame) -> Graph:
    """Without the nodes of the files in ``paths`` (path) and the edges at either end of them."""
    gone = g.nodes.join(paths.select(F.col("path").alias("file")).distinct(), "file", "left_semi").select("node_id")
    nodes = g.nodes.join(gone, "node_id", "left_anti")
    edges = g.edges
    for end in ("src", "dst"):
        edges = edges.join(gone.withColumnRenamed("node_id", end), end, "left_anti")
    return g.but(nodes=nodes, edges=edges.select(*g.edges.columns))


def shifted(g: Graph, by: int) -> Graph:
    nodes = g.nodes.withColumn("node_id", F.col("node_id") + by)
    return g.but(nodes=nodes, edges=g.edges.withColumns({c: F.col(c) + by for c in ("edge_id", "src", "dst")}))


def merge(a: Graph, b: Graph) -> Graph:
    """Both graphs, the second's ids moved beyond the first's.  Unresolved sites of the second aren't taken over."""
    tops = [t.agg(F.max(c)).first()[0] for t, c in ((a.nodes, "node_id"), (a.edges, "edge_id"))]
    return union(a, shifted(b, 1 + max([t for t in tops if t is not None], default=-1)))


def ids(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Consecutive ids in order of (group, order), by a distributed sort: a row's number within its partition and the rows of the
    partitions before, of which there is one number each."""
    at = F.monotonically_increasing_id()
    columns = rows.columns
    sorted_rows = written(rows.orderBy(*group, *order).select(*columns, F.shiftright(at, 33).alias("_part"), at.bitwiseAND((1 << 33) - 1).alias("_at")), "sorted")
    before, n = [], 0
    for part, size in sorted(sorted_rows.groupBy("_part").count().collect()):
        before.append((part, n))
        n += size
    offsets = rows.sparkSession.createDataFrame(before or [(0, 0)], "_part long, _before long")
    return sorted_rows.join(F.broadcast(offsets), "_part").select(*columns, (F.col("_before") + F.col("_at")).cast("long").alias(name))


def room(g: Graph, prefix: str) -> DataFrame:
    """One row: the ids of the nodes below a path, in order."""
    return g.nodes.filter(under(F.col("file"), prefix)).agg(F.array_sort(F.collect_list("node_id")).alias("nodes"))
