"""The lookups that the engine answers: definitions, references, search, listings, source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.columns import ends_with_path, label, lookup, search_score
from ..model import DEFINITION_KINDS, KIND_FILTERS, PRIMARY_KINDS, REFERENCE_KINDS, Graph
from .graph import traverse


def by_name(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.filter(F.col("name") == name)


def by_file(nodes: DataFrame, path: str) -> DataFrame:
    return nodes.filter(F.col("file") == path)


def primary(nodes: DataFrame, symbol: str) -> DataFrame:
    """The first node of that name that can be a symbol's own definition (no row without one)."""
    return by_name(nodes, symbol).filter(F.col("kind").isin(*PRIMARY_KINDS)).orderBy("node_id").limit(1)


def references(g: Graph, symbol: str) -> DataFrame:
    """node_id, ref_kind, name, kind, file, start_line: one definition per file and one row per node with an edge into any node of
    that name, whose kind is that of the edge that was added last to the first such node."""
    named = by_name(g.nodes, symbol)
    definitions = named.filter(F.col("kind").isin(*DEFINITION_KINDS)).groupBy("file").agg(F.min("node_id").alias("node_id")).select("node_id", F.lit("Definition").alias("ref_kind"))
    targets = named.filter(F.col("kind").isin(*DEFINITION_KINDS)).select(F.col("node_id").alias("dst"))
    into = g.edges.filter("kind <> 'Contains'").join(targets, "dst")
    first = into.groupBy("src").agg(F.min_by("kind", F.struct("dst", -F.col("edge_id"), "kind")).alias("kind"))
    kind = lookup(F.col("kind"), REFERENCE_KINDS, F.lit("Ref"))
    rows = definitions.union(first.select(F.col("src").alias("node_id"), kind.alias("ref_kind")))
    facts = g.nodes.filter("kind <> 'File'").select("node_id", "name", "kind", "file", "start_line")
    return rows.join(facts, "node_id").select("node_id", "ref_kind", "name", "kind", "file", "start_line")


def callers(g: Graph, symbol: str) -> DataFrame:
    return references(g, symbol).filter("ref_kind = 'Call'")


def implementations(g: Graph, trait: str) -> DataFrame:
    return references(g, trait).filter("ref_kind = 'Impl'")


def callees(g: Graph) -> DataFrame:
    """node_id, calls: the sorted different names that each node calls."""
    target = g.nodes.select(F.col("node_id").alias("dst"), "name")
    pairs = g.edges.filter("kind = 'Calls'").join(target, "dst").select("src", "name").distinct()
    return pairs.groupBy(F.col("src").alias("node_id")).agg(F.array_sort(F.collect_list("name")).alias("calls"))


def dependencies(g: Graph, symbol: str, direction: str = "outgoing", max_depth: int = 5) -> DataFrame:
    """node_id, name, kind, file, start_line, depth of what a symbol reaches, or of what reaches it."""
    found = traverse(g.edges, primary(g.nodes, symbol), direction, max_depth)
    return found.join(g.nodes.filter("kind <> 'File'"), "node_id").select("node_id", "name", "kind", "file", "start_line", "depth")


def impact(g: Graph, symbol: str, max_depth: int = 10) -> DataFrame:
    return dependencies(g, symbol, "incoming", max_depth)


def search(nodes: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """score, name, kind, node_id, file, start_line, total: the best ``limit`` names, one row per (name, kind)."""
    found = nodes.filter("kind <> 'File'").withColumn("score", search_score(F.col("name"), query)).filter("score is not null")
    best = found.groupBy("name", "kind").agg(F.min(F.struct("score", "node_id", "file", "start_line")).alias("b"))
    rows = best.select("b.score", "name", "kind", "b.node_id", "b.file", "b.start_line")
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy("score", "name", "kind").limit(limit).crossJoin(F.broadcast(total))


def search_signatures(nodes: DataFrame, query: str, limit: int = 30) -> DataFrame:
    """node_id, name, signature, file, start_line, total: signatures with the text in any case, by line."""
    found = nodes.filter(F.lower("signature").contains(query.lower())).select("node_id", "name", "signature", "file", "start_line")
    total = found.agg(F.count("*").alias("total"))
    return found.orderBy("start_line", "file", "node_id").limit(limit).crossJoin(F.broadcast(total))


def symbols(nodes: DataFrame, kind: str = "all", public_only: bool = False, limit: int = 50) -> DataFrame:
    """label, shown (the signature, else the name), node_id, file, start_line, total."""
    if kind not in KIND_FILTERS:
        raise ValueError(f"Unknown kind '{kind}'. Use: fn, struct, trait, enum, macro, module, type, all")
    found = nodes.filter(F.col("kind").isin(*KIND_FILTERS[kind]))
    if public_only:
        found = found.filter("visibility = 'Public'")
    rows = found.select(label(F.col("kind")).alias("label"), F.coalesce("signature", "name").alias("shown"), "node_id", "file", "start_line")
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy("label", "shown", "node_id").limit(limit).crossJoin(F.broadcast(total))


def find_file(nodes: DataFrame, path: str) -> DataFrame:
    """One row (file): the path itself, else the first file that ends with it."""
    files = nodes.select("file").distinct().filter(ends_with_path(F.col("file"), path))
    return files.orderBy(F.col("file") != path, "file").limit(1)


def file_summary(g: Graph, path: str) -> DataFrame:
    """The symbols of a file by line: node_id, label, visibility, shown, start_line, calls."""
    own = g.nodes.filter("kind <> 'File'").join(F.broadcast(find_file(g.nodes, path)), "file")
    calls = callees(g.but(edges=g.edges.join(own.select(F.col("node_id").alias("src")), "src", "left_semi")))
    rows = own.join(calls, "node_id", "left")
    return rows.select("node_id", label(F.col("kind")).alias("label"), "visibility", F.coalesce("signature", "name").alias("shown"), "start_line", "calls").orderBy("start_line", "node_id")


def source(g: Graph, files: DataFrame, symbol: str, max_lines: int = 100) -> DataFrame:
    """file, line, text, total: the lines of a symbol's definition, else of the first node of its name."""
    named = by_name(g.nodes, symbol).filter("kind <> 'File'").withColumn("rank", F.when(F.col("kind").isin(*PRIMARY_KINDS), 0).otherwise(1))
    one = named.orderBy("rank", "node_id").limit(1).select("file", "start_line", "end_line")
    return slice_lines(files, one, max_lines)


def slice_lines(files: DataFrame, spans: DataFrame, max_lines: int = 100) -> DataFrame:
    """file, line, text, total of the spans (file, start_line, end_line) of ``files`` (path, content)."""
    joined = spans.join(files.select(F.col("path").alias("file"), "content"), "file")
    every = joined.select("file", "start_line", "end_line", F.posexplode(F.split("content", "\n")).alias("at", "text"))
    inside = every.withColumn("line", F.col("at") + 1).filter("line between greatest(start_line, 1) and end_line")
    numbered = inside.withColumn("total", F.count("*").over(W.partitionBy("file", "start_line"))).filter(F.col("line") < F.greatest("start_line", F.lit(1)) + max_lines)
    return numbered.select("file", "line", "text", F.col("total").cast("long").alias("total"))
