"""Roll-ups: modules, files, and the rows of the skeleton reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import columns as C
from ..model import DOMAIN_KINDS, NOISE_CALLS, Graph
from .lookup import callees


def common_prefix(paths: DataFrame, column: str = "file") -> DataFrame:
    """One row (prefix): the longest common directory of all paths.  The first and the last path in component order
    have the prefix that all have, so two rows decide it."""
    own = C.parts(F.col(column))
    rooted = F.coalesce(F.bool_and(F.col(column).startswith("/")), F.lit(False))
    ends = paths.agg(F.min(own).alias("a"), F.max(own).alias("b"), rooted.alias("rooted"))
    # the file itself is no directory, even if it is the only one
    dirs = F.slice("a", 1, F.greatest(F.size("a") - 1, F.lit(0)))
    same = F.aggregate(F.sequence(F.lit(0), F.size(dirs)), F.lit(0), lambda n, i: F.when((n == i) & (F.get(dirs, i) == F.get(F.col("b"), i)), n + 1).otherwise(n))
    text = F.concat(F.when(F.col("rooted"), "/").otherwise(""), F.array_join(F.slice(dirs, 1, same), "/"))
    return ends.select(F.coalesce(text, F.lit("")).alias("prefix"))


def with_rel(nodes: DataFrame) -> DataFrame:
    """``rel``: the file below the common directory of all files."""
    prefix = F.broadcast(common_prefix(nodes))
    return nodes.crossJoin(prefix).withColumn("rel", C.rel_path(F.col("file"), F.col("prefix"))).drop("prefix")


def _set(condition: Column) -> Column:
    return F.array_sort(F.collect_set(F.when(condition, F.col("name"))))


def modules(nodes: DataFrame) -> DataFrame:
    """module, fn_count, pub_fn_count, test_count, and the sorted names of public structs, traits and enums and of
    domain items.  Files that look like tests only count functions."""
    rel = F.col("rel")
    rows = with_rel(nodes).filter(~C.overview_skips(rel)).withColumns({"module": C.module_name(rel), "test": C.overview_test(rel)})
    kind, public, test = F.col("kind"), F.col("visibility") == "Public", F.col("test")
    fn = kind == "Function"
    return rows.groupBy("module").agg(
        F.count_if(fn & ~test).alias("fn_count"),
        F.count_if(fn & ~test & public).alias("pub_fn_count"),
        F.count_if(fn & test).alias("test_count"),
        _set(~test & public & (kind == "Struct") & (F.col("name") != "anonymous")).alias("structs"),
        _set(~test & public & (kind == "Trait")).alias("traits"),
        _set(~test & public & (kind == "Enum")).alias("enums"),
        _set(~test & kind.isin(*DOMAIN_KINDS)).alias("domain"),
    )


def by_file(nodes: DataFrame) -> DataFrame:
    """file, n, first_line, last_line."""
    return nodes.groupBy("file").agg(F.count("*").alias("n"), F.min("start_line").alias("first_line"), F.max("end_line").alias("last_line"))


def children(g: Graph) -> DataFrame:
    """node_id, children: names of an enum's variants or a table's columns, last added first."""
    parent = g.nodes.filter("kind in ('Enum', 'Table')").select(F.col("node_id").alias("src"))
    child = g.nodes.filter("kind in ('EnumVariant', 'Column')").select(F.col("node_id").alias("dst"), "name")
    rows = g.edges.filter("kind = 'Contains'").join(parent, "src", "left_semi").join(child, "dst")
    ordered = F.sort_array(F.collect_list(F.struct("edge_id", "name")), asc=False)
    return rows.groupBy(F.col("src").alias("node_id")).agg(F.transform(ordered, lambda x: x["name"]).alias("children"))


def below(nodes: DataFrame, path: str | None) -> DataFrame:
    return nodes if path is None else nodes.filter(C.under(F.col("file"), path))


def skeleton(g: Graph, path: str | None = None) -> DataFrame:
    """file, node_id, line (``[pub ]label signature-or-name``), calls: all nodes, to be read by path and id."""
    text = F.concat(F.when(F.col("visibility") == "Public", "pub ").otherwise(""), C.label(F.col("kind")), F.lit(" "), F.coalesce("signature", "name"))
    return below(g.nodes, path).select("file", "node_id", text.alias("line")).join(callees(g), "node_id", "left").select("file", "node_id", "line", "calls")


def compact(g: Graph, path: str | None = None, max_items: int = 500, skip_tests: bool = True) -> DataFrame:
    """file, node_id, item, position (from 1): the first ``max_items`` items of the compact report.  Of a (name, kind) the first counts, by
    path components and id; impl blocks, variants and columns have no item of their own."""
    nodes = below(g.nodes, path).filter("kind <> 'File'").filter("kind <> 'Impl'")
    if skip_tests:
        nodes = nodes.filter(~C.test_file(F.col("file"))).filter(~((F.col("kind") == "Function") & C.test_function(F.col("name"))))
    nodes = nodes.withColumn("parts", C.parts(F.col("file")))
    first = nodes.groupBy("name", "kind").agg(F.min(F.struct("parts", "node_id")).alias("f"))
    own = first.select("kind", "name", "f.parts", "f.node_id").filter(C.short_tag(F.col("kind")) != "")
    top = own.orderBy("parts", "node_id").limit(max_items)
    rows = top.join(g.nodes.select("node_id", "file", "signature", "visibility"), "node_id")
    quiet = g.but(nodes=g.nodes.filter(~F.col("name").isin(*NOISE_CALLS)), edges=g.edges.join(F.broadcast(top.select(F.col("node_id").alias("src"))), "src", "left_semi"))
    rows = rows.join(callees(quiet), "node_id", "left").join(children(g), "node_id", "left")
    head = F.concat(F.when(F.col("visibility") == "Public", "+").otherwise(""), C.short_tag(F.col("kind")), F.lit(":"))
    inline = F.concat(F.col("name"), F.coalesce(F.concat(F.lit("["), F.array_join("children", ","), F.lit("]")), F.lit("")))
    plain = F.concat(F.coalesce(C.compress_signature(F.col("signature")), F.col("name")), F.coalesce(F.concat(F.lit("→["), F.array_join("calls", ","), F.lit("]")), F.lit("")))
    item = F.concat(head, F.when(F.col("kind").isin("Enum", "Table"), inline).otherwise(plain))
    at = F.row_number().over(W.orderBy("parts", "node_id"))  # over max_items rows at most
    return rows.select("file", "node_id", item.alias("item"), at.alias("position"))
