"""Resolution of names into edges: equi-joins of sites with nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: closed: every match.  strict: as if nodes came one by one in order of their ids, see `resolve_calls`.
MODES = ("closed", "strict")
#: Tasks that the sites of one name are dealt out to, parts that its nodes are sorted in; sites and nodes of a tile at most; tasks for
#: each core.
SLICES, PARTS, SITES, NODES, TASKS = 8, 8, 256, 256, 8


def _mode(mode: str) -> bool:
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}")
    return mode == "strict"


def _tiles(rows: DataFrame, keys: list[str], columns: list[str], size: int) -> DataFrame:
    """(keys, _tile, _rows): the rows of the same keys in the order of ``columns``, ``size`` of them gathered at most."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*columns))
    numbered = rows.withColumn("_tile", F.floor((place - 1) / size))
    return numbered.groupBy(*keys, "_tile").agg(F.collect_list(F.struct(*columns)).alias("_rows"))  # within a struct a null is collected too


def _meet(sites: DataFrame, targets: DataFrame, *names: DataFrame) -> DataFrame:
    """Each row of ``sites`` (src, name, ...) with each of ``targets`` (dst, name) of its name, and the columns of ``names`` (name, ...).

    What moves is a site once and a node once for each slice of its name's sites; pairs arise behind the last shuffle, row by row, and
    move no more.  So a name with many sites and nodes costs disk by their sum and is the work of `SLICES` tasks; the pairs are the output.
    They come tile by tile: some sites, each with the same few nodes in the same order.  A column file holds a site's run and the
    repeated nodes by reference then, which takes a tenth of the disk or less that all nodes of a name after each site take.
    """
    columns = [c for c in sites.columns if c != "name"]
    dealt = sites.withColumn("_slice", F.pmod(F.xxhash64("src"), F.lit(SLICES)).cast("int"))
    parts = targets.withColumn("_part", F.pmod(F.xxhash64("dst"), F.lit(PARTS)))
    rows = _tiles(parts, ["name", "_part"], ["dst"], NODES).select("name", F.col("_rows.dst").alias("_dsts"))
    for more in (*names, dealt.select("name", "_slice").distinct()):
        rows = rows.join(more, "name")
    # tasks by number: few bytes make many pairs, so bytes don't tell how many are of use
    spark = sites.sparkSession
    tasks = max(TASKS * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tiles = _tiles(dealt.repartition(tasks, "name", "_slice"), ["name", "_slice"], columns, SITES).drop("_tile")
    # merged, one tile of sites is held with its rows; compiled code keeps all that it makes of one input row, and a lambda isn't compiled, so that the pairs of one site and tile are made and passed on at a time
    met = tiles.hint("merge").join(rows, ["name", "_slice"]).withColumn("_site", F.explode(F.transform("_rows", lambda x: x)))
    return met.select("name", "_site.*", *[c for c in rows.columns if c not in ("name", "_slice")]).withColumn("dst", F.explode("_dsts")).drop("_dsts")


def resolve_calls(call_sites: DataFrame, nodes: DataFrame, mode: str = "closed") -> DataFrame:
    """(src, dst) of calls: nodes of any kind that have the called name, but the caller itself.

    strict: a caller sees the nodes up to itself; only if none of them has the name, later nodes are taken.
    """
    sites = call_sites.filter("callee_name <> ''").select(F.col("caller_id").alias("src"), F.col("callee_name").alias("name")).distinct()
    named = nodes.filter("node_id is not null and name is not null").select(F.col("node_id").alias("dst"), "name")
    first = [named.groupBy("name").agg(F.min("dst").alias("first"))] if _mode(mode) else []
    seen = "src <> dst and (first > src or dst <= src)" if first else "src <> dst"
    found = lambda targets: _meet(sites, targets, *first).filter(seen).select("src", "dst")
    ids = named.groupBy("dst").agg(F.collect_set("name").alias("names"))
    # a pair comes twice only if its node's id stands with several names
    return found(ids.filter("size(names) = 1").select("dst", F.col("names")[0].alias("name"))).union(found(ids.filter("size(names) > 1").select("dst", F.explode("names").alias("name"))).distinct())


def resolve_impls(impl_sites: DataFrame, nodes: DataFrame, mode: str = "closed", call_sites: DataFrame | None = None) -> DataFrame:
    """(src, dst, seq): each site's first Trait of that name.  strict: nothing is resolved unless some call was
    deferred, i.e. has a name that no node up to the caller has."""
    traits = nodes.filter("kind = 'Trait'").groupBy("name").agg(F.min("node_id").alias("dst"))
    found = impl_sites.select(F.col("impl_id").alias("src"), F.col("trait_name").alias("name"), "seq").join(traits, "name").select("src", "dst", "seq")
    if _mode(mode) and call_sites is not None:
        first = nodes.groupBy("name").agg(F.min("node_id").alias("first"))
        late = call_sites.join(first, F.col("callee_name") == F.col("name"), "left").filter("first is null or first > caller_id").limit(1).select(F.lit(1).alias("_any"))
        found = found.crossJoin(F.broadcast(late)).drop("_any")
    return found


def resolve_refs(name_refs: DataFrame, nodes: DataFrame, mode: str = "closed") -> DataFrame:
    """(src, dst, kind) of other references.  With target kinds the first match of such a kind counts, without them every
    match.  strict: only nodes before the source are seen.  A reference that is listed twice is resolved twice."""
    strict = _mode(mode)
    sites = name_refs.withColumnRenamed("ref_name", "name")
    every = _meet(sites.filter("target_kinds is null").select("src", "name", "edge_kind"), nodes.filter("name is not null").select(F.col("node_id").alias("dst"), "name"))
    firsts = nodes.groupBy("name", "kind").agg(F.min("node_id").alias("dst")).groupBy("name").agg(F.collect_list(F.struct("kind", "dst")).alias("_firsts"))
    fit = F.filter("_firsts", lambda x: F.array_contains("target_kinds", x["kind"]))
    first = sites.filter("target_kinds is not null").join(firsts, "name").select("src", "edge_kind", fit.alias("_fit")).filter("size(_fit) > 0").withColumn("dst", F.array_min("_fit.dst"))
    found = every.select("src", "dst", F.col("edge_kind").alias("kind")).union(first.select("src", "dst", F.col("edge_kind").alias("kind")))
    return found.filter("dst < src") if strict else found
