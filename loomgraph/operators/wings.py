"""Wings (projects in one graph), rooms in them, and tunnels between symbols of the same name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import under
from ..model import TUNNEL_PAIRS, Graph


def members(nodes: DataFrame, wings: DataFrame) -> DataFrame:
    """wing_id, node_id, name, kind of the nodes below each wing's root.  Wings are projects: a short table."""
    joined = nodes.join(F.broadcast(wings.select("wing_id", "root")), under(F.col("file"), F.col("root")))
    return joined.select("wing_id", "node_id", "name", "kind")


def tunnel_classes(nodes: DataFrame, wings: DataFrame) -> DataFrame:
    """from_wing, to_wing, name, from_kind, to_kind, from_node and to_node (the first of each side), from_nodes and to_nodes (how many), one
    row for all tunnels between the nodes of a wing, name and kind and those of another: what `tunnels` has a row for each pair of, with a size
    that doesn't grow with the square of a name's nodes.  Members are the nodes of that wing, name and kind."""
    pairs = nodes.sparkSession.createDataFrame(list(TUNNEL_PAIRS), "small_kind string, large_kind string")
    own = members(nodes, wings).filter("name <> ''").groupBy("wing_id", "name", "kind").agg(F.min("node_id").alias("node"), F.count("*").alias("nodes"))
    names = own.groupBy("wing_id").agg(F.countDistinct("name").alias("n"))
    side = lambda p: own.join(names, "wing_id").select("name", *[F.col(c).alias(f"{p}_{c}") for c in ("wing_id", "kind", "node", "nodes", "n")])
    found = side("from").join(side("to"), "name").filter("from_wing_id < to_wing_id")
    small = F.col("from_n") <= F.col("to_n")
    found = found.withColumns({"small_kind": F.when(small, F.col("from_kind")).otherwise(F.col("to_kind")), "large_kind": F.when(small, F.col("to_kind")).otherwise(F.col("from_kind"))})
    kept = found.join(F.broadcast(pairs), ["small_kind", "large_kind"])
    return kept.select(F.col("from_wing_id").alias("from_wing"), F.col("to_wing_id").alias("to_wing"), "name", "from_kind", "to_kind", "from_node", "to_node", "from_nodes", "to_nodes")


def tunnels(nodes: DataFrame, wings: DataFrame) -> DataFrame:
    """from_wing, to_wing, from_node, to_node, reason: nodes of two wings with one name and kinds that fit.  The test of the
    kinds goes from the wing with fewer different names (the first, if equal) to the other."""
    pairs = nodes.sparkSession.createDataFrame(list(TUNNEL_PAIRS), "small_kind string, large_kind string")
    own = members(nodes, wings).filter("name <> ''")
    names = own.groupBy("wing_id").agg(F.countDistinct("name").alias("n"))
    side = lambda p: own.join(F.broadcast(names), "wing_id").select("name", *[F.col(c).alias(f"{p}_{c}") for c in ("wing_id", "node_id", "kind", "n")])
    found = side("a").join(side("b"), "name").filter("a_wing_id < b_wing_id")
    small = F.col("a_n") <= F.col("b_n")
    found = found.withColumns({"small_kind": F.when(small, F.col("a_kind")).otherwise(F.col("b_kind")), "large_kind": F.when(small, F.col("b_kind")).otherwise(F.col("a_kind"))})
    return found.join(F.broadcast(pairs), ["small_kind", "large_kind"]).select(
        F.col("a_wing_id").alias("from_wing"), F.col("b_wing_id").alias("to_wing"), F.col("a_node_id").alias("from_node"), F.col("b_node_id").alias("to_node"), F.concat(F.lit("shared type: "), F.col("name")).alias("reason")
    )


def with_tunnels(g: Graph, found: DataFrame) -> Graph:
    """The graph with a References edge for each tunnel."""
    top = g.edges.agg(F.coalesce(F.max("edge_id"), F.lit(-1))).first()[0]
    new = found.select((F.monotonically_increasing_id() + top + 1).alias("edge_id"), F.col("from_node").alias("src"), F.col("to_node").alias("dst"), F.lit("References").alias("kind"))
    return g.but(edges=g.edges.unionByName(new))


def add_room(rooms: DataFrame, g: Graph, room_id: int, name: str, path: str) -> DataFrame:
    """``rooms`` and a new one that holds the nodes below a path."""
    own = g.nodes.filter(under(F.col("file"), path)).agg(F.array_sort(F.collect_list("node_id")).alias("nodes"))
    return rooms.unionByName(own.select(F.lit(room_id).alias("room_id"), F.lit(name).alias("name"), F.lit(path).alias("path"), "nodes"))
