import importlib
import sys

from pyspark.sql import functions as F

from loomgraph.model import TUNNEL_PAIRS
from loomgraph.plans import derived
from loomgraph.operators import wings
from loomgraph.plans.queries import QUERIES, _regions
from loomgraph.streaming import feed


def test_sql_belongs_to_queries():
    import __spark_entry__ as entry

    assert entry.oracle_sql().keys() <= entry.queries().keys() and len(entry.queries()) >= 50


def test_rest_works_without_the_training_data_part(monkeypatch):
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("loomgraph.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    entry = importlib.reload(importlib.import_module("__spark_entry__"))
    assert "impact" in entry.queries() and "pipeline" not in entry.queries() and not any(q.startswith("op") for q in entry.queries())
    monkeypatch.undo()
    importlib.reload(entry)


def test_change_feed(spark, tmp_path):
    rows = [("/a", True, 0), ("/a", False, 100), ("/a", True, 600), ("/b/target/x", True, 0), ("/c", True, 400), ("/c", True, 450)]
    events = spark.createDataFrame(rows, "path string, exists boolean, ms long").select("path", "exists", F.timestamp_millis("ms").alias("ts"))
    want = [("/a", "Changed", 600), ("/a", "Removed", 100), ("/c", "Changed", 450)]
    told = lambda df: sorted((r.path, r.change, r.ms) for r in df.withColumn("ms", F.unix_millis("ts")).collect())
    assert told(feed.debounced(events)) == want
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert told(feed.run_available(stream, str(tmp_path / "out"), str(tmp_path / "state"))) == want


def test_tunnels_over_all_nodes(spark):
    """Brute force over each node of the smallest tables."""
    sf = "/root/testdata/sf0.001"
    g = derived.graph(spark, sf)
    nodes = [r for r in g.nodes.select("node_id", "kind", "name", "file").collect()]
    roots = {r.file: r.node_id // 8 for r in nodes if r.kind == "Module"}
    own = [(roots[root], r) for r in nodes for root in roots if r.file == root or r.file.startswith(f"{root}/")]
    names = {w: len({r.name for x, r in own if x == w}) for w in roots.values()}
    want = set()
    for v, a in own:
        for w, b in own:
            if v < w and a.name == b.name:
                pair = (a.kind, b.kind) if names[v] <= names[w] else (b.kind, a.kind)
                if pair in TUNNEL_PAIRS:
                    want.add((v, w, a.node_id, b.node_id))
    got = [(r.from_wing, r.to_wing, r.from_node, r.to_node) for r in wings.tunnels(g.nodes, _regions(g)).collect()]
    assert set(got) == want and len(got) == len(want) and {n % 5 for _, _, x, _ in got for n in [x // 8]} == set(range(5))
    classes = QUERIES["tunnels"](spark, sf).collect()
    assert sum(r.from_nodes * r.to_nodes for r in classes) == len(want) and {(r.from_wing, r.to_wing, r.from_node, r.to_node) for r in classes} <= want


def test_resolution_over_all_parts(spark):
    """Brute force with each part of the smallest tables as a target."""
    sf = "/root/testdata/sf0.001"
    parts = derived.table(spark, sf, "part").select("p_partkey", "p_name", "p_size").collect()
    kind = lambda key: "Trait" if key % 3 == 0 else "Struct" if key % 3 == 1 else "Function"
    called = {p.p_partkey * 8 + 4: "nobody" if p.p_size % 5 == 0 else p.p_name if p.p_size % 5 == 1 else p.p_name.split(" ")[0] + " widget" for p in parts}
    have = lambda name, *kinds: [p.p_partkey * 8 + 4 for p in parts if p.p_name == name and (not kinds or kind(p.p_partkey) in kinds)]
    closed, strict, impls, refs = set(), set(), set(), set()
    for src, name in called.items():
        every = have(name)
        closed |= {(src, d) for d in every if d != src}
        strict |= {(src, d) for d in ([d for d in every if d <= src] or every) if d != src}
        impls |= {(src, d, src % 3) for d in sorted(have(name, "Trait"))[:1]}
        refs |= {(src, d, "References") for d in every} if src % 16 == 4 else {(src, d, "TypeRef") for d in sorted(have(name, "Struct"))[:1]}
    for query, want in {"resolve_calls_closed": closed, "resolve_calls_strict": strict, "resolve_impls": impls, "resolve_refs": refs}.items():
        got = [tuple(r) for r in QUERIES[query](spark, sf).collect()]
        assert set(got) == want and len(got) == len(want) > 0
