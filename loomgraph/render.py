"""Reports as text.  The operators' rows are the results; here they only become lines, on the driver, within the limits that the
reports have by definition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.columns import label, loc_display, parts, rel_path
from .model import Graph
from .operators import graph as G
from .operators import lookup, rollup, wings

MODULES, NAMES, SKELETON_BYTES = 12, 5, 50_000

# What the languages' extraction covers (functions, structs, traits, enums, calls, imports).
FEATURES = {
    "Rust": "111111",
    "Python": "110011",
    "TypeScript": "111111",
    "JavaScript": "110011",
    "Go": "111011",
    "C": "110111",
    "C++": "110111",
    "C#": "111111",
    "Kotlin": "111111",
    "Java": "111111",
}


def languages_table() -> str:
    rows = ["| Language | Functions | Structs | Traits | Enums | Calls | Imports |", "|----------|:---------:|:-------:|:------:|:-----:|:-----:|:-------:|"]
    return "\n".join(rows + [f"| {name} | " + " | ".join("✓" if x == "1" else "—" for x in has) + " |" for name, has in FEATURES.items()])


def _some(names: list[str]) -> str:
    return ",".join(names[:NAMES]) + (f"+{len(names) - NAMES}" if len(names) > NAMES else "")


def boot(g: Graph, project: str, facets: list[str]) -> str:
    """Identity and counts, modules, hubs, edges."""
    s = G.stats(g.nodes).withColumn("loc", loc_display(F.col("total_lines"))).first()
    out = [f"{project}|{'+'.join(facets)}|{s.files}f {s.functions}fn {s.structs}st {s.traits}tr {s.enums}en {s.loc}"]
    rows = rollup.modules(g.nodes)
    n = rows.count()
    for m in rows.orderBy("module").limit(MODULES).collect():
        said = []
        if m.traits:
            said.append("trait:" + ",".join(m.traits))
        if m.structs:
            said.append(_some(m.structs))
        if m.enums:
            said.append("en:" + ",".join(m.enums))
        if m.domain:
            said.append(",".join(m.domain[:NAMES]))
        if m.fn_count:
            said.append(f"{m.fn_count}fn" + (f"({m.pub_fn_count}pub)" if 0 < m.pub_fn_count < m.fn_count else ""))
        if m.test_count:
            said.append(f"{m.test_count}tests")
        if said:
            out.append(f"  {m.module}: {' | '.join(said)}")
    if n > MODULES:
        out.append(f"  ...+{n - MODULES} more modules")
    if hubs := G.hubs(g).collect():
        out.append("hubs: " + " ".join(f"{h.tag}:{h.name}({h.degree})" for h in hubs))
    counts = {r.kind: r.n for r in G.edge_counts(g.edges).filter("kind in ('Calls', 'TypeRef')").collect()}
    if counts:
        out.append("edges: " + ", ".join(f"{counts[k]} {name}" for k, name in (("Calls", "calls"), ("TypeRef", "typerefs")) if k in counts))
    return "\n".join(out) + "\n"


def skeleton(g: Graph, path: str | None = None, depth: int = 3) -> str:
    """All symbols by file; ends once it is over its limit.  Rows come one by one, so the limit bounds what is held."""
    out, size, now = [], 0, None
    files = rollup.below(g.nodes, path).select("file").distinct().count()
    for r in rollup.skeleton(g, path).orderBy(parts(F.col("file")), "node_id").toLocalIterator():
        if size > SKELETON_BYTES:
            if r.file != now:
                out.append(f"\n... truncated ({files} files remaining)\n")
                break
            continue
        text = f"── {r.file}\n" if r.file != now else ""
        if depth >= 1:
            text += f"  {r.line}\n" + (f"    calls: [{', '.join(r.calls)}]\n" if r.calls else "")
        now, size = r.file, size + len(text.encode())
        out.append(text)
    return "".join(out)


def compact(g: Graph, path: str | None = None, max_items: int = 500, skip_tests: bool = True) -> str:
    nodes = rollup.below(g.nodes, path).filter("kind <> 'File'")
    rows = rollup.compact(g, path, max_items + 1, skip_tests)
    prefix = rollup.common_prefix(nodes).first().prefix
    out, now = [], None
    for r in rows.withColumn("rel", rel_path(F.col("file"), prefix)).orderBy("position").collect():
        if r.position > max_items:
            out.append(f"  ...+{rollup.below(g.nodes, path).count() - max_items} more")
            break
        if r.file != now:
            out.append(f"─{r.rel}")
            now = r.file
        out.append(f" {r.item}")
    return "\n".join(out) + "\n" if out else ""


def _more(total: int, shown: int) -> list[str]:
    return [f"  ... and {total - shown} more"] if total > shown else []


def _at(r) -> str:
    return f"({r.rel}:{r.start_line})"


def _rel(df: DataFrame, root: str) -> DataFrame:
    return df.withColumn("rel", rel_path(F.col("file"), root))


def references(g: Graph, symbol: str, root: str) -> str:
    rows = _rel(lookup.references(g, symbol), root).orderBy(F.col("ref_kind") != "Definition", "node_id").collect()
    if not rows:
        return f"No references found for '{symbol}'"
    return "\n".join([f"References to '{symbol}' ({len(rows)} found):", *[f"  {r.ref_kind} in {r.name} {_at(r)}" for r in rows]]) + "\n"


def _labelled(df: DataFrame, root: str) -> DataFrame:
    return _rel(df, root).withColumn("label", label(F.col("kind")))


def _list(df: DataFrame, root: str, title: str, symbol: str) -> str:
    rows = _labelled(df, root).orderBy("node_id").collect()
    if not rows:
        return f"No {title.lower()} found for '{symbol}'"
    return "\n".join([f"{title} of '{symbol}' ({len(rows)} found):", *[f"  {r.label} {r.name} {_at(r)}" for r in rows]]) + "\n"


def callers(g: Graph, symbol: str, root: str) -> str:
    return _list(lookup.callers(g, symbol), root, "Callers", symbol)


def implementations(g: Graph, trait: str, root: str) -> str:
    return _list(lookup.implementations(g, trait), root, "Implementations", trait)


def dependencies(g: Graph, symbol: str, root: str, direction: str = "outgoing", max_depth: int = 5) -> str:
    if lookup.primary(g.nodes, symbol).isEmpty():
        return f"Symbol '{symbol}' not found"
    rows = _labelled(lookup.dependencies(g, symbol, direction, max_depth), root).orderBy("depth", "node_id").collect()
    title = "Dependents of" if direction == "incoming" else "Dependencies of"
    return "\n".join([f"{title} '{symbol}' ({len(rows)} found):", *[f"  [depth {r.depth}] {r.label} {r.name} {_at(r)}" for r in rows]]) + "\n"


def impact(g: Graph, symbol: str, root: str, max_depth: int = 10) -> str:
    if lookup.primary(g.nodes, symbol).isEmpty():
        return f"Symbol '{symbol}' not found"
    rows = _rel(lookup.impact(g, symbol, max_depth), root).orderBy("depth", "node_id").collect()
    return "\n".join([f"Impact of changing '{symbol}': {len(rows)} affected symbols", *[f"  [depth {r.depth}] {r.name} {_at(r)}" for r in rows]]) + "\n"


def search(g: Graph, query: str, root: str, signatures: bool = False) -> str:
    found = lookup.search_signatures(g.nodes, query) if signatures else lookup.search(g.nodes, query)
    order = ["start_line", "file", "node_id"] if signatures else ["score", "name", "kind"]
    more = g.nodes.select("node_id", "kind") if signatures else g.nodes.select("node_id", "signature")
    rows = _labelled(F.broadcast(found).join(more, "node_id"), root).orderBy(*order).collect()  # found: a page of the report
    if not rows:
        return f"No {'signatures' if signatures else 'symbols'} matching '{query}'"
    title = "Signatures" if signatures else "Symbols"
    shown = [f"  {r.label} {r.signature or r.name} {_at(r)}" for r in rows]
    return "\n".join([f"{title} matching '{query}' ({rows[0].total} found):", *shown, *_more(rows[0].total, len(rows))]) + "\n"


def symbols(g: Graph, root: str, kind: str = "all", public_only: bool = False) -> str:
    try:
        found = lookup.symbols(g.nodes, kind, public_only)
    except ValueError as e:
        return str(e)
    rows = _rel(F.broadcast(found).join(g.nodes.select("node_id", "visibility"), "node_id"), root).orderBy("label", "shown", "node_id").collect()
    if not rows:
        return f"No {kind} symbols found"
    shown = [f"  {'pub ' if r.visibility == 'Public' else ''}{r.label} {r.shown} {_at(r)}" for r in rows]
    return "\n".join([f"{rows[0].total} {kind} symbols found:", *shown, *_more(rows[0].total, len(rows))]) + "\n"


def summary(g: Graph, path: str, root: str) -> str:
    file = lookup.find_file(g.nodes, path).first()
    if not file:
        return f"File '{path}' not found in index"
    rows = lookup.file_summary(g, path).orderBy("start_line", "node_id").collect()
    head = f"File: {file.file.removeprefix(root.rstrip('/') + '/')}\n"
    if not rows:
        return head + "  (no symbols found)\n"
    out = [f"{len(rows)} symbols:\n"]
    for r in rows:
        out.append(f"  L{r.start_line:<4} {'pub ' if r.visibility == 'Public' else ''}{r.label} {r.shown}")
        if r.calls:
            out.append(f"         → calls: [{', '.join(r.calls)}]")
    return head + "\n".join(out) + "\n"


def source(g: Graph, files: DataFrame, symbol: str, root: str, max_lines: int = 100) -> str:
    named = lookup.by_name(g.nodes, symbol).filter("kind <> 'File'")
    node = lookup.primary(g.nodes, symbol).first() or named.orderBy("node_id").first()
    if not node:
        return f"Symbol '{symbol}' not found"
    rows = lookup.source(g, files, symbol, max_lines).orderBy("line").collect()
    title = named.filter(F.col("node_id") == node.node_id).select(label(F.col("kind")).alias("label"), rel_path(F.col("file"), root).alias("rel")).first()
    out = [f"// {title.label} {node.signature or node.name} ({title.rel}:{node.start_line}–{node.end_line})", *[f"{r.line:>4} | {r.text}" for r in rows]]
    if rows and rows[0].total > len(rows):
        out.append(f"  ... truncated ({rows[0].total - len(rows)} more lines)")
    return "\n".join(out) + "\n"


def tunnels(g: Graph, wing_rows: DataFrame) -> str:
    found = wings.tunnels(g.nodes, wing_rows)
    name = lambda side: F.broadcast(wing_rows.select(F.col("wing_id").alias(f"{side}_wing"), F.col("name").alias(f"{side}_name")))
    own = g.nodes.select(F.col("node_id").alias("from_node"), F.col("name").alias("symbol"))
    rows = found.join(name("from"), "from_wing").join(name("to"), "to_wing").join(own, "from_node").orderBy("from_wing", "to_wing", "from_node", "to_node").collect()
    if not rows:
        return "No cross-project tunnels found."
    return "\n".join([f"Cross-project tunnels ({len(rows)}):", *[f"  {r.from_name} ←→ {r.to_name} [{r.symbol}] ({r.reason})" for r in rows]]) + "\n"


def reindexed(g: Graph, facets: list[str]) -> str:
    s = G.stats(g.nodes).first()
    return f"Re-indexed: {s.files} files, {s.functions} fn, {s.structs} structs, {s.enums} enums, {s.traits} traits | Facets: {'+'.join(facets)}"
