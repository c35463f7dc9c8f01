"""From files to a graph: extract, number, resolve."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..extract import code, text, yamls
from ..functions.columns import parts, rel_path
from ..model import Graph
from ..operators import changes
from ..operators.graph import ids
from ..operators.resolve import resolve_calls, resolve_impls, resolve_refs
from ..scratch import written
from ..sources.files import code_files, format_files

KEY = ["analyzer", "path", "ordinal"]


@dataclass(frozen=True)
class Analyzer:
    """A source of facts.  ``extract`` turns files (path, rel, ext, bytes, content) into rows of `FACTS` whose ``analyzer`` is ``name``;
    ``facets`` are those that ask for it (None: any); one that is ``whole`` takes a project's files together, so an incremental build
    runs it over all of them; ``extensions`` are read beside the known ones."""

    name: str
    facets: tuple[str, ...] | None
    extract: Callable[[DataFrame], DataFrame]
    whole: bool = False
    extensions: tuple[str, ...] = ()

    def handles(self, facets: list[str]) -> bool:
        return self.facets is None or bool(set(self.facets) & set(facets))


def _schema(files: DataFrame) -> DataFrame:
    own = format_files(files, "schema")
    return text.sql(own.filter("ext = 'sql'")).unionByName(text.proto(own.filter("ext = 'proto'"))).unionByName(yamls.openapi_files(own))


#: All analyzers by name, in the order in which their nodes are numbered.
ANALYZERS: dict[str, Analyzer] = {}


def add_analyzer(analyzer: Analyzer) -> None:
    """Make ``analyzer`` known to every build from now on; one of the same name is replaced."""
    ANALYZERS[analyzer.name] = analyzer


for _a in (
    Analyzer("code", ("rust", "python", "typescript", "javascript", "go", "c", "cpp", "kotlin", "java", "csharp"), lambda files: code.code(code_files(files))),
    Analyzer("ansible", ("ansible",), lambda files: yamls.ansible_project(files.select(F.col("rel").alias("path"), "content")), whole=True),
    Analyzer("terraform", ("terraform",), lambda files: text.terraform(format_files(files, "terraform"))),
    Analyzer("docs", ("markdown",), lambda files: text.markdown(format_files(files, "docs"))),
    Analyzer("schema", None, _schema),
):
    add_analyzer(_a)


def extract(files: DataFrame, facets: list[str], only: Callable[[Analyzer], bool] = lambda a: True) -> DataFrame:
    """Facts of ``files`` by each analyzer that a facet asks for."""
    found = [a.extract(files) for a in ANALYZERS.values() if a.handles(facets) and only(a)]
    return reduce(DataFrame.unionByName, found) if found else files.sparkSession.createDataFrame([], text.FACTS)


def numbered(facts: DataFrame) -> DataFrame:
    """Symbols with node_id: by analyzer, path components, and place in the file."""
    order = F.array_position(F.array(*[F.lit(a) for a in ANALYZERS]), F.col("analyzer"))
    return ids(facts.filter("kind is not null").withColumns({"_a": order, "_p": parts(F.col("path"))}), ["_a", "_p"], ["ordinal"], "node_id").drop("_a", "_p")


def build(facts: DataFrame, mode: str = "closed") -> Graph:
    """The graph of extracted facts, names resolved."""
    facts = written(facts, "facts")
    found = written(numbered(facts), "symbols")
    nodes = found.select("node_id", "kind", "name", "file", "start_line", "end_line", "start_col", "end_col", "signature", "visibility", "analyzer")
    at = found.select("node_id", *KEY)
    refs = facts.filter("edge_kind is not null").join(at, KEY).select(F.col("node_id").alias("src"), "edge_kind", "ref_name", "target_kinds", "seq")
    calls = refs.filter("edge_kind = 'Calls'").select(F.col("src").alias("caller_id"), F.col("ref_name").alias("callee_name")).distinct()
    impls = refs.filter("edge_kind = 'Implements'").select(F.col("src").alias("impl_id"), F.col("ref_name").alias("trait_name"), "seq")
    names = refs.filter("edge_kind not in ('Calls', 'Implements')").select("src", "ref_name", "edge_kind", "target_kinds")
    up = at.select("analyzer", F.col("path").alias("parent_path"), F.col("ordinal").alias("parent"), F.col("node_id").alias("src"))
    contains = found.join(up, ["analyzer", "parent_path", "parent"]).select("src", F.col("node_id").alias("dst"))
    g = Graph(nodes, contains, *[written(t, "sites") for t in (calls, impls, names)])
    return resolve(g, contains, mode)


def resolve(g: Graph, contains: DataFrame, mode: str = "closed") -> Graph:
    """``g`` with all edges made anew: containment and whatever its sites resolve to."""
    lit = lambda t, kind: t.select("src", "dst", F.lit(kind).alias("kind"))
    every = lit(contains, "Contains").union(lit(resolve_calls(g.call_sites, g.nodes, mode), "Calls"))
    every = every.union(lit(resolve_impls(g.impl_sites, g.nodes, mode, g.call_sites), "Implements"))
    every = every.union(resolve_refs(g.name_refs, g.nodes, mode).select("src", "dst", "kind"))
    return g.but(edges=written(ids(every, ["src"], ["kind", "dst"], "edge_id").select("edge_id", "src", "dst", "kind"), "edges"))


def incremental(spark: SparkSession, before: DataFrame, facts: DataFrame, files: DataFrame, facets: list[str]) -> tuple[DataFrame, DataFrame]:
    """(facts, status) after ``files`` replaced those with the hashes ``before`` (path, hash) and the ``facts``: only new and
    modified files are extracted.  Building from these facts equals building from all files, because sites are facts too and names
    are resolved over all of them.  Analyzers of whole projects (Ansible's) take all files together again."""
    status = written(changes.diff(before, changes.hashes(files)), "status")
    touched = status.filter("status in ('New', 'Modified')").select("path")
    stale = status.filter("status <> 'Unchanged'").select("path")
    again = files.join(touched, "path", "left_semi")
    whole = [a.name for a in ANALYZERS.values() if a.whole]
    kept = facts.filter(~F.col("analyzer").isin(*whole)).join(stale, "path", "left_anti").select(*facts.columns)
    fresh = extract(again, facets, lambda a: not a.whole).unionByName(extract(files, facets, lambda a: a.whole))
    return kept.unionByName(fresh), status


def relative(nodes: DataFrame, root: str) -> DataFrame:
    return nodes.withColumn("rel", rel_path(F.col("file"), root))
