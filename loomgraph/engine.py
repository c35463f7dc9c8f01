"""The engine: an index over a project, and its queries as DataFrames (reports: `render`)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import render
from .model import Graph
from .operators import changes, lookup, rollup, wings
from .operators import graph as G
from .plans import build
from .scratch import written
from .sources import detect, files, store


class Engine:
    """A project's graph.  Opening one loads the saved index and brings it up to date, or builds it."""

    def __init__(self, spark: SparkSession, root: str, mode: str = "closed", persist: bool = True) -> None:
        self.spark, self.root, self.mode, self.persist = spark, os.path.abspath(root), mode, persist
        self.facets = self._scan()
        self.wings: DataFrame = spark.createDataFrame([(0, os.path.basename(self.root), self.root)], "wing_id int, name string, root string")
        self._facts = store.read_table(spark, self.root, "facts") if persist else None
        before = store.load_hashes(spark, self.root) if persist else None
        if self._facts is not None and before is not None:
            self.update(before)
        else:
            self._extract(self.facets)

    def _scan(self) -> list[str]:
        """List the tree: names tell the facets, contents are read of known extensions only.  Returns the facets."""
        paths = files.walk(self.root)
        known = (*files.KNOWN_EXTENSIONS, *(ext for a in build.ANALYZERS.values() for ext in a.extensions))
        self.files = files.scan(self.spark, self.root, known, paths=paths)
        listed = self.spark.createDataFrame([(p,) for p in paths], "rel string")
        return [r[0] for r in detect.facets(listed).collect()] or ["unknown"]

    def _extract(self, facets: list[str]) -> Graph:
        self._facts = written(build.extract(self.files, facets), "facts")
        return self._built()

    def reindex(self) -> list[str]:
        """List, extract and resolve everything anew; returns the facets that the tree has now.  `boot` goes on showing those that it
        had when it was opened."""
        facets = self._scan()
        self._extract(facets)
        return facets

    def update(self, before: DataFrame) -> DataFrame:
        """Extract what changed since the hashes ``before`` and resolve everything; returns (path, status)."""
        facts, status = build.incremental(self.spark, before, self._facts, self.files, self.facets)
        self._facts = written(facts, "facts")
        self._built()
        return status

    def _built(self) -> Graph:
        self.graph = build.build(self._facts, self.mode)
        if self.persist:
            self.save()
        return self.graph

    def save(self) -> None:
        store.save(self.graph, self.root, changes.hashes(self.files), {"facts": self._facts})

    # ---- queries -------------------------------------------------------------------------------

    def stats(self) -> DataFrame:
        return G.stats(self.graph.nodes)

    def references(self, symbol: str) -> DataFrame:
        return lookup.references(self.graph, symbol)

    def callers(self, symbol: str) -> DataFrame:
        return lookup.callers(self.graph, symbol)

    def implementations(self, trait: str) -> DataFrame:
        return lookup.implementations(self.graph, trait)

    def dependencies(self, symbol: str, direction: str = "outgoing", max_depth: int = 5) -> DataFrame:
        return lookup.dependencies(self.graph, symbol, direction, max_depth)

    def impact(self, symbol: str, max_depth: int = 10) -> DataFrame:
        return lookup.impact(self.graph, symbol, max_depth)

    def search(self, query: str, signatures: bool = False) -> DataFrame:
        return lookup.search_signatures(self.graph.nodes, query) if signatures else lookup.search(self.graph.nodes, query)

    def symbols(self, kind: str = "all", public_only: bool = False) -> DataFrame:
        return lookup.symbols(self.graph.nodes, kind, public_only)

    def summary(self, path: str) -> DataFrame:
        return lookup.file_summary(self.graph, path)

    def source(self, symbol: str, max_lines: int = 100) -> DataFrame:
        return lookup.source(self.graph, self.files, symbol, max_lines)

    def skeleton(self, path: str | None = None) -> DataFrame:
        return rollup.skeleton(self.graph, self._below(path))

    def compact(self, path: str | None = None, max_items: int = 500, skip_tests: bool = True) -> DataFrame:
        return rollup.compact(self.graph, self._below(path), max_items, skip_tests)

    def tunnels(self) -> DataFrame:
        return wings.tunnels(self.graph.nodes, self.wings)

    def add_wing(self, name: str, root: str) -> None:
        n = self.wings.count()
        self.wings = self.wings.union(self.spark.createDataFrame([(n, name, root)], "wing_id int, name string, root string"))

    def merge_wing(self, other: Engine) -> None:
        """Take another project's graph over as a wing of this one."""
        self.graph = G.merge(self.graph, other.graph)
        self.add_wing(os.path.basename(other.root), other.root)

    # ---- reports -------------------------------------------------------------------------------

    def boot(self) -> str:
        return render.boot(self.graph, os.path.basename(self.root), self.facets)

    def report(self, name: str, *args: object, **options: object) -> str:
        """A report by name, as the tools of `server` show it."""
        if name == "boot":
            return self.boot()
        if name == "reindex":
            facets = self.reindex()
            return render.reindexed(self.graph, facets)
        if name == "skeleton":
            return render.skeleton(self.graph, self._below(args[0] if args else None), **options)
        if name == "compact":
            return render.compact(self.graph, self._below(args[0] if args else None), **options)
        makers = {"references": render.references, "callers": render.callers, "implementations": render.implementations, "dependencies": render.dependencies, "impact": render.impact, "search": render.search, "summary": render.summary}
        if name == "symbols":
            return render.symbols(self.graph, self.root, *args, **options)
        if name == "source":
            return render.source(self.graph, self.files, args[0], self.root, *args[1:], **options)
        if name == "tunnels":
            return render.tunnels(self.graph, self.wings)
        return makers[name](self.graph, args[0], self.root, *args[1:], **options)

    def _below(self, path: str | None) -> str | None:
        return None if path is None else os.path.join(self.root, path)


def languages(spark: SparkSession) -> DataFrame:
    """language and what its extraction covers."""
    rows = [(name, *[x == "1" for x in has]) for name, has in render.FEATURES.items()]
    return spark.createDataFrame(rows, "language string, functions boolean, structs boolean, traits boolean, enums boolean, calls boolean, imports boolean").withColumn("covered", sum(F.col(c).cast("int") for c in ("functions", "structs", "traits", "enums", "calls", "imports")))
