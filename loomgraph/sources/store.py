"""The index on disk: one Parquet table each, below the project's own folder.

A save writes a new generation beside the old one and then names it in a small table, so a reader never sees half of one."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..model import STORE_DIR, Graph

TABLES = ("nodes", "edges", "call_sites", "impl_sites", "name_refs")


def _base(root: str) -> str:
    return f"{root.rstrip('/')}/{STORE_DIR}"


def save(g: Graph, root: str, hashes: DataFrame | None = None, more: dict[str, DataFrame] | None = None) -> None:
    spark, generation = g.nodes.sparkSession, uuid.uuid4().hex
    for name in TABLES:
        if (t := getattr(g, name)) is not None:
            t.write.parquet(f"{_base(root)}/{generation}/{name}")
    if hashes is not None:
        hashes.write.parquet(f"{_base(root)}/{generation}/file_hashes")
    for name, t in (more or {}).items():
        t.write.parquet(f"{_base(root)}/{generation}/{name}")
    spark.createDataFrame([(generation,)], "generation string").coalesce(1).write.mode("overwrite").parquet(f"{_base(root)}/current")


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    try:
        generation = spark.read.parquet(f"{_base(root)}/current").first()[0]
        return spark.read.parquet(f"{_base(root)}/{generation}/{name}")
    except (AnalysisException, TypeError):
        return None


def load(spark: SparkSession, root: str) -> Graph | None:
    """The saved graph; None if there is none, or if it can't be read."""
    found = {name: read_table(spark, root, name) for name in TABLES}
    return Graph(**found) if found["nodes"] is not None and found["edges"] is not None else None


def load_hashes(spark: SparkSession, root: str) -> DataFrame | None:
    return read_table(spark, root, "file_hashes")
