"""Change detection by content hash, and what an incremental index does with it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hashes(files: DataFrame) -> DataFrame:
    """path, hash of (path, content)."""
    return files.select("path", F.md5(F.coalesce("content", F.lit("")).cast("binary")).alias("hash"))


def diff(before: DataFrame, now: DataFrame) -> DataFrame:
    """path, status: New, Modified, Unchanged or Deleted, of two tables (path, hash)."""
    joined = before.select("path", F.col("hash").alias("old")).join(now.select("path", F.col("hash").alias("new")), "path", "full_outer")
    status = F.when(F.col("old").isNull(), "New").when(F.col("new").isNull(), "Deleted").when(F.col("old") == F.col("new"), "Unchanged").otherwise("Modified")
    return joined.select("path", status.alias("status"))


def upsert(before: DataFrame, changed: DataFrame, deleted: DataFrame) -> DataFrame:
    """``before`` (path, hash) after the changed rows (path, hash) and without the deleted paths."""
    gone = changed.select("path").union(deleted.select("path")).distinct()
    return before.join(gone, "path", "left_anti").unionByName(changed.select("path", "hash"))
