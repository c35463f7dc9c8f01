"""The corpus pipeline: quality, line dedup, near dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and is written as a table before
the next one reads it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import decontam, linededup, packing, quality, simhash
from loomgraph.llm.common import stage
from loomgraph.llm.queries import table, tokenizer


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep(docs, quality.train(docs.select("doc_id", "text")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs are deleted; a document of which nothing is left goes.  n_chars follows the text."""
    found = linededup.dedup_lines(docs).filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    return found.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group stays, linked by SimHash fingerprints as `op4_simhash` links them, and where
    fingerprints tell near copies apart at a similarity of 0.8 of five-word shingles; a document is a doc_id and a text, of rows that repeat both one counts.  Rows without a doc_id can't be told apart by it and stay."""
    found = stage(simhash.near_texts(docs), "groups")
    leads = found.groupBy("component").agg(F.min(F.struct("doc_id", "version")).alias("lead"))
    gone = found.join(leads, "component").filter(F.struct("doc_id", "version") != F.col("lead")).select("doc_id", F.col("version").alias("_version"))
    keyed = docs.withColumn("_version", F.xxhash64("text"))
    left = keyed.join(simhash.broadcast_if(gone), ["doc_id", "_version"], "left_anti")
    if not keyed.filter("doc_id is not null").groupBy("doc_id", "_version").count().filter("count > 1").isEmpty():
        left = left.filter("doc_id is not null").dropDuplicates(["doc_id", "_version"]).unionByName(left.filter("doc_id is null"))
    return left.select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with an item of the benchmark go."""
    found = decontam.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, packed."""
    pieces = packing.pack(docs, tokenizer("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: A trained scorer, a suffix array and a tokenizer have no SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES:
        docs = stage(f(spark, docs, sf_dir), name)
    return docs
