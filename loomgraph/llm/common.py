"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches are cut to about this many bytes of text before Python objects are made of them.
SLICE_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none and all runs on one machine (tests, a laptop) a temporary folder is set.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the lineage, and
    what was written survives the loss of any executor."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that `stage` wrote and of which no plan reads any more."""
    for table in tables:
        sc = table.sparkSession.sparkContext
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = sc._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def fold_of(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about SLICE_BYTES (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = max(1, batch.column(batch.schema.get_field_index(text)).nbytes)
        step = max(1, min(n, n * SLICE_BYTES // size))
        for at in range(0, n, step):
            yield batch.slice(at, step)
    trim()


def trim() -> None:
    """Give what a task has freed back to the system: a worker lives on after its task, beside others."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # another C library keeps it
        ctypes.CDLL(None).malloc_trim(0)


def records(schema: pa.Schema, columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class Numbered(dict):
    """word -> the number of its row in ``table``.  Rows of new words are made many at a time: look the words up, then
    `settle` before reading the table; call `room` before a batch, so that what a worker remembers stays bounded."""

    def __init__(self, width: int, dtype: type, most: int) -> None:
        self.new: list[str] = []
        self.most, self.table = most, np.zeros((1024, width), dtype)

    def __missing__(self, word: str) -> int:
        k = self[word] = len(self)
        self.new.append(word)
        return k

    def rows(self, words: list[str]) -> np.ndarray:
        raise NotImplementedError

    def room(self) -> None:
        if len(self) > self.most:
            self.clear()

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def settle(self) -> None:
        if self.new:
            if len(self) > len(self.table):
                grown = np.zeros((2 * len(self), self.table.shape[1]), self.table.dtype)
                grown[: len(self.table)] = self.table
                self.table = grown
            self.table[len(self) - len(self.new) : len(self)] = self.rows(self.new)
            self.new = []
