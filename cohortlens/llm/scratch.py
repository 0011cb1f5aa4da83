"""Intermediate tables in the cluster's shared folder, and session settings.

Lineage is cut by writing Parquet under ``spark.checkpoint.dir``, which every
executor can read, so a lost executor costs a re-read and not a re-run.  Only
where that setting is absent *and* Spark runs in one process (tests) is a
temporary folder set.
"""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows, and bytes, handed to a Python worker at once; a text that is longer comes alone.
ARROW_ROWS, ARROW_BYTES = 512, 16 << 20


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches, as one row may hold a long text; workers can import this package.

    These are settings of the session and stay: Spark reads them when a plan runs, which
    may be long after an operator returned it.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of batches that hands memory back when it is done: workers live on, and the next stage needs it."""

    def outer(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            hand_back()

    return outer


def hand_back() -> None:
    """Freed memory goes back to the system: Arrow's, and what the C library keeps of numpy's and Python's, where it can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # other C libraries have no such call
        pass


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="cohortlens-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


class Scratch:
    """Tables written by one operator call; ``drop`` removes those no longer read.

    A returned DataFrame may still read the rest: ``released`` removes what was written
    inside it, and what is left goes when the application ends with its session running.
    """

    known: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        Scratch.known.append(self)

    def table(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write and read back: the same rows, without lineage."""
        self.count += 1
        path = f"{self.base}/{self.count:02d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        self._delete([t._scratch_path for t in tables])

    def release(self) -> None:
        """Remove all tables of this call."""
        self._delete([self.base])
        Scratch.known.remove(self)

    def _delete(self, paths: list[str]) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for p in paths:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)


@contextmanager
def released():
    """Scratch tables of operators called inside are removed at the end: what reads them has to be written by then."""
    before = len(Scratch.known)
    try:
        yield
    finally:
        for s in Scratch.known[before:]:
            s.release()


@atexit.register
def _release_all() -> None:
    for s in list(Scratch.known):
        if SparkContext._active_spark_context is s.spark.sparkContext:
            s.release()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def below(probes: list[int], col: Column) -> Column:
    """How many of the ascending probes are <= the column: a search tree of CASE expressions."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(col >= F.lit(probes[mid]).cast("long"), tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(probes))
