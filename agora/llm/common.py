"""Helpers that the operators of this subpackage share: tables, scratch space, columns."""

from __future__ import annotations

import atexit
import ctypes
import functools
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.written import shared_folder

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables written to the shared folder to cut lineage.

    ``keep(df)`` writes and rereads a table; ``drop()`` removes what has been
    written so far, apart from tables passed to ``keep(..., last=True)``, which a
    lazy result may still read: they go when the Python process ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, str] = {}

    def keep(self, df: DataFrame, last: bool = False) -> DataFrame:
        path = f"{shared_folder(self.spark)}/agora-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        if last:
            _AT_END.append((self.spark, path))
        out = self.spark.read.schema(df.schema).parquet(path)
        if not last:
            self.paths[id(out)] = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for key in [id(f) for f in frames] or list(self.paths):
            if path := self.paths.pop(key, None):
                _delete(self.spark, path)


_PER_WORKER: list[dict] = []


def per_worker() -> dict:
    """A table that a Python worker keeps from task to task, until a task of another operator begins in it."""
    _PER_WORKER.append({})
    return _PER_WORKER[-1]


def forget() -> None:
    """Empties those tables: workers are reused, and what one stage has kept is of no use to the next."""
    for kept in _PER_WORKER:
        kept.clear()


def trimmed(run):
    """A function over Arrow batches that gives freed memory back to the system when its task ends: workers outlive
    tasks, and idle ones would hold it beside the busy ones."""

    @functools.wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return whole


def trim() -> None:
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not this C library
        return


_AT_END: list[tuple[SparkSession, str]] = []


def _clean() -> None:
    for spark, path in _AT_END:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended; the folder's owner removes what is left
            return


atexit.register(_clean)


def only(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The named columns alone, so that further input columns can't clash with derived ones."""
    return df.select(*[F.col(f"`{c}`") for c in columns])
