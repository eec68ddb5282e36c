"""Session helpers shared by the operators: scratch tables and small utilities."""

from __future__ import annotations

import atexit
import ctypes
import gc
import sys
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MADE: dict[str, SparkSession] = {}
_RECORDS: ContextVar[tuple[list[str], ...]] = ContextVar("records", default=())


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where the setting is absent a local folder is made, but only for a
    single-machine master: on a cluster executors could not see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="pagemill-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _remove_all() -> None:
    for path, spark in _MADE.items():
        sc = spark.sparkContext
        if sc._jsc is None:
            continue
        jpath = sc._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(sc._jsc.hadoopConfiguration()).delete(jpath, True)
    _MADE.clear()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts lineage: a lost executor costs a re-read, never a recomputation
    of everything before. The table goes when the session's process ends.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/pagemill-{uuid.uuid4().hex}-{name}"
    if not _MADE:
        atexit.register(_remove_all)
    _MADE[path] = spark
    for record in _RECORDS.get():
        record.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def recorded(into: list[str]) -> Iterator[None]:
    """Adds to ``into`` the tables that this thread makes meanwhile and that outlive their operator."""
    before = _RECORDS.get()
    _RECORDS.set((*before, into))
    try:
        yield
    finally:
        _RECORDS.set(before)


def tables_of(df: DataFrame) -> set[str]:
    """Names of the operators' tables that a plan reads, from its relations' folders; no file is listed."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    found = set()
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            roots = leaf.relation().location().rootPaths()
            found |= {roots.apply(j).getName() for j in range(roots.size())}
    return found


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Removes tables that nothing needs any more; those of other runs and operators stay."""
    sc = spark.sparkContext
    while paths:
        path = paths.pop()
        jpath = sc._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(sc._jsc.hadoopConfiguration()).delete(jpath, True)
        _MADE.pop(path, None)


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


class Scratch:
    """Tables that an operator needs while it runs; ``with`` removes them at its end.

    What outlives it goes through :func:`materialize`, so no returned plan reads a table
    that is gone. Until then rows go to Python ``BATCH`` at a time, which bounds what a
    worker and its executor hold of them.
    """

    BATCH = 1_000
    _lock = threading.Lock()
    #: Per session: how many are open, and the setting before the first of them.
    _open: dict[int, tuple[int, str]] = {}

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        with self._lock:
            n, before = self._open.get(id(self.spark), (0, self.spark.conf.get(ARROW_ROWS)))
            self._open[id(self.spark)] = (n + 1, before)
            if not n:
                self.spark.conf.set(ARROW_ROWS, str(min(self.BATCH, int(before)) if int(before) > 0 else self.BATCH))
        return self

    def table(self, df: DataFrame, name: str) -> DataFrame:
        made: list[str] = []
        with recorded(made):
            out = materialize(df, name)
        self.paths += made
        return out

    def tidy(self) -> None:
        """Shuffle files go when the driver's JVM finds their plans unused."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def __exit__(self, *_) -> None:
        with self._lock:
            n, before = self._open.pop(id(self.spark))
            if n > 1:
                self._open[id(self.spark)] = (n - 1, before)
            else:
                self.spark.conf.set(ARROW_ROWS, before)
        remove(self.spark, self.paths)
        self.tidy()


def tidy(rows):
    """``rows`` for ``mapInArrow``, giving freed memory back to the system at the task's end:
    workers are used again, and what one operator had is not needed by the next."""

    def run(batches):
        try:
            yield from rows(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                ctypes.CDLL(None).malloc_trim(0)

    return run


def named(column: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def keyed(docs: DataFrame, name: str) -> DataFrame:
    """``(key, row)``: each row, as a struct, with a number of its own, written so that it stays the same.

    In the struct no column of ``docs`` can clash with one that an operator adds.
    """
    return materialize(docs.select(F.monotonically_increasing_id().alias("key"), F.struct(*map(named, docs.columns)).alias("row")), name)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also inside other lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
