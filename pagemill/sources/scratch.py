"""Tables that cut an iterative plan's lineage."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local master without one gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
    folder = "file://" + tempfile.mkdtemp(prefix="pagemill-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Tables:
    """An iterative plan's tables, written to the shared folder, with no plan behind them; a lost executor costs a re-read.

    Those that a round has replaced are dropped, and the shuffle files of the plans behind them go too. What is left goes
    with the process.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self._at = spark, {}

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{shared_folder(self.spark).rstrip('/')}/rounds-{uuid.uuid4().hex}"
        atexit.register(_remove, self.spark, path)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._at[id(out)] = out, path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _remove(self.spark, self._at.pop(id(t))[1])

    def tidy(self) -> None:
        """Shuffle files go when the driver's JVM finds their plans unused."""
        gc.collect()
        self.spark._jvm.System.gc()
