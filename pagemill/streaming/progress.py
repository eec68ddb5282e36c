"""Searches over a stream of files."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.phrases import find_phrases, phrase_count
from ..sources.scratch import shared_folder


def stream_search(spark: SparkSession, folder: str, schema: str, term: str) -> DataFrame:
    """Hits of a phrase in Parquet files as they arrive; stateless, append mode."""
    return find_phrases(spark.readStream.schema(schema).parquet(folder), term)


def stream_totals(spark: SparkSession, folder: str, schema: str, term: str, files_a_batch: int = 1) -> DataFrame:
    """Running totals of rows searched and of rows with the phrase; one row of state."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)
    return rows.agg(F.count(F.lit(1)).alias("searched"), F.count_if(F.contains(F.lower("text"), F.lit(term.lower()))).alias("with_hits"))


def progressive_search(spark: SparkSession, folder: str, schema: str, term: str, on_hits: Callable[[DataFrame, int], None], checkpoint: str, every: str = "120 milliseconds", **options: bool) -> StreamingQuery:
    """Every hit is passed on once, a batch at a time, as files arrive.

    ``on_hits`` gets a batch and its number; after a failure a batch may come again under the same number.
    """
    hits = find_phrases(spark.readStream.schema(schema).parquet(folder), term, **options)
    return hits.writeStream.foreachBatch(on_hits).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def stream_folder(spark: SparkSession) -> str:
    """A new folder, shared by all executors, for one stream's results and progress."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def store_batches(rows: DataFrame, folder: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All that has arrived since the last call, one file of ``make``'s rows a batch; returns what is stored by now.

    Progress is kept in ``folder``, so that a call after a failure goes on where the last one stopped; a batch that comes
    again replaces its own rows under its number, and none counts twice.
    """

    def put(batch: DataFrame, n: int) -> None:
        make(batch).write.mode("overwrite").parquet(f"{folder}/rows/batch={n}")

    rows.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    return rows.sparkSession.read.parquet(f"{folder}/rows")


def stored_hits(rows: DataFrame, term: str, folder: str) -> DataFrame:
    """Hits of a phrase in a stream of texts so far, each stored once as its file arrives, with the batch that brought it."""
    return store_batches(find_phrases(rows, term), folder, lambda b: b)


def stored_totals(rows: DataFrame, term: str, folder: str, group: str) -> DataFrame:
    """``(group, searched, with_hits, hits)`` of a stream of texts so far: a batch stores one row a group, totals add them up."""
    n = F.col("_n")
    counts = [F.count(F.lit(1)).alias("searched"), F.count_if(n > 0).alias("with_hits"), F.sum(n.cast("bigint")).alias("hits")]
    each = store_batches(rows.select(group, phrase_count(F.col("text"), term).alias("_n")), folder, lambda b: b.groupBy(group).agg(*counts))
    return each.groupBy(group).agg(*[F.sum(c).alias(c) for c in ("searched", "with_hits", "hits")])


def scan_catalog(sightings: DataFrame, folder: str) -> tuple[DataFrame | None, DataFrame | None]:
    """A stream of sightings ``(path, seen, hash)``, a null hash for a path found gone -> the catalog by now and all changes.

    Of each path the sighting with the greatest ``seen`` counts, whatever the order of arrival. A batch meets the catalog
    that the batch before it left, writes its own beside that, and stores what is new, changed or removed; a batch that
    comes again reads and writes the same versions. Without any arrival yet both are None.
    """
    spark = sightings.sparkSession

    def put(batch: DataFrame, n: int) -> None:
        last = batch.where("path is not null").groupBy("path").agg(F.max(F.struct("seen", "hash")).alias("s")).select("path", "s.*")
        if n:
            old = spark.read.parquet(f"{folder}/catalog/version={n - 1}").select("path", F.col("seen").alias("_seen"), F.col("hash").alias("_hash"))
        else:
            old = last.limit(0).select("path", F.col("seen").alias("_seen"), F.col("hash").alias("_hash"))
        both = last.join(old, "path", "full_outer")
        newer = F.col("seen").isNotNull() & (F.col("_seen").isNull() | (F.col("seen") > F.col("_seen")))
        now = both.select("path", newer.alias("_newer"), "_hash", F.when(newer, F.col("seen")).otherwise(F.col("_seen")).alias("seen"), F.when(newer, F.col("hash")).otherwise(F.col("_hash")).alias("hash"))
        now.select("path", "seen", "hash").write.mode("overwrite").parquet(f"{folder}/catalog/version={n}")
        kind = F.when(F.col("_hash").isNull() & F.col("hash").isNotNull(), "new").when(F.col("_hash").isNotNull() & F.col("hash").isNull(), "removed").when(F.col("_hash") != F.col("hash"), "changed")
        now.where("_newer").select("path", kind.alias("change")).where("change is not null").write.mode("overwrite").parquet(f"{folder}/changes/batch={n}")

    query = sightings.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    versions = _numbers(spark, f"{folder}/catalog")
    if not versions:
        return None, None
    return spark.read.parquet(f"{folder}/catalog/version={max(versions)}").where("hash is not null"), spark.read.parquet(f"{folder}/changes")


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the finished versions in a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath() for s in fs.listStatus(path)]
    return [int(p.getName().split("=")[1]) for p in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
