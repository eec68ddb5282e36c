"""Clause trees kept by content, so that a text is scanned once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .analysis import clauses

ENTRY = "hash string, version int, payload string"
CLAUSES = "clauses array<struct<ord: int, number: string, title: string, page_no: int, parent: string, level: int>>"
#: To be raised whenever the scan gives other trees; older entries then count as never scanned.
VERSION = 1


def read_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Stored entries; a folder that is not there yet, and files that can't be read, hold none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).option("ignoreCorruptFiles", "true").parquet(folder)


def usable(entries: DataFrame, version: int = VERSION) -> DataFrame:
    """``(hash, clauses)`` of entries of this version whose payload can be read and has clauses, one a hash."""
    read = entries.where(F.col("version") == version).select("hash", F.from_json("payload", CLAUSES)["clauses"].alias("clauses"))
    return read.where(F.size("clauses") > 0).groupBy("hash").agg(F.max("clauses").alias("clauses"))


def new_entries(docs: DataFrame, entries: DataFrame, to_lines: Callable[[DataFrame], DataFrame], version: int = VERSION) -> DataFrame:
    """Entries of the texts ``(doc_id, text)`` that have no usable one: each text is scanned once, whatever its copies.

    ``to_lines`` turns ``(doc_id, text)`` into lines ``(doc_id, page_no, line_no, text)``. Texts without clauses give no
    entry; null texts are not scanned.
    """
    texts = docs.where("text is not null").select(F.sha2("text", 256).alias("doc_id"), "text")
    known = usable(entries, version).select(F.col("hash").alias("doc_id"))
    missed = texts.join(known, "doc_id", "left_anti").groupBy("doc_id").agg(F.first("text").alias("text"))
    tree = clauses(to_lines(missed)).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "number", "title", "page_no", "parent", "level"))).alias("clauses"))
    return tree.select(F.col("doc_id").alias("hash"), F.lit(version).alias("version"), F.to_json(F.struct("clauses")).alias("payload"))


def cached_clauses(docs: DataFrame, folder: str, to_lines: Callable[[DataFrame], DataFrame], version: int = VERSION) -> DataFrame:
    """Clauses ``(doc_id, cached, ord, number, title, page_no, parent, level)`` of all texts ``(doc_id, text)``; what had to be
    scanned for them is added to ``folder``. ``cached`` tells what had not.

    Two runs at once may both add a text's entry: either serves. Hot texts meet their entry by a hash join whose large
    side Spark may split; entries are one row a text.
    """
    spark = docs.sparkSession
    before = read_entries(spark, folder)
    # The entries so far are a fixed list of files: what is added below is not among them.
    had = usable(before, version).select("hash", F.lit(True).alias("cached"))
    new_entries(docs, before, to_lines, version).write.mode("append").parquet(folder)
    now = usable(read_entries(spark, folder), version).join(had, "hash", "left")
    own = docs.select("doc_id", F.sha2("text", 256).alias("hash")).join(now, "hash")
    return own.select("doc_id", F.coalesce("cached", F.lit(False)).alias("cached"), F.inline("clauses"))
