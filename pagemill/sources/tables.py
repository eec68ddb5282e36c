"""Tables of pages and lines, read or derived; and sinks with exact bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arriving(spark: SparkSession, sf_dir: str, name: str, schema: str) -> DataFrame:
    """The table as a stream of its files, whether it is one file or a folder of them (a pattern stands for both)."""
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


#: Ids that are numbered together, so that one source may hold any share of the rows.
RANGE = 1 << 17


def book_pages(documents: DataFrame) -> DataFrame:
    """A book for each source; its pages in order of doc_id, from 0.

    Rows are numbered within ranges of ids, and the ranges' counts, a small table, are added up.
    """
    part = F.floor(F.col("doc_id") / RANGE)
    before = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    counts = documents.groupBy("source", part.alias("part")).agg(F.count(F.lit(1)).alias("k")).select("source", "part", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(W.partitionBy("source", "part").orderBy("doc_id")) - 1
    numbered = documents.select("source", part.alias("part"), "doc_id", "text").withColumn("place", place)
    return numbered.join(counts, ["source", "part"]).select(F.col("source").alias("book"), (F.col("before") + F.col("place")).cast("int").alias("page_no"), "doc_id", "text")


def lines(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text"))


def links(pages: DataFrame) -> DataFrame:
    """Addresses of a page's links, in order."""
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)
    return pages.select("page_id", F.posexplode(found).alias("ord", "target"))


def to_jsonl(df: DataFrame) -> DataFrame:
    """One JSON object a row, ready for ``write.text``."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def csv_cell(cell: Column) -> Column:
    """A cell of comma-separated values, quoted where it has to be."""
    return F.when(cell.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(cell)


def tsv_cell(cell: Column) -> Column:
    return F.regexp_replace(cell, "\r\n|[\t\r\n]", " ")
