"""Files of a folder as rows: a bad one is a row with an error, and the rest goes on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def text_files(spark: SparkSession, folder: str, pattern: str = "*.txt", recursive: bool = False) -> DataFrame:
    """``(path, text, hash, error)`` of the files; pages are parted by form feeds in the text.

    Bytes that are no UTF-8 give an error and no text. Spark's reader passes over files without bytes.
    """
    read = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return decoded(read.select("path", "content"))


def decoded(files: DataFrame) -> DataFrame:
    """The same of ``(path, content)`` rows, whatever they were read from; no content is an error too."""
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    error = F.when(F.col("content").isNull() | (F.length("content") == 0), "empty").when(text.isNull(), "not UTF-8")
    return files.select("path", F.when(error.isNull(), text).alias("text"), F.upper(F.sha2("content", 256)).alias("hash"), error.alias("error"))


def file_pages(files: DataFrame) -> DataFrame:
    """Pages ``(path, page_no, text)`` of the files without an error."""
    return files.where("error is null").select("path", F.posexplode(F.split("text", "\f", -1)).alias("page_no", "text"))
