"""Page lists edited, merged and selected; clauses in force; table grids; dates and reply lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Words that announce a clause number.
CUES = "[Ss]ee|according to|in accordance with|given in|specified in|defined in|as per|refer to|[Cc]lause"
REFERENCE = rf"(?:^|[^A-Za-z])(?:{CUES}) +([0-9]{{1,2}}(?:\.[0-9]{{1,3}}){{0,3}})"


def merge_offsets(files: DataFrame, key: str) -> DataFrame:
    """``(key, ord, n_pages)`` -> where each file's pages start once a set is merged."""
    before = W.partitionBy(key).orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    return files.withColumn("first_page", F.coalesce(F.sum("n_pages").over(before), F.lit(0)))


def delete_pages(pages: DataFrame, gone: Column, key: str = "book") -> DataFrame:
    """The pages left, numbered anew from 0; a book keeps all its pages if none would be left."""
    whole = W.partitionBy(key)
    left = pages.withColumn("_gone", F.coalesce(gone, F.lit(False))).withColumn("_all", F.min("_gone").over(whole)).where("not _gone or _all")
    return left.withColumn("page_no", F.row_number().over(whole.orderBy("page_no")) - 1).drop("_gone", "_all")


def rotate(rotation: Column, by: Column) -> Column:
    return F.pmod(rotation + by, F.lit(4))


def page_set(text: Column, n_pages: Column) -> Column:
    """"3, 7-9; 12" -> sorted distinct pages; null where a part is no range or out of the document."""
    parts = F.transform(F.split(text, "[,;]"), lambda p: F.struct(F.regexp_extract(p, "^ *([0-9]{1,9}) *(?:[-–—] *([0-9]{1,9}) *)?$", 1).alias("a"), F.regexp_extract(p, "^ *([0-9]{1,9}) *[-–—] *([0-9]{1,9}) *$", 2).alias("b")))
    spans = F.transform(parts, lambda p: F.struct(F.try_to_number(p["a"], F.lit("999999999")).cast("int").alias("a"), F.when(p["b"] == "", F.try_to_number(p["a"], F.lit("999999999"))).otherwise(F.try_to_number(p["b"], F.lit("999999999"))).cast("int").alias("b")))
    good = F.forall(spans, lambda p: F.coalesce(p["a"].between(1, n_pages) & p["b"].between(1, n_pages), F.lit(False)))
    return F.when(good, F.array_sort(F.array_distinct(F.flatten(F.transform(spans, lambda p: F.sequence(F.least(p["a"], p["b"]), F.greatest(p["a"], p["b"])))))))


def clause_as_of(pages: DataFrame, clauses: DataFrame) -> DataFrame:
    """Each ``(doc_id, page_no)`` with the number of the last clause at or before it; of one page's the longest."""
    none = F.lit(None).cast("string")
    both = pages.select("doc_id", "page_no", none.alias("number"), F.lit(1).alias("_page")).union(clauses.select("doc_id", "page_no", "number", F.lit(0)))
    order = W.partitionBy("doc_id").orderBy("page_no", "_page", F.length("number"), "number").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("clause", F.last("number", ignorenulls=True).over(order)).where("_page = 1").select("doc_id", "page_no", "clause")


def cited_numbers(text: Column) -> Column:
    """Clause numbers after a cue word; numbers of figures and tables and bare ones are none."""
    return F.regexp_extract_all(text, F.lit(REFERENCE), 1)


def chapter_ranges(clauses: DataFrame, last_page: int) -> DataFrame:
    """First and last page of each clause: up to the next later page of a clause outside it.

    A document's clauses meet in one array, as its contents list would.
    """
    whole = W.partitionBy("doc_id")
    own = clauses.withColumn("_all", F.collect_list(F.struct("number", "page_no")).over(whole))
    outside = F.filter("_all", lambda x: (x["page_no"] > F.col("page_no")) & ~F.startswith(x["number"], F.concat("number", F.lit("."))))
    end = F.coalesce(F.array_min(F.transform(outside, lambda x: x["page_no"])) - 1, F.lit(last_page))
    return own.select("doc_id", "number", F.col("page_no").alias("first_page"), end.alias("last_page"))


def table_grid(glyphs: DataFrame, height: float, row_gap: float = 0.7, min_gap: float = 3.5) -> DataFrame:
    """``(key, ord, x0, x1, y, text)`` -> cells: rows where y falls by more than a share of the height, columns where no glyph spans a gap."""
    w = W.partitionBy("key")
    down = w.orderBy(F.desc("y"), "ord", "text")
    across = w.orderBy("x0", "ord", "text")
    g = glyphs.withColumn("_r", F.coalesce((F.lag("y").over(down) - F.col("y") > row_gap * height).cast("int"), F.lit(0)))
    g = g.withColumn("row", F.sum("_r").over(down.rowsBetween(W.unboundedPreceding, 0)))
    reach = F.max("x1").over(across.rowsBetween(W.unboundedPreceding, -1))
    g = g.withColumn("_c", F.coalesce((F.col("x0") - reach >= min_gap).cast("int"), F.lit(0)))
    g = g.withColumn("col", F.sum("_c").over(across.rowsBetween(W.unboundedPreceding, 0)))
    cell = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), " ")
    return g.groupBy("key", "row", "col").agg(cell.alias("text"))


def parse_date(text: Column) -> Column:
    """``D:YYYYMMDDHHmmSS+HH'mm'`` as UTC; missing parts are the smallest, bad dates null."""
    pattern = "^(?:D:)?([0-9]{4})([0-9]{2})?([0-9]{2})?([0-9]{2})?([0-9]{2})?([0-9]{2})?([+-])?([0-9]{2})?'?([0-9]{2})?'?Z?"

    def part(k: int, least: int, most: int) -> Column:
        return F.least(F.greatest(F.coalesce(F.regexp_extract(text, pattern, k).try_cast("int"), F.lit(least)), F.lit(least)), F.lit(most))

    local = F.try_make_timestamp(F.regexp_extract(text, pattern, 1).try_cast("int"), part(2, 1, 12), part(3, 1, 31), part(4, 0, 23), part(5, 0, 59), part(6, 0, 59).cast("decimal(8,6)"))
    sign = F.when(F.regexp_extract(text, pattern, 7) == "-", 1).otherwise(-1)
    return local + F.make_dt_interval(hours=part(8, 0, 23) * sign, mins=part(9, 0, 59) * sign)


def encode_replies(rows: DataFrame, key: str, order: str) -> DataFrame:
    """``(key, order, author, text)`` -> a JSON list of replies a key, in order."""
    each = F.array_sort(F.collect_list(F.struct(F.col(order).alias("Id"), F.col("text").alias("T"), F.col("author").alias("A"))))
    return rows.groupBy(key).agg(F.to_json(each).alias("replies"))


def decode_replies(rows: DataFrame, key: str) -> DataFrame:
    """The replies again; bad JSON gives none and empty texts are left out."""
    parsed = F.from_json("replies", "array<struct<Id: bigint, T: string, A: string>>")
    return rows.select(key, F.explode(parsed).alias("r")).select(key, F.col("r.Id").alias("id"), F.col("r.T").alias("text"), F.col("r.A").alias("author")).where("trim(text) <> ''")
