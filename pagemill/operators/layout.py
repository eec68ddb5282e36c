"""What stands where: coordinates, runs, columns, points and glyphs; outlines kept and pages compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def distinct_coordinates(rows: DataFrame, key: str, value: str, gap: float = 2.0) -> DataFrame:
    """A key's coordinates in order, without those within ``gap`` of the last one kept. A page's are one array."""
    each = F.array_sort(F.collect_list(value))

    def keep(kept: Column, x: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        return F.when(last.isNull() | (x - last > gap), F.concat(kept, F.array(x))).otherwise(kept)

    listed = rows.groupBy(key).agg(each.alias("all"))
    return listed.select(key, F.posexplode(F.aggregate("all", F.filter("all", lambda _: F.lit(False)), keep)).alias("ord", "at"))


def text_runs(glyphs: DataFrame, height: float, share: float = 0.6) -> DataFrame:
    """Glyphs ``(key, row, x0, x1)`` of a row -> runs: a new one where the left edge lies a share of the height past all before."""
    order = W.partitionBy("key", "row").orderBy("x0", "x1")
    reach = F.max("x1").over(order.rowsBetween(W.unboundedPreceding, -1))
    g = glyphs.withColumn("_s", F.coalesce((F.col("x0") > reach + share * height).cast("int"), F.lit(0)))
    g = g.withColumn("run", F.sum("_s").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return g.groupBy("key", "row", "run").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.count(F.lit(1)).alias("n"))


def text_column(lines: DataFrame, key: str = "key") -> DataFrame:
    """Lines ``(x0, x1)`` -> the text column's edges: a tenth of left edges lie before it, a tenth of right edges past it; and the upper median width."""
    left, right, wide = (F.array_sort(F.collect_list(c)) for c in (F.col("x0"), F.col("x1"), F.col("x1") - F.col("x0")))
    got = lines.groupBy(key).agg(left.alias("l"), right.alias("r"), wide.alias("w"))
    n = F.size("l")
    return got.select(key, F.get("l", F.floor(n / 10).cast("int")).alias("x0"), F.get("r", F.least(n - 1, F.floor(n * 9 / 10).cast("int"))).alias("x1"), F.get("w", F.floor(n / 2).cast("int")).alias("median_width"))


def nearest_boxes(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Each ``(key, pid, x, y)`` to the first box ``(key, ord, x0, y0, x1, y1)`` that holds it, else to that of the nearest centre."""
    b = boxes.where("x1 > x0 and y1 > y0")
    inside = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    far = (F.col("x") - (F.col("x0") + F.col("x1")) / 2) ** 2 + (F.col("y") - (F.col("y0") + F.col("y1")) / 2) ** 2
    rank = F.struct((~inside).alias("out"), F.when(inside, 0.0).otherwise(far).alias("far"), "ord")
    return points.join(b, "key").groupBy("key", "pid").agg(F.min(rank).alias("r")).select("key", "pid", F.col("r.ord").alias("ord"), (~F.col("r.out")).alias("inside"))


def retarget(outline: DataFrame, kept: DataFrame) -> DataFrame:
    """``(doc_id, node, path, title, page_no)`` for the pages ``(doc_id, page_no, new_page)`` that stay.

    ``path`` lists a node's ancestors from the root; children of a dropped node move to the
    nearest ancestor that stays, or to the root (null).
    """
    left = outline.join(kept.select("doc_id", "page_no", "new_page"), ["doc_id", "page_no"])
    above = left.select("doc_id", "node", F.posexplode("path").alias("depth", "up"))
    stays = left.select(F.col("doc_id").alias("_d"), F.col("node").alias("_n"))
    parent = above.join(stays, (F.col("doc_id") == F.col("_d")) & (F.col("up") == F.col("_n"))).groupBy("doc_id", "node").agg(F.max_by("up", "depth").alias("parent"))
    return left.join(parent, ["doc_id", "node"], "left").select("doc_id", "node", "title", "new_page", "parent")


def page_diff(old: DataFrame, new: DataFrame, key: str = "book") -> DataFrame:
    """Pages ``(key, page_no, text)`` of two revisions -> those added, removed or changed, by place; texts meet as digests."""

    def digests(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, "page_no", F.sha2(F.coalesce("text", F.lit("")), 256).alias(name))

    kind = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("was") != F.col("is"), "changed")
    return digests(old, "was").join(digests(new, "is"), [key, "page_no"], "full_outer").select(key, "page_no", kind.alias("change")).where("change is not null")


def effective_scale(pages: DataFrame, own: DataFrame, documents: DataFrame, default: float = 1.0) -> DataFrame:
    """A page's scale: its own, else its document's, else the default."""
    a = own.select("doc_id", "page_no", F.col("scale").alias("_p"))
    b = documents.select("doc_id", F.col("scale").alias("_d"))
    return pages.select("doc_id", "page_no").join(a, ["doc_id", "page_no"], "left").join(b, "doc_id", "left").select("doc_id", "page_no", F.coalesce("_p", "_d", F.lit(default)).alias("scale"))


def recent(rows: DataFrame, key: str, path: str, at: str, most: int = 12) -> DataFrame:
    """A key's last ``most`` paths (the size of the list is the feature), newest first; case tells none apart."""
    low = F.lower(path)
    newest = rows.groupBy(key, low.alias("_low")).agg(F.max(F.struct(at, path)).alias("r"))
    n = F.row_number().over(W.partitionBy(key).orderBy(F.desc(f"r.{at}"), "_low"))
    return newest.withColumn("ord", n).where(F.col("ord") <= most).select(key, "ord", F.col(f"r.{path}").alias(path))


def visiting_order(pages: DataFrame, start: Column, key: str = "book") -> DataFrame:
    """The order in which pages are visited from ``start`` to the end and then from the first."""
    n = F.count(F.lit(1)).over(W.partitionBy(key))
    return pages.withColumn("visit", F.pmod(F.col("page_no") - start, n))


def running_totals(files: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Files, hits and files with hits so far, in a given order of completion."""
    so_far = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return files.withColumns({"files_done": F.count(F.lit(1)).over(so_far), "hits_done": F.sum("hits").over(so_far), "with_hits": F.count_if(F.col("hits") > 0).over(so_far)})


def sibling_key(number: Column) -> Column:
    """A sort key of clause numbers: numbers by value before letters, at every level."""
    return F.transform(F.split(number, r"\."), lambda s: F.struct(s.try_cast("int").isNull().alias("word"), F.coalesce(s.try_cast("int"), F.lit(0)).alias("n"), s.alias("text")))
