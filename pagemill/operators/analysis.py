"""Searches, repeated lines, clauses, references, page sets and measures over page tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lines as ln
from ..functions.text import has_leader, heading_depth, normalise


def repeated_lines(pages: DataFrame, share: float, least: int = 3, group: str = "book") -> DataFrame:
    """Normalised lines on so large a share of a book's pages with text, of which there are four or more; each line counts once a page."""
    return _repeated(pages, share, least, group, F.col("line"), "line")


def repeated_digests(pages: DataFrame, share: float, least: int = 3, group: str = "book") -> DataFrame:
    """:func:`repeated_lines` by their lines' MD5, in 16 bytes, so that no line is shuffled."""
    return _repeated(pages, share, least, group, F.unhex(F.md5("line")), "digest")


def _repeated(pages: DataFrame, share: float, least: int, group: str, key: Column, name: str) -> DataFrame:
    of = pages.where(normalise(F.col("text")) != "").groupBy(group).agg(F.count(F.lit(1)).alias("n_pages")).where("n_pages >= 4")
    each = pages.select(group, "page_no", F.explode(F.split("text", "\n", -1)).alias("line")).withColumn("line", normalise(F.col("line"))).where("line <> ''")
    counted = each.select(group, "page_no", key.alias(name)).groupBy(group, name).agg(F.countDistinct("page_no").alias("on_pages")).where(F.col("on_pages") >= least)
    # One row a book; Spark broadcasts it only below its own size threshold.
    return counted.join(of, group).where(F.col("on_pages") >= F.greatest(F.lit(least), F.ceil(F.col("n_pages") * share))).select(group, name, "on_pages", "n_pages")


def clause_lines(lines: DataFrame) -> DataFrame:
    """Lines ``(doc_id, page_no, line_no, text)`` that head a clause, with number and title.

    Contents pages (five leaders or more) and crowded pages (over twelve headings) give none.
    """
    at = W.partitionBy("doc_id", "page_no")
    text = F.col("text")
    annex = F.regexp_extract(text, ln.ANNEX, 1)
    dotted = F.regexp_extract(text, ln.ANNEX_CLAUSE, 1)
    plain = F.regexp_extract(text, ln.NUMBERED, 1)
    letter = F.when(annex != "", F.replace(annex, F.lit("."), F.lit(""))).when(dotted != "", F.regexp_replace(dotted, r"^N\.A\.", "NA."))
    number = F.coalesce(letter, F.when((plain != "") & (F.split(plain, r"\.")[0].try_cast("int") <= 30), plain))
    title = F.when(annex != "", "").when(dotted != "", F.trim(F.regexp_extract(text, ln.ANNEX_CLAUSE, 2))).otherwise(F.trim(F.regexp_extract(text, ln.NUMBERED, 2)))
    t = lines.withColumns({"leaders": F.count_if(has_leader(text)).over(at), "number": number, "title": title})
    t = t.where(F.col("number").isNotNull() & (F.col("leaders") < 5) & ln.has_heading_length(text) & ~ln.is_noise(text))
    title = F.col("title")
    t = t.where(((title == "") | ~ln.is_sentence_like(title)) & (F.col("number").rlike("[.A-Z]") | ln.is_chapter_title(title)))
    return t.withColumn("on_page", F.count(F.lit(1)).over(at)).where("on_page <= 12").select("doc_id", "page_no", "line_no", "number", "title")


def clauses(lines: DataFrame) -> DataFrame:
    """The clause tree of :func:`clause_lines`: each number's first sighting, whatever its case, with parent, level and order.

    Missing ancestors are made up without a title at their first descendant's page; one that is
    sighted later gets its own title and page only if that is the page after at the latest.
    """
    place = F.struct("page_no", "line_no")
    heads = clause_lines(lines).withColumn("upper", F.upper("number"))
    first = heads.groupBy("doc_id", "upper").agg(F.min_by(F.struct("number", "title", "page_no", place.alias("place")), place).alias("own"))
    parts = F.split("upper", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "."))
    above = first.where(F.size(parts) > 1).select("doc_id", "own.place", F.explode(prefixes).alias("upper"))
    made = above.groupBy("doc_id", "upper").agg(F.min("place").alias("child"))
    both = first.join(made, ["doc_id", "upper"], "full_outer")
    late = F.col("own").isNull() | (F.col("child") < F.col("own.place")) & ((F.col("own.page_no") > F.col("child.page_no") + 1) | (F.col("own.title") == ""))
    late = F.coalesce(late, F.lit(False))
    number = F.coalesce("own.number", "upper")
    depth = heading_depth(F.col("number"))
    segments = F.transform(F.split("number", r"\."), lambda x: F.when(x.rlike("^[0-9]+$"), F.concat(F.lit("0"), F.lpad(x, 5, "0"))).otherwise(F.concat(F.lit("1"), x)))
    out = both.select("doc_id", number.alias("number"), F.when(late, "").otherwise(F.col("own.title")).alias("title"), F.when(late, F.col("child.page_no")).otherwise(F.col("own.page_no")).alias("page_no"))
    out = out.select("*", F.when(depth > 1, F.regexp_replace("number", r"\.[0-9]+$", "")).alias("parent"), depth.alias("level"))
    return out.withColumn("ord", F.row_number().over(W.partitionBy("doc_id").orderBy(F.array_join(segments, "."))) - 1)


def resolve_references(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """Each ``(doc_id, ref_id, number)`` to the page of its longest prefix among its document's ``(doc_id, number, page_no)``."""
    parts = F.split("number", r"\.")
    tried = refs.select("doc_id", "ref_id", "number", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "."))).alias("depth", "prefix"))
    hit = tried.join(targets.select("doc_id", F.col("number").alias("prefix"), "page_no"), ["doc_id", "prefix"])
    best = hit.groupBy("doc_id", "ref_id", "number").agg(F.max_by(F.struct("prefix", "page_no"), "depth").alias("t"))
    return best.select("ref_id", "number", F.col("t.prefix").alias("target"), F.col("t.page_no").alias("page_no"))


def page_ranges(pages: DataFrame, key: str, page: str) -> DataFrame:
    """Distinct pages of a key as "1,3-5"."""
    d = pages.select(key, page).distinct()
    d = d.withColumn("island", F.col(page) - F.row_number().over(W.partitionBy(key).orderBy(page)))
    runs = d.groupBy(key, "island").agg(F.min(page).alias("a"), F.max(page).alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    return runs.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", text.alias("r")))), lambda x: x["r"]), ",").alias("ranges"))


def polyline_measures(points: DataFrame) -> DataFrame:
    """``(key, ord, x, y)`` -> length, closed perimeter and shoelace area of each polyline of two points or more."""
    w = W.partitionBy("key").orderBy("ord")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    p = points.withColumns({"nx": F.lead("x").over(w), "ny": F.lead("y").over(w), "fx": F.first("x").over(whole), "fy": F.first("y").over(whole)})
    cx, cy = F.coalesce("nx", "fx"), F.coalesce("ny", "fy")
    step = F.sqrt((cx - F.col("x")) ** 2 + (cy - F.col("y")) ** 2)
    out = p.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("nx").isNotNull(), step).otherwise(0.0)).alias("length"), F.sum(step).alias("perimeter"), F.abs(F.sum(F.col("x") * cy - cx * F.col("y")) / 2).alias("area"))
    return out.where("n >= 2").select("key", "n", *[F.round(c, 4).alias(c) for c in ("length", "perimeter", "area")])


def caption_anchors(points: DataFrame) -> DataFrame:
    """``(key, kind, ord, x, y)`` -> where each measurement's caption stands: a Distance's middle, a Perimeter's last point, an
    Area's centroid (the mean of its points if it has no area or fewer than three), the mean of all others' points."""
    w = W.partitionBy("key").orderBy("ord")
    p = points.withColumns({"nx": F.lead("x").over(w), "ny": F.lead("y").over(w), "i": F.row_number().over(w)})
    ends = p.groupBy("key").agg(F.min_by("x", "i").alias("fx"), F.min_by("y", "i").alias("fy"))
    p = p.join(ends, "key").withColumns({"nx": F.coalesce("nx", "fx"), "ny": F.coalesce("ny", "fy")})
    cross = F.col("x") * F.col("ny") - F.col("nx") * F.col("y")
    early = F.col("i") <= 2
    middle = [F.avg(F.when(early, F.col(c))).alias(f"m{c}") for c in "xy"]
    moments = [F.sum((F.col(c) + F.col(f"n{c}")) * cross).alias(f"s{c}") for c in "xy"]
    out = p.groupBy("key", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(cross).alias("a"), *moments, *middle, *(F.avg(c).alias(f"v{c}") for c in "xy"), *(F.max_by(c, "i").alias(f"l{c}") for c in "xy"))
    n, solid = F.col("n"), (F.col("kind") == "Area") & (F.col("n") >= 3) & (F.abs("a") > 1e-9)
    at = lambda c: F.when((F.col("kind") == "Distance") & (n >= 2), F.col(f"m{c}")).when(F.col("kind") == "Perimeter", F.col(f"l{c}")).when(solid, F.col(f"s{c}") / (3 * F.col("a"))).otherwise(F.col(f"v{c}"))
    return out.select("key", at("x").alias("x"), at("y").alias("y"))


def latest(rows: DataFrame, key: str, order: str, tie: str) -> DataFrame:
    """The newest row of each key; of equal ones the first."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.desc_nulls_last(order), tie))).where("_n = 1").drop("_n")


def thread_counts(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(F.count_if(F.col("turn") > 0).alias("replies"), F.min_by("role", "turn").alias("opened_by"), F.countDistinct("role").alias("authors"))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    return docs.groupBy(F.upper(F.sha2("text", 256)).alias("sha256")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


def catalog_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """New, changed and removed paths between two ``(path, hash)`` snapshots."""
    o, n = old.select("path", F.col("hash").alias("was")), new.select("path", F.col("hash").alias("is"))
    kind = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "removed").when(F.col("was") != F.col("is"), "changed")
    return o.join(n, "path", "full_outer").select("path", kind.alias("change")).where("change is not null")
