"""Streams whose results are stored: restarts, batches that come again, catalogs; addresses in texts."""

import pytest
from pyspark.sql import functions as F

from pagemill.operators import addresses as ad
from pagemill.plans.queries import QUERIES
from pagemill.streaming import progress as pr

TEXTS = "doc_id bigint, source string, text string"


def files(spark, folder, *parts):
    for rows in parts:
        spark.createDataFrame(rows, TEXTS).coalesce(1).write.mode("append").parquet(folder)


def texts(spark, folder):
    return spark.readStream.schema(TEXTS).option("maxFilesPerTrigger", 1).parquet(folder)


def test_totals_go_on_after_a_failure(spark, tmp_path):
    source, folder = str(tmp_path / "in"), f"file://{tmp_path}/out"
    files(spark, source, [(1, "a", "of the of the")], [(2, "a", None), (3, "b", "Of  The")])
    put, failed = pr.store_batches, []

    def make(batch):
        if not failed and batch.count() == 2:
            # The batch's rows are on disk, but the stream dies before it notes that.
            batch.write.mode("overwrite").parquet(f"{folder}/rows/batch=1")
            failed.append(1)
            raise RuntimeError("killed")
        return batch

    with pytest.raises(Exception, match="killed"):
        put(texts(spark, source), folder, make)
    assert put(texts(spark, source), folder, make).count() == 3
    files(spark, source, [(4, "b", "none")])
    assert put(texts(spark, source), folder, make).count() == 4
    totals = pr.stored_totals(texts(spark, source), "of the", f"file://{tmp_path}/totals", "source")
    assert sorted(map(tuple, totals.collect())) == [("a", 2, 1, 2), ("b", 2, 1, 1)]
    hits = pr.stored_hits(texts(spark, source), "of the", f"file://{tmp_path}/hits")
    assert sorted((r.doc_id, r.char_start) for r in hits.collect()) == [(1, 0), (1, 7), (3, 0)]


def test_catalog(spark, tmp_path):
    source, folder, schema = str(tmp_path / "in"), f"file://{tmp_path}/out", "path string, seen int, hash string"

    def arrive(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        now, changes = pr.scan_catalog(spark.readStream.schema(schema).parquet(source), folder)
        return sorted((r.path, r.hash) for r in now.collect()), sorted((r.path, r.change) for r in changes.collect())

    assert arrive(("a", 1, "x"), ("b", 1, "y"), ("b", 2, "z"), (None, 1, "n")) == ([("a", "x"), ("b", "z")], [("a", "new"), ("b", "new")])
    first = [("a", "new"), ("b", "new")]
    # An older sighting changes nothing, nor does an equal one.
    assert arrive(("a", 0, "old"), ("b", 3, "z")) == ([("a", "x"), ("b", "z")], first)
    assert arrive(("a", 4, None), ("b", 4, "w"), ("c", 4, "c"), ("d", 4, None)) == ([("b", "w"), ("c", "c")], sorted([*first, ("a", "removed"), ("b", "changed"), ("c", "new")]))
    assert arrive(("a", 5, "x"))[1].count(("a", "new")) == 2


def test_catalog_without_arrivals(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = spark.readStream.schema("path string, seen int, hash string").parquet(str(tmp_path / "in"))
    assert pr.scan_catalog(rows, f"file://{tmp_path}/out") == (None, None)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("see http://a.org/x_(y)). Next", ["http://a.org/x_(y)"]),
        ("(HTTPS://a.org/?q=1&r=[2]), end", ["HTTPS://a.org/?q=1&r=[2]"]),
        ("www.a.org, xwww.b.org", ["http://www.a.org"]),
        ("<ftp://h/z>; 'http://b'", ["ftp://h/z", "http://b"]),
        ("write to a.b+c@d-e.co.uk. Or mailto:x@y.de!", ["mailto:a.b+c@d-e.co.uk", "mailto:x@y.de"]),
        ("x@y http:// www. @a.de", []),
        ("http://é.org/ü…", ["http://é.org/ü"]),
        ("a" * 70 + "@b.de", []),
    ],
)
def test_addresses(spark, text, want):
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id bigint, text string")
    got = ad.find_addresses(df).orderBy("ord").collect()
    assert [r.target for r in got] == want
    assert all(r.target.endswith(text[r.char_start : r.char_start + r.length]) for r in got)


def test_an_address_over_two_lines_has_two_rectangles(spark):
    found = spark.createDataFrame([(1, 0, 8, 4, "http://x")], "doc_id bigint, ord int, char_start int, length int, target string")
    chars = spark.createDataFrame([(1, k, 10.0 * (k % 10), 20.0 * (k // 10), 10.0 * (k % 10) + 10, 20.0 * (k // 10) + 10) for k in range(30)], "doc_id bigint, seq int, x0 double, y0 double, x1 double, y1 double")
    got = ad.address_rects(found, chars).orderBy("rect").collect()
    assert [(r.x0, r.x1) for r in got] == [(80.0, 100.0), (0.0, 20.0)]


def test_rectangles_of_texts_set_by_a_rule(spark):
    rows = [(d, "".join("x" * (7 * d + k) + f" see http://a.org/{'y' * 9 * k} " for k in range(5))) for d in range(6)]
    found = ad.find_addresses(spark.createDataFrame(rows, "doc_id bigint, text string"))
    # Every 50th character has no width.
    box = {"x0": "10.0D * (seq % 30)", "y0": "20.0D * (seq div 30)", "x1": "10.0D * (seq % 30) + if(seq % 50 = 0, 0, 10)", "y1": "20.0D * (seq div 30) + 10"}
    chars = spark.range(6).selectExpr("id AS doc_id", "explode(sequence(0, 400)) AS seq").selectExpr("doc_id", "seq", *(f"{e} AS {c}" for c, e in box.items()))
    rule = lambda k: F.struct((10.0 * (k % 30)).alias("x0"), (20.0 * F.floor(k / 30)).alias("y0"), (10.0 * (k % 30) + F.when(k % 50 == 0, 0).otherwise(10)).alias("x1"), (20.0 * F.floor(k / 30) + 10).alias("y1"))
    names = ["doc_id", "ord", "rect", "target", "x0", "y0", "x1", "y1"]
    get = lambda c: sorted(map(tuple, ad.address_rects(found, c).select(names).collect()))
    assert get(rule) == get(chars)
    # The query makes no row a character, so nothing is exchanged.
    assert "Exchange" not in QUERIES["address_rects"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
