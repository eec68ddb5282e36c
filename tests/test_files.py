"""HTML documents piece by piece; clause trees kept by content."""

import duckdb
from pyspark.sql import functions as F

from pagemill.operators import clause_cache as cc
from pagemill.operators import html_documents as ht
from pagemill.plans.queries import ORACLES, QUERIES
from pagemill.sources.tables import lines


def test_html_bodies(spark):
    items = spark.createDataFrame(
        [(1, 0, 0, "6.4 Loads & more", True, None), (1, 0, 2, "NOTE 1 a<b", False, []), (1, 1, 0, "6.4 Again", True, None), (1, 1, 1, "NOTES", False, ["unmapped"]), (1, 1, 2, " ", False, None), (1, 1, 3, None, True, None), (1, 3, 0, "Annex B", True, None), (2, 0, 0, "x", None, None)],
        "doc_id long, page_no int, ord int, text string, is_heading boolean, issues array<string>",
    )
    regions = spark.createDataFrame([(1, 0, 1, "equation", "(6.4)", None, "a = b"), (1, 3, 1, "table", "Table 1", "Table 1 - X", None)], "doc_id long, page_no int, ord int, kind string, label string, caption string, text string")
    labels = spark.createDataFrame([(1, 0, "ii")], "doc_id long, page_no int, label string")
    one, two = ht.html_bodies(items, regions, labels).orderBy("doc_id").collect()
    assert one.contents.split("\n") == ['<li class="l3"><a href="#sec-6.4">6.4 Loads &amp; more</a></li>', '<li class="l3"><a href="#sec-6.4-2">6.4 Again</a></li>', '<li class="l2"><a href="#sec-B">Annex B</a></li>']
    body = one.body
    assert [body.index(x) for x in ("p. ii", 'id="sec-6.4"', 'id="eq-6.4"', '<p class="note">NOTE 1 a&lt;b</p>', 'id="page-2"', 'id="sec-6.4-2"', '<p class="suspect" title="unmapped">NOTES</p>', 'id="page-4"', 'id="table-1"')] == sorted(
        body.index(x) for x in ("p. ii", 'id="sec-6.4"', 'id="eq-6.4"', '<p class="note">', 'id="page-2"', 'id="sec-6.4-2"', '<p class="suspect"', 'id="page-4"', 'id="table-1"')
    )
    assert 'id="page-3"' not in body and "<pre>a = b</pre>" in body and body.count("<pre>") == 1
    assert (two.contents, two.body) == ("", '<div class="page" id="page-1" data-page="1"><span>p. 1</span></div>\n<p>x</p>')
    assert ht.html_bodies(items.limit(0)).count() == 0
    whole = spark.range(1).select(ht.html_file(F.lit("a<b"), F.lit(""), F.lit("x")).alias("h")).first().h
    assert "<title>a&lt;b</title>" in whole and "<nav>" not in whole


def test_clause_cache(spark, tmp_path):
    folder, scanned = str(tmp_path / "cache"), []

    def to_lines(docs):
        scanned.append(sorted(r.text for r in docs.collect()))
        return lines(docs).selectExpr("doc_id", "0 as page_no", "line_no", "text")

    docs = spark.createDataFrame([(1, "1.1 Scope\n1.2 Terms"), (2, "1.1 Scope\n1.2 Terms"), (3, "no clause"), (4, None), (5, "2.1 Loads")], "doc_id long, text string")
    run = lambda: sorted((r.doc_id, r.cached, r.number, r.title) for r in cc.cached_clauses(docs, folder, to_lines).collect())
    tree = [(d, n, t) for d in (1, 2) for n, t in (("1", ""), ("1.1", "Scope"), ("1.2", "Terms"))] + [(5, "2", ""), (5, "2.1", "Loads")]
    assert run() == [(d, False, n, t) for d, n, t in tree]
    assert scanned.pop() == ["1.1 Scope\n1.2 Terms", "2.1 Loads", "no clause"]
    assert run() == [(d, True, n, t) for d, n, t in tree]
    # Texts without clauses have no entry, so they are scanned again.
    assert scanned.pop() == ["no clause"]
    # A file that is none, entries of another version and broken payloads count as never scanned.
    broken = str(tmp_path / "broken")
    old = cc.read_entries(spark, folder)
    old.selectExpr("hash", "0 as version", "payload").union(old.selectExpr("hash", "1 as version", "left(payload, 20)")).union(old.selectExpr("hash", "1", "'{}'")).write.parquet(broken)
    (tmp_path / "broken" / "part-x.parquet").write_bytes(b"no parquet")
    folder = broken
    assert run() == [(d, False, n, t) for d, n, t in tree]
    assert run() == [(d, True, n, t) for d, n, t in tree]


def test_customers_with_the_same_orders(spark, tmp_path):
    # Orders 63 apart give the same lines; customers 6 and 12 have usable entries, the others none.
    orders = [(k + 63 * n, c, "F") for n, c in enumerate((6, 7, 8, 10, 12, 13)) for k in (1, 2)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    got = sorted((r.doc_id, r.cached, r.numbers) for r in QUERIES["clause_cache"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    assert got == sorted(con.execute(ORACLES["clause_cache"]).fetchall())
    assert [r[:2] for r in got] == [(c, c % 6 == 0) for c in (6, 7, 8, 10, 12, 13)]
