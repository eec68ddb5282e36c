"""Glyphs, equations, wrapping, references and places on small inputs."""

import pytest
from pyspark.sql import functions as F

from pagemill.functions import names as na
from pagemill.functions import wrapping as wr
from pagemill.operators import glyphs as gl
from pagemill.operators import layout as la
from pagemill.operators import markup as mu
from pagemill.operators import places as pl
from pagemill.operators import references as re


def drawn(text, y=700.0, x=0.0):
    return [(ord(c), (x + 6 * k, y, x + 6 * k + 5, y + 8)) for k, c in enumerate(text)]


@pytest.mark.parametrize(
    ("units", "text", "dropped"),
    [
        (drawn("abc") + drawn("abc"), "abc", 3),
        ([(102, (0, 0, 5, 8)), (102, (0, 0, 5, 8))], "ff", 0),
        ([(102, (0, 0, 5, 8))] * 3, "ff", 1),
        ([(0xD835, (0, 0, 5, 8)), (0xDC00, (0, 0, 5, 8))], "A", 0),
        ([(0xD835, (0, 0, 5, 8))], "�", 0),
        ([(0x239B, (0, 20, 5, 30)), (0x239C, (0, 10, 5, 20)), (0x239D, (0, 0, 5, 10))], "(", 0),
        ([(97, (0, 0, 5, 8)), (2, (6, 3, 9, 4)), (98, (10, 0, 15, 8))], "a-b", 0),
        ([(97, (0, 0, 5, 8)), (2, (6, 0, 9, 8)), (98, (10, 0, 15, 8))], "a�b", 0),
        ([(0xF8E8, (0, 0, 5, 8)), (0x2011, (6, 0, 9, 8))], "®-", 0),
        ([], "", 0),
    ],
)
def test_glyphs(units, text, dropped):
    lines, n = gl.repair(units)
    assert ("\n".join(x.text for x in lines), n) == (text, dropped)


def test_equations():
    lines, _ = gl.repair(drawn("some words come before this") + [(10, (0, 0, 0, 0))] + drawn("a = b + c", 600) + drawn("(6.12a)", 600, 400) + [(10, (0, 0, 0, 0))] + drawn("(7.1)", 500, 400) + [(10, (0, 0, 0, 0))] + drawn("see (6.3)", 400))
    assert gl.equations(lines, 600) == [("(6.12a)", "a = b + c", False)]


def test_empty_glyphs(spark):
    none = spark.createDataFrame([], "doc_id bigint, page_no bigint, idx int, unit int, x0 double, y0 double, x1 double, y1 double")
    assert gl.repaired_lines(none).count() == 0 == gl.page_equations(none, 600).count()


def test_wrapping():
    text = "one two three\n\n" + "W" * 40 + " end"
    lines = wr.wrap(text, 60, 10)
    assert all(wr.width(x) * 10 / 1000 <= 60 for x in lines) and "" in lines
    assert "".join(lines).replace(" ", "") == text.replace("\n", "").replace(" ", "")
    assert wr.wrap(None, 60, 10) == [""] == wr.wrap("", 60, 10)
    assert wr.wrap("WW", 1, 10) == ["W", "W"]
    assert wr.fitted_size(["a"], 200, 10) == pytest.approx((5.56 * 1.06 + 6, 1.4 * 12.5 + 6))


def test_references(spark):
    text = "see 8.3.1 and Annex N.A., Figure 8.5see 6.2 Table 9.9\nClause 7.1 (2)"
    pages = spark.createDataFrame([(1, 5, text), (1, 6, None), (1, 7, "")], "doc_id bigint, page_no int, text string")
    targets = spark.createDataFrame([(1, "8.3", 40), (1, "na", 60), (1, "figure 8.5s", 70), (1, "6", 71), (1, "7.1", 5)], "doc_id bigint, key string, page_no int")
    got = {(r.label, r.target) for r in re.cross_references(pages, targets).collect()}
    # "Figure 8.5s" overlaps "see 6.2", which comes first in order of kind; 7.1 stands on its own page.
    assert got == {("Clause 8.3.1", 40), ("Annex NA", 60), ("Clause 6.2", 71)}
    assert re.cross_references(pages.limit(0), targets).count() == 0


def test_annexes(spark):
    rows = [(1, 3, 0, "Annex N.A."), (1, 4, 0, "ZA.1.2 Title  here"), (1, 5, 0, "Annex NA"), (1, 6, 0, "Annex A is long"), (1, 7, 0, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, page_no int, line_no int, text string")
    assert sorted(map(tuple, re.annex_headings(df).collect())) == [(1, "NA", "", 3), (1, "ZA.1.2", "Title here", 4)]


def test_a_crossing_comes_before_a_midpoint(spark):
    segments = spark.createDataFrame([(1, 1, 0.0, 0.0, 100.0, 100.0), (1, 2, 0.0, 80.0, 80.0, 0.0), (1, 3, 0.0, 200.0, 100.0, 200.0)], "key int, sid int, x0 double, y0 double, x1 double, y1 double")
    assert [tuple(r) for r in pl.crossings(segments, 8.0).collect()] == [(1, 1, 2, 40.0, 40.0)]
    points = spark.createDataFrame([(1, 1, 43.0, 43.0), (1, 2, 50.0, 201.0), (1, 3, 20.0, 202.0), (1, 4, 2.0, 1.0), (1, 5, 500.0, 500.0)], "key int, pid int, x double, y double")
    assert {r.pid: r.kind for r in pl.snap(points, segments, 10.0).collect()} == {1: 1, 2: 2, 3: 3, 4: 0}


def test_coordinates_are_kept_by_the_last_one_kept(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (0, 1.5, 3, 4.5, 3)], "key string, at double")
    assert [tuple(r) for r in la.distinct_coordinates(df, "key", "at").collect()] == [("a", 0, 0.0), ("a", 1, 3.0)]


def test_siblings_sort_by_value(spark):
    df = spark.createDataFrame([(x,) for x in ("10", "2", "A", "2.10", "2.9", "1")], "n string")
    assert [r.n for r in df.orderBy(la.sibling_key(F.col("n"))).collect()] == ["1", "2", "2.9", "2.10", "10", "A"]


def test_titles(spark):
    cases = [("Microsoft Word - My book.docx", None, None, "My book"), ("untitled", "Run. ", "/a/b.pdf", "Run"), (None, None, "/a/b.c.pdf", "b.c"), (" ", None, None, "Untitled"), ("x.pdf", None, None, "Untitled")]
    df = spark.createDataFrame([(*c[:3], c[3]) for c in cases], "m string, r string, p string, want string")
    for r in df.withColumn("got", na.document_title(F.col("m"), F.col("r"), F.col("p"))).collect():
        assert r.got == r.want


def test_flattened_tables(spark):
    run = " ".join(str(k) for k in range(12))
    cases = [(f"Table 1.1 and Table 2.3a {run}", "Table 2.3a"), (f"{run} as in Table 4", "Table 4"), (run, "unnamed table"), (run[:-3], None), (None, None)]
    df = spark.createDataFrame(cases, "t string, want string")
    for r in df.withColumn("got", na.flattened_table(F.col("t"))).collect():
        assert r.got == r.want


def test_annotation_texts(spark):
    row = spark.createDataFrame([("=1+1", 'a"b', None)], "a string, b string, c string").select(mu.measurement_line([F.col("a"), F.col("b"), F.col("c")]).alias("l"), mu.image_bytes(F.lit("YWI=")).alias("i"), mu.image_bytes(F.lit("?")).alias("j")).first()
    assert (row.l, bytes(row.i), row.j) == ('\'=1+1,"a""b",', b"ab", None)
    colours = spark.createDataFrame([(0xFFFFEB3B,), (0xFF000000,), (0x81C784,)], "c bigint").select(mu.exact_colour(F.col("c")).alias("e"), mu.nearest_colour(F.col("c")).alias("n")).collect()
    assert [tuple(r) for r in colours] == [("Yellow", "Yellow"), ("Custom", "Green"), ("Green", "Green")]


def test_sections_and_marks(spark):
    p = spark.createDataFrame([(1, 0, 0, None), (1, 0, 1, "a"), (1, 1, 0, None), (1, 2, 0, None)], "doc_id int, page_no int, seq int, section string")
    marks = spark.createDataFrame([(1, 2, 0, "x"), (1, 2, 1, "y")], "doc_id int, page_no int, ord int, section string")
    assert [r.section for r in mu.sections_in_force(p, marks).orderBy("page_no", "seq").collect()] == ["Front matter", "a", "a", "y"]


def test_equations_meet_their_chunks(spark):
    c = spark.createDataFrame([(1, 0, "see ( 6.1 )", 1, 3), (1, 1, "nothing", 1, 3), (2, 0, "(6.1)", 1, 3)], "doc_id int, chunk_index int, text string, page_start int, page_end int")
    e = spark.createDataFrame([(1, 2, "(6.1)"), (1, 5, "(6.1)"), (1, 1, "(6.2)")], "doc_id int, page_no int, label string")
    assert [tuple(r) for r in mu.equations_of_chunks(c, e).collect()] == [(1, 0, [(2, "(6.1)")])]


def test_cells_join(spark):
    df = spark.createDataFrame([(["ab", "cd", "Ef", None, "g/", "H"],), ([],), (["", "a"],)], "r array<string>").select(mu.merged_cells(F.col("r")).alias("m"))
    assert [[tuple(x) for x in r.m] for r in df.collect()] == [[("abcd", 2), ("Efg/H", 3)], [], [("", 1), ("a", 1)]]
