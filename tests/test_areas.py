"""Edges of the operators on files, regions, annotations and exports."""

import json

from pyspark.sql import functions as F

from pagemill.operators import annotations as no
from pagemill.operators import chunks as ch
from pagemill.operators import exports as ex
from pagemill.operators import page_regions as pr
from pagemill.operators import regions as rg
from pagemill.sources.files import decoded, file_pages, text_files
from pagemill.sources.tables import book_pages, to_jsonl


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ftwo")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "x.bin").write_bytes(b"x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.txt").write_text("three")
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.error) for r in text_files(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("one\ftwo", None), "bad.txt": (None, "not UTF-8")}
    assert decoded(spark.createDataFrame([("none.txt", bytearray())], "path string, content binary")).first().error == "empty"
    deep = text_files(spark, str(tmp_path), recursive=True)
    assert sorted((r.page_no, r.text) for r in file_pages(deep).collect()) == [(0, "one"), (0, "three"), (1, "two")]


def test_book_pages_are_numbered_over_ranges(spark):
    ids = [5, 1 << 17, (1 << 17) + 3, 1 << 20, 7]
    df = spark.createDataFrame([(i, "t", "s") for i in ids], "doc_id long, text string, source string")
    assert [(r.doc_id, r.page_no) for r in book_pages(df).orderBy("page_no").collect()] == [(i, k) for k, i in enumerate(sorted(ids))]


def test_shapes_that_are_none(spark):
    rows = ["", "{", "null", '{"Kind":"Line","Box":[1,2,3,4]}', '{"Kind":"Tick","Box":[1,2,3,4],"LineWidth":-1}', '{"Kind":"MeasureArea","Box":[1,2,3,4],"Leader":[[0,0],[1,1],[2,0]],"Upp":2,"Unit":" "}']
    df = spark.createDataFrame([(r,) for r in rows], "j string").select(no.decode_shape(F.col("j")).alias("s")).where("s is not null")
    assert [(r.s.kind, r.s.line_width, r.s.unit) for r in df.collect()] == [("Tick", 0.0, None), ("MeasureArea", 0.0, None)]


def test_separator_of_nothing_and_of_a_gap(spark):
    labels = spark.createDataFrame([(1, 100.0, 0.0), (2, 100.0, 0.0)], "key int, hi double, lo double")
    ink = spark.createDataFrame([(1, 80.0, 100.0), (1, 0.0, 50.0), (3, 1.0, 2.0)], "key int, y0 double, y1 double")
    got = {r.key: r.at for r in rg.separators(labels, ink).collect()}
    assert got == {1: 65.0, 2: 50.0}


def test_measures_without_length(spark):
    df = spark.range(1).select(rg.end_ticks(F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("t"), rg.pixel_size(F.lit(0.0), F.lit(0.0)).alias("p")).first()
    assert df.t == [] and (df.p.width, df.p.height) == (1, 1)


def test_empty_lists(spark):
    none = spark.createDataFrame([], "doc_id long, page_no int, token_estimate int, quality string")
    assert ex.export_summary(none).count() == 0
    pages = spark.createDataFrame([(1, None)], "doc_id long, page_no int")
    assert ex.section_counts(pages, spark.createDataFrame([], "doc_id long, section int")).first().sections == 0
    files = spark.createDataFrame([("f", 0), ("f", 1)], "set_id string, ord int")
    assert sorted(r.ord for r in ex.moved(files, 0, 5).collect()) == [0, 1]


FIELDS = "id text source_path doc_title page_start page_end section_title chunk_index token_estimate quality issues pdf_page_start pdf_page_end page_label_start page_label_end sections context_before equations".split()


def test_chunk_export(spark):
    """Repeated lines and contents pages are left out; all fields are there."""
    body = [f"{k + 1}.1 Heading of part\nSome words on beam {k} and its load (E.{k})." for k in range(5)]
    contents = "\n".join(f"Part number .... {k}" for k in range(6))
    texts = [contents, *(f"Running title\n{b}" for b in body)]
    pages = spark.createDataFrame([(1, k, t, "A book") for k, t in enumerate(texts)], "doc_id long, page_no int, text string, title string")
    files = spark.createDataFrame([(1, "/in/a book.txt", "A book")], "doc_id long, path string, title string")
    labels = spark.createDataFrame([(1, 1, "iv")], "doc_id long, page_no int, label string")
    equations = spark.createDataFrame([(1, 2, "( E.1 )"), (1, 2, "(E.9)"), (1, 9, "(E.2)")], "doc_id long, page_no int, label string")
    out = ch.export(ch.document_chunks(pages, ch.ChunkOptions(target=48, least=1)), files, labels, equations).orderBy("chunk_index")
    got = out.collect()
    assert out.columns == FIELDS
    assert [r.id for r in got] == [f"a book#c000{k}" for k in range(len(got))] and all(r.source_path == "a book.txt" for r in got)
    whole = " ".join(r.text for r in got)
    assert "Running" not in whole and "...." not in whole and all(f"beam {k}" in whole for k in range(5))
    assert got[0].page_label_start == "iv" and got[0].pdf_page_start == 2
    assert [[e.label for e in r.equations] for r in got if r.equations] == [["( E.1 )"]]
    line = json.loads(to_jsonl(out).first().value)
    assert list(line) == FIELDS


def test_rects_grow_with_their_characters(spark):
    rows = [(1, 0, 0.0, 0.0, 5.0, 8.0), (1, 1, 5.0, 5.0, 9.0, 13.0), (1, 2, 9.0, 10.0, 12.0, 18.0), (1, 3, 0.0, 40.0, 5.0, 48.0), (1, 4, 0.0, 0.0, 0.2, 9.0)]
    got = rg.merged_rects(spark.createDataFrame(rows, "key int, seq int, x0 double, y0 double, x1 double, y1 double"), "key", pad=0.0).orderBy("rect").collect()
    assert [(r.x0, r.y0, r.x1, r.y1) for r in got] == [(0, 0, 12, 18), (0, 40, 5, 48)]


def test_captions_find_their_graphics(spark):
    boxes = "x0 double, y0 double, x1 double, y1 double"
    captions = spark.createDataFrame([(1, 1, "Table", 0.0, 100.0, 50.0, 110.0), (1, 2, "Figure", 0.0, 300.0, 50.0, 310.0), (2, 1, "Figure", 0.0, 100.0, 50.0, 110.0)], f"key int, caption int, kind string, {boxes}")
    graphics = [(1, 0.0, 60.0, 40.0, 90.0), (1, 41.0, 20.0, 60.0, 58.0), (1, 0.0, 120.0, 40.0, 140.0), (1, 0.0, 320.0, 9.0, 325.0), (1, 12.0, 320.0, 60.0, 360.0), (2, 0.0, 10.0, 50.0, 20.0)]
    got = pr.caption_regions(captions, spark.createDataFrame(graphics, f"key int, {boxes}"), 800.0).collect()
    assert {(r.key, r.caption): (r.side, r.x0, r.y0, r.x1, r.y1) for r in got} == {(1, 1): ("below", 0.0, 20.0, 60.0, 90.0), (1, 2): ("above", 0.0, 320.0, 60.0, 360.0)}


def test_page_regions(spark):
    """Wrapped captions, legends, unruled tables, header rows, and what stands between."""
    text = [
        (1, 0, "Table 1 Loads on", 0.0, 700.0, 90.0, 710.0), (1, 1, "floors and roofs", 0.0, 688.0, 90.0, 698.0), (1, 2, "Head", 5.0, 672.0, 60.0, 680.0), (1, 3, "12", 10.0, 640.0, 20.0, 650.0),
        (2, 0, "key: a beam", 10.0, 340.0, 90.0, 350.0), (2, 1, "Figure 2 - A frame", 0.0, 300.0, 90.0, 310.0),
        (3, 0, "These words are not a key but a sentence here.", 10.0, 340.0, 90.0, 350.0), (3, 1, "Figure 3: No frame", 0.0, 300.0, 90.0, 310.0),
        (4, 0, "Table A.1 Values", 0.0, 700.0, 90.0, 710.0), (4, 1, "A 1", 0.0, 685.0, 90.0, 695.0), (4, 2, "B 2", 0.0, 670.0, 80.0, 680.0), (4, 3, "far 3", 0.0, 600.0, 90.0, 610.0),
        (5, 0, "Table 9 On top", 0.0, 790.0, 90.0, 799.0),
    ]
    lines = spark.createDataFrame([(*r, r[0] == 5) for r in text], "key int, line int, text string, x0 double, y0 double, x1 double, y1 double, margin boolean")
    boxes = [(1, 0.0, 630.0, 80.0, 671.0), (2, 0.0, 380.0, 90.0, 420.0), (3, 0.0, 380.0, 90.0, 420.0), (5, 0.0, 700.0, 80.0, 780.0), (6, 0.0, 0.0, 80.0, 80.0)]
    got = pr.page_regions(lines, spark.createDataFrame(boxes, "key int, x0 double, y0 double, x1 double, y1 double"), 800.0)
    assert {(r.key, r.kind, r.label, r.title, r.how, r.x0, r.y0, r.x1, r.y1, tuple(r.lines)) for r in got.collect()} == {
        (1, "Table", "Table 1", "Table 1 Loads on floors and roofs", "below", 0.0, 630.0, 80.0, 680.0, (0, 1)), (2, "Figure", "Figure 2", "Figure 2 - A frame", "legend", 0.0, 340.0, 90.0, 420.0, (1,)),
        (4, "Table", "Table A.1", "Table A.1 Values", "text", 0.0, 670.0, 90.0, 695.0, (0,)),
    }
    assert pr.page_regions(lines.limit(0), spark.createDataFrame(boxes, "key int, x0 double, y0 double, x1 double, y1 double"), 800.0).count() == 0


def test_display_blocks_end_at_text(spark):
    lines = spark.createDataFrame([(1, "These are many words of prose", 40.0, 600.0, 400.0, 610.0, False), (1, "x = 1", 90.0, 560.0, 200.0, 570.0, False), (1, "where it is so", 40.0, 500.0, 300.0, 510.0, False), (1, "7", 300.0, 20.0, 310.0, 30.0, True)], "key int, text string, x0 double, y0 double, x1 double, y1 double, margin boolean")
    e = [(1, 1, 90.0, 560.0, 200.0, 570.0, 380.0, 560.0, 400.0, 570.0), (1, 2, 90.0, 530.0, 200.0, 540.0, 380.0, 530.0, 400.0, 540.0), (2, 1, 90.0, 30.0, 600.0, 40.0, 380.0, 30.0, 400.0, 40.0)]
    equations = spark.createDataFrame(e, "key int, eq int, x0 double, y0 double, x1 double, y1 double, lx0 double, ly0 double, lx1 double, ly1 double")
    none = spark.createDataFrame([], "key int, x0 double, y0 double, x1 double, y1 double")
    got = {(r.key, r.eq): (r.x0, r.y0, r.x1, r.y1) for r in pr.display_blocks(equations, lines, none, 600.0, 800.0).collect()}
    # The first part ends between its own ink and the second label's centre; the page without text has a column of its own.
    assert got == {(1, 1): (40.0, 547.5, 400.0, 598.5), (1, 2): (40.0, 511.5, 400.0, 547.5), (2, 1): (50.0, 30.0, 600.0, 135.0)}
