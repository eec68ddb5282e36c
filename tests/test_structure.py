"""Rules of chunks, grades, page sets and dates on small inputs."""

import pytest
from pyspark.sql import functions as F

from pagemill.functions import grades
from pagemill.operators import chunks as ch
from pagemill.operators import pageops as po


def test_paragraphs_join_lines():
    page = "1 Scope\nA long-\nstanding rule\nof art.\nNext one\n• point\nContents ..... 4\nLicensee=me"
    assert list(ch.paragraphs(page)) == ["1 Scope", "A longstanding rule of art.", "Next one", "• point"]
    assert list(ch.paragraphs(None)) == [] == list(ch.paragraphs(" \n\t"))


@pytest.mark.parametrize("target", [100, 600])
def test_chunks_hold_everything_within_the_budget(spark, target):
    o = ch.ChunkOptions(target=target)
    pages = [(k, "\n".join(f"{k}.{j} Heading\nWord number {j} stands here, again and again. " * 3 for j in range(1, 9))) for k in range(1, 6)]
    frame = spark.createDataFrame([(1, k, t, "Book") for k, t in pages], "doc_id bigint, page_no int, text string, title string")
    found = ch.chunks(frame, o).orderBy("chunk_index").collect()
    rows = [(r.chunk_index, r.text, r.page_start, r.page_end, r.section_title, r.sections, r.context_before) for r in found]
    assert len(rows) > 1 and [r[0] for r in rows] == list(range(len(rows)))
    bodies = [r[1].split("\n\n", 1)[1] for r in rows]
    assert " ".join(bodies).split() == [w for _, t in pages for p in ch.paragraphs(t) for w in p.split()]
    for before, row, body in zip(["", *bodies], rows, bodies, strict=False):
        assert len(row[1]) <= target * 4 and before.endswith(row[6])
        assert row[2] <= row[3]


def test_a_huge_sentence_is_sliced():
    assert [len(u) for u in ch.units("x" * 450, 200)] == [200, 200, 50]


def test_empty_and_null_pages(spark):
    rows = spark.createDataFrame([(1, 0, None, None), (2, 0, "", "T"), (3, 0, "Some words.", None)], "doc_id bigint, page_no int, text string, title string")
    got = ch.chunks(rows).collect()
    assert [(r.doc_id, r.text, r.quality) for r in got] == [(3, "Untitled — Front matter\n\nSome words.", "ok")]


def test_chunks_do_not_depend_on_partitions(spark):
    rows = spark.createDataFrame([(k % 3, k, f"{k} Title\nline {k} of text.", "T") for k in range(60)], "doc_id bigint, page_no int, text string, title string")
    assert sorted(map(tuple, ch.chunks(rows).select("id", "text").collect())) == sorted(map(tuple, ch.chunks(rows.repartition(7)).select("id", "text").collect()))


def test_grades(spark):
    cases = {"plain": "ok", "bad �": "suspect", "∑ sum": "check", "हिन्दी": "suspect", "Greek αβγ": "ok", "yesss": "suspect", "iii www.a": "ok", " ".join("123456789") + " 10 11 12": "check"}
    df = spark.createDataFrame(list(cases.items()), "text string, want string")
    for r in df.withColumn("got", grades.grade(grades.issues(F.col("text")), F.col("text"))).collect():
        assert r.got == r.want, r.text


def test_page_sets(spark):
    cases = [("3, 7-9; 12", [3, 7, 8, 9, 12]), ("9–7", [7, 8, 9]), ("0", None), ("13", None), ("2,x", None), ("", None), ("2,2", [2])]
    df = spark.createDataFrame([(t,) for t, _ in cases], "t string").select(po.page_set(F.col("t"), F.lit(12)).alias("p"))
    assert [r.p for r in df.collect()] == [p for _, p in cases]


def test_cited_numbers_need_a_cue(spark):
    df = spark.createDataFrame([("see 8.5 and Figure 8.53, clause 4.1.2; 7.7",)], "t string")
    assert df.select(po.cited_numbers(F.col("t")).alias("n")).first().n == ["8.5", "4.1.2"]


def test_dates(spark):
    cases = [("D:20240229120000+01'30'", "2024-02-29 10:30:00"), ("D:2024", "2024-01-01 00:00:00"), ("nothing", None), ("D:20240101990000Z", "2024-01-01 23:00:00")]
    df = spark.createDataFrame([(t,) for t, _ in cases], "t string").select(po.parse_date(F.col("t")).cast("string").alias("d"))
    assert [r.d for r in df.collect()] == [d for _, d in cases]


def test_replies_ignore_bad_json(spark):
    df = spark.createDataFrame([(1, '[{"Id":1,"T":"a","A":"b"},{"Id":2,"T":" ","A":"b"}]'), (2, "no"), (3, None)], "k int, replies string")
    assert [tuple(r) for r in po.decode_replies(df, "k").collect()] == [(1, 1, "a", "b")]


def test_a_book_keeps_a_page(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "book string, page_no int")
    left = po.delete_pages(df, (F.col("page_no") == 0))
    assert sorted(map(tuple, left.collect())) == [("a", 0), ("b", 0)]
