"""Phrase search: options, places in the text as it is, totals and streams."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from pagemill.operators import phrases as ph
from pagemill.operators import places as pl
from pagemill.streaming.progress import progressive_search, stream_totals


@pytest.mark.parametrize(
    ("text", "term", "options", "want"),
    [
        ("bolts bolt abolt bolt.", "bolt", {"whole_word": True}, [6, 17]),
        ("aaa", "aa", {}, [0]),
        ("aaa", "aa", {"overlapping": True}, [0, 1]),
        ("Of  the\nOF THE of\0the", "of the", {}, [0, 8, 15]),
        ("Of the of the", "of the", {"match_case": True}, [7]),
        ("İx of the", "OF the", {}, [3]),
        ("\u212aelvin kelvin", "Kelvin", {}, [0, 7]),
        ("ΣΟΦΟΣ σοφοσ 𐐀 𐐨", "σοφοσ 𐐨", {}, [6]),
        ("a.b axb A.B", "a.b", {}, [0, 8]),
        ("a_b a b", "a", {"whole_word": True}, [0, 4]),
        ("été Été", "ÉTÉ", {"whole_word": True}, [0, 4]),
        ("", "a", {}, []),
        (" \n", "a", {}, []),
        ("text", "  ", {}, []),
    ],
)
def test_occurrences(text, term, options, want):
    assert [s for s, _ in ph.occurrences(text, term, **options)] == want


def test_length_covers_the_original_white_space():
    assert ph.occurrences("x of \n the y", "of the") == [(2, 8)]


def test_snippets_are_cut():
    text = "a" * 60 + " word " + "b" * 60
    (start, n), = ph.occurrences(text, "word")
    assert ph.snippet(text, start, n) == "…" + "a" * 43 + " word " + "b" * 43 + "…"


def test_find_phrases_and_totals(spark):
    df = spark.createDataFrame([(1, "Of the best of the"), (2, None), (3, ""), (4, "none"), (1, "of the")], "doc_id bigint, text string")
    hits = ph.find_phrases(df, "of the")
    assert sorted((r.doc_id, r.char_start) for r in hits.collect()) == [(1, 0), (1, 0), (1, 12)]
    assert ph.find_phrases(df.limit(0), "of the").count() == 0 == ph.find_phrases(df, " ").count()
    assert tuple(ph.search_totals(df.dropDuplicates(["doc_id"]), hits).first()) == (4, 1, 3)


def by_characters(text, term, match_case, whole_word, overlapping):
    """The search a character at a time over the text with its white space collapsed."""
    flat, at = "", []
    for k, c in enumerate(text):
        blank = c.isspace() or c == "\0"
        if not (blank and flat[-1:] in ("", " ")):
            flat, at = flat + (" " if blank else c), [*at, k]
    want = " ".join(term.replace("\0", " ").split())
    if not match_case:
        flat, want = ("".join(map(ph.folded, x)) for x in (flat, want))
    hits, k = [], flat.find(want) if want else -1
    while k >= 0:
        end = k + len(want)
        inside = whole_word and (flat[max(k - 1, 0) : k].isalnum() or flat[end : end + 1].isalnum())
        if not inside:
            hits.append((at[k], at[end - 1] - at[k] + 1))
        k = flat.find(want, k + 1 if inside or overlapping else end)
    return hits


@given(st.text("aAbk\u212aİıß.,_ \n\0\x85\u2009é", max_size=40), st.text("aAbKkİß. \0", max_size=4), st.booleans(), st.booleans(), st.booleans())
def test_against_a_search_by_characters(text, term, match_case, whole_word, overlapping):
    options = (match_case, whole_word, overlapping)
    assert ph.occurrences(text, term, *options) == by_characters(text, term, *options)


def test_counts_are_those_of_the_hits(spark):
    texts = ["of the of\u2003the", "OF\0\nTHE", "\u212aof the.", "ofthe", "", None, "𐐀 of the"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for term in ("of the", "k", "𐐨 OF", "", " . "):
        got = [r.n for r in df.orderBy("doc_id").select(ph.phrase_count(df.text, term).alias("n")).collect()]
        hits = {r.doc_id: r["count"] for r in ph.find_phrases(df, term).groupBy("doc_id").count().collect()}
        assert got == [len(ph.occurrences(t or "", term)) for t in texts] == [hits.get(k, 0) for k in range(len(texts))]
        assert tuple(ph.phrase_totals(df, term).first()) == tuple(ph.search_totals(df, ph.find_phrases(df, term)).first())


def test_streams(spark, tmp_path):
    df = spark.createDataFrame([(k, "of the" if k % 2 else "no") for k in range(10)], "doc_id bigint, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = []
    q = progressive_search(spark, str(tmp_path / "in"), "doc_id bigint, text string", "of the", lambda b, _: got.extend(r.doc_id for r in b.collect()), str(tmp_path / "c"))
    q.processAllAvailable()
    q.stop()
    assert sorted(got) == [1, 3, 5, 7, 9]
    q = stream_totals(spark, str(tmp_path / "in"), "doc_id bigint, text string", "of the").writeStream.format("memory").queryName("totals").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert tuple(spark.table("totals").first()) == (10, 5)


def test_scales(spark):
    df = spark.createDataFrame([("1:50",), ("2.5",), ("0",), ("-1",), ("x",), (None,)], "t string")
    assert [r.s for r in df.select(pl.scale_of(df.t).alias("s")).collect()] == [50.0, 2.5, None, None, None, None]


def test_table_texts_keep_gaps(spark):
    cells = spark.createDataFrame([(1, 0, 0, 'a"b'), (1, 0, 2, "c,d"), (1, 1, 1, "e\tf")], "key int, row int, col int, text string")
    assert pl.grid_text(cells).first().content == '"a""b",,"c,d"\r\n,e\tf,\r\n'
    assert pl.grid_text(cells, "tsv").first().content == 'a"b\t\tc,d\n\te f\t\n'


def test_search_finds_as_many(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    native = {r.doc_id: r["count"] for r in ph.find_phrases(docs, "of the").groupBy("doc_id").count().collect()}
    want = {r.doc_id: len(ph.occurrences(r.text or "", "of the")) for r in docs.collect()}
    assert native == {k: n for k, n in want.items() if n} and native
