"""Sections and chunks of documents with outlines."""

import random

from pagemill.operators import analysis as an
from pagemill.operators import chunks as ch
from pagemill.operators import flow as fl

P = "doc_id long, page_no int, text string, title string"
M = "doc_id long, page_no int, ord int, title string"


def sections(spark, pages, outline, clauses=None, hidden=None):
    frame = spark.createDataFrame([(1, p, t, "T") for p, t in pages], P)
    text = ch.page_paragraphs(frame, 2240)
    marks = fl.section_markers(spark.createDataFrame(outline, M), clauses)
    flowed = fl.flow(text, marks, hidden)
    return [(r.page_no, r.section, r.heading, r.starts) for r in flowed.orderBy("page_no", "seq").collect()]


def test_headings_switch_where_they_stand(spark):
    pages = [(0, "Cover."), (1, "Text that goes on.\n1.1 Scope\nIt holds."), (2, "More of it.\n1.3 Loads 7\nHeavy ones."), (3, "Last words."), (4, ""), (5, "End.")]
    outline = [(1, 1, 0, "1.1 Scope 12"), (1, 2, 1, "Elsewhere"), (1, 2, 2, "1.2 Retired"), (1, 2, 3, "1.3 Loads"), (1, 4, 4, "Empty page"), (1, 9, 5, " ")]
    assert sections(spark, pages, outline) == [
        (0, "Front matter", False, False), (1, "Front matter", False, False), (1, "1.1 Scope", True, True), (1, "1.1 Scope", False, False),
        (2, "1.2 Retired", False, True), (2, "1.3 Loads", True, True), (2, "1.3 Loads", False, False), (3, "1.3 Loads", False, False), (5, "Empty page", False, False),
    ]


def test_a_match_retires_what_waits_before_it(spark):
    pages = [(0, "Beta begins here and goes on for long.\nAlpha too; it ran on.\nThe end."), (1, "Next.")]
    outline = [(1, 0, 0, "Alpha too"), (1, 0, 1, "Beta begins"), (1, 0, 2, "The end")]
    got = sections(spark, pages, outline)
    # The second heading is printed first: the first one no longer waits. The last paragraph is a sentence, so the title counts.
    assert [s for _, s, _, _ in got] == ["Beta begins", "Beta begins", "The end", "The end"]


def test_titles_of_hidden_pages_and_clauses(spark):
    pages = [(0, "Words."), (3, "2.4 Printed otherwise\nBody text.")]
    hidden = spark.createDataFrame([(1, 0)], "doc_id long, page_no int")
    outline = [(1, 0, 0, "2.4 Concrete"), (1, 0, 1, "2.5 Steel"), (1, 0, 2, "2.6 Timber")]
    assert [s for _, s, _, _ in sections(spark, pages, outline, hidden=hidden)] == ["Front matter", "2.4 Printed otherwise", "2.4 Printed otherwise"]
    clauses = spark.createDataFrame([(1, 3, 0, "2.4", "Printed"), (1, 3, 1, "2.40", "Not there"), (1, 3, 2, "9", "Far off"), (1, 0, 3, "1.35", "Gk")], "doc_id long, page_no int, ord int, number string, title string")
    few = [(1, 0, 0, "Only one")]
    assert [s for _, s, _, _ in sections(spark, pages, few, clauses)] == ["Front matter", "2.4 Printed otherwise", "2.4 Printed otherwise"]


def whole(pages, o):
    """Chunks by texts, as they grow."""
    out, buf, sections, context, first, last = [], "", [], "", 0, 0

    def emit(forced, carry):
        nonlocal buf, sections, context
        body = " ".join(buf.split())
        if not body or (not forced and len(body) < o.floor):
            return
        out.append((body, first, last, sections, context))
        tail = body[-o.carried :]
        context = "" if not carry else tail[tail.find(" ") + 1 :] if len(body) > o.carried and tail.find(" ") > 0 else tail
        buf, sections = "", []

    current = "Front matter"
    for page, text in pages:
        for p in ch.paragraphs(text):
            starts = ch.is_heading(p)
            current = p if starts else current
            for k, u in enumerate(ch.units(p, o.limit)):
                if buf:
                    if starts and k == 0 and len(buf) >= o.floor:
                        emit(False, False)
                    elif len(buf) + len(u) + 1 > o.limit:
                        emit(True, True)
                first = page if not buf else first
                sections = sections if sections[-1:] == [current] else [*sections, current]
                buf += u + " "
                last = page
    emit(True, False)
    return out


def test_chunks_by_lengths_are_those_by_texts(spark):
    rnd = random.Random(8)
    books = {}
    for d in range(6):
        some = ["word", "x" * 90, "and more. ", "end.\n", f"\n{d}.2 Heading\n", " ", "a b c d e", "z" * 700 + " "]
        books[d] = [(p, "".join(rnd.choice(some) + " " for _ in range(rnd.randint(0, 60)))) for p in range(9)]
    frame = spark.createDataFrame([(d, p, t, None) for d, pages in books.items() for p, t in pages], P)
    o = ch.ChunkOptions(target=100, overlap=0.2, least=20, prefix=False)
    got = {}
    for r in ch.chunks(frame, o).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append((r.text, r.page_start, r.page_end, r.sections, r.context_before))
    assert got == {d: want for d, pages in books.items() if (want := whole(pages, o))}


def test_page_numbers_go_in_margins_only(spark):
    assert list(ch.paragraphs("12\nText of a page.\n3\nxiv", margins=[True, False, False, True])) == ["Text of a page.", "3"]
    rows = spark.createDataFrame([(1, 0, "7\nWords.", "T", [True, False])], P + ", margins array<boolean>")
    assert ch.chunks(rows).first().text.endswith("\n\nWords.")


def test_texts_are_exchanged_once_for_packing(spark):
    p = spark.createDataFrame([(1, 0, k, [f"w{k} " * 9]) for k in range(6)], "doc_id bigint, page_no int, seq int, units array<string>")
    f = spark.createDataFrame([(1, 0, k, f"s{k // 2}", [k // 3], [k == 3]) for k in range(6)], "doc_id bigint, page_no int, seq int, section string, chunk array<int>, carried array<boolean>")
    got = fl.packed(p, f, 10)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert [(r.chunk_index, r.sections, r.context_before) for r in got.orderBy("chunk_index").collect()] == [(0, ["s0", "s1"], ""), (1, ["s1", "s2"], "w2 w2 w2")]


def test_lines_and_pages_left_out(spark):
    pages = [(1, p, f"Héader  of all\nText {chr(97 + p)} stands here.", "T") for p in range(5)] + [(1, 5, None, "T"), (2, 0, "Héader of all\nAlone.", "T")]
    frame = spark.createDataFrame(pages, P)
    lines = spark.createDataFrame([(1, "Héader of all")], "doc_id long, line string")
    digests = an.repeated_digests(frame, 0.5, group="doc_id")
    assert digests.columns == ["doc_id", "digest", "on_pages", "n_pages"] and digests.count() == 1
    skip = spark.createDataFrame([(1, 2), (1, 2), (3, 0)], "doc_id long, page_no int")
    get = lambda *left: sorted((r.doc_id, r.page_no, r.text) for r in ch.page_paragraphs(frame, 99, *left).collect())
    want = [(1, p, f"Text {chr(97 + p)} stands here.") for p in (0, 1, 3, 4)] + [(2, 0, "Héader of all Alone.")]
    assert get(lines, skip) == get(digests, skip) == want
    assert len(get(digests)) == 6 and all("Héader" in t for d, _, t in get(None, skip))
