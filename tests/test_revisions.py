"""Line differences against the textbook table, and pages of one revision only."""

import random

from pyspark.sql import functions as F

from pagemill.functions.geometry import tick_points
from pagemill.operators import analysis as an
from pagemill.operators import regions as rg
from pagemill.operators import revisions as rv


def longest(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_differences_are_shortest_and_rebuild_the_page():
    rnd = random.Random(1)
    for _ in range(400):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randint(1, 14))] for _ in range(2))
        changes = rv.line_changes("\n".join(a), "\n".join(b))
        removed = {k for c, f, l, _ in changes if c == "removed" for k in range(f, l + 1)}
        added = {k for c, f, l, _ in changes if c == "added" for k in range(f, l + 1)}
        assert len(a) - len(removed) == longest(a, b)
        assert [x for k, x in enumerate(a) if k not in removed] == [x for k, x in enumerate(b) if k not in added]
    assert rv.line_changes("x", "x") == [] == rv.line_changes(None, None)
    assert rv.line_changes("a\nb\nc", "a\nz\nc\nd") == [("removed", 1, 1, 1), ("added", 1, 1, 2), ("added", 3, 3, 3)]


def test_pages_of_one_revision(spark):
    old = spark.createDataFrame([(1, 0, "a\nb"), (1, 1, "same"), (2, 0, None)], "doc_id int, page_no int, text string")
    new = spark.createDataFrame([(1, 1, "same"), (1, 2, "c"), (2, 0, "")], "doc_id int, page_no int, text string")
    got = {tuple(r) for r in rv.page_changes(old, new).collect()}
    assert got == {(1, 0, "removed", 0, 1, 0), (1, 2, "added", 0, 0, 0), (2, 0, "added", 0, 0, 0)}


def test_column_gaps_against_samples(spark):
    rnd = random.Random(3)
    runs = [(k, r, x := rnd.randint(0, 80) / 2, x + rnd.randint(1, 30) / 2) for k in range(30) for r in range(4) for _ in range(rnd.randint(1, 4))]
    got = {}
    for r in rg.column_gaps(spark.createDataFrame(runs, "key int, row int, x0 double, x1 double"), 0.0, 60.0, 0.5).collect():
        got.setdefault(r.key, []).append((r.start, r.end))
    for k in range(30):
        rows = [[(a, b) for kk, rr, a, b in runs if (kk, rr) == (k, r)] for r in range(4)]
        data = [r for r in rows if len(r) > 1 and max(b - a for a, b in r) < 33]
        need = -(-len(data) * 6 // 10)
        clear = [s for s in range(121) if data and sum(not any(a <= s / 2 <= b for a, b in r) and any(a > s / 2 for a, _ in r) for r in data) >= need]
        want = []
        for s in clear:
            want = [*want[:-1], (want[-1][0], s / 2)] if want and want[-1][1] == s / 2 - 0.5 else [*want, (s / 2, s / 2)]
        assert sorted(got.get(k, [])) == want


def test_captions_of_measurements(spark):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 2.0)]
    shapes = {"Area": square, "Distance": square, "Perimeter": square, "Flat": [(0.0, 0.0), (1.0, 0.0), (5.0, 0.0)]}
    rows = [(k, "Area" if k == "Flat" else k, i, x, y) for k, points in shapes.items() for i, (x, y) in enumerate(points)]
    got = {r.key: (r.x, r.y) for r in an.caption_anchors(spark.createDataFrame(rows, "key string, kind string, ord int, x double, y double")).collect()}
    assert got == {"Area": (2.0, 1.0), "Distance": (2.0, 0.0), "Perimeter": (0.0, 2.0), "Flat": (2.0, 0.0)}
    t = spark.range(1).select(tick_points(F.lit(10.0), F.lit(5.0), F.lit(0.0), F.lit(15.0)).alias("t")).first().t
    assert [(round(p.x, 9), round(p.y, 9)) for p in t] == [(1.2, 10.2), (4.0, 6.6), (9.0, 13.8)]
