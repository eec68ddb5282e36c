"""Outlines from pointers, against a walk from entry to entry."""

import random
from pathlib import Path

from pagemill.operators.bookmarks import read_outline, whole_outline
from pagemill.plans.queries import QUERIES
from pagemill.sources.scratch import shared_folder

SCHEMA = "doc_id bigint, node int, child int, next int, title string, page_no int"


def walk(rows, root=0, nodes=8_000, levels=32):
    """Entries in the order in which a reader follows the pointers."""
    by = {r[1]: r for r in rows}
    out = []

    def siblings(node, depth):
        seen = set()
        while depth < levels and node in by and node not in seen and len(out) < nodes:
            seen.add(node)
            out.append((depth, node))
            siblings(by[node][2], depth + 1)
            node = by[node][3]

    siblings(by[root][2], 0) if root in by else None
    return out


def tree(doc, n, seed, deep=False):
    """A random outline; now and then the last entry of a list points back into it."""
    r, kids = random.Random(seed), {0: []}
    for k in range(1, n):
        kids[k] = []
        kids[k - 1 if deep else r.randrange(k)].append(k)
    after = {a: b for c in kids.values() for a, b in zip(c, c[1:])}
    for c in kids.values():
        if c and r.random() < 0.3:
            after[c[-1]] = r.choice(c)
    return [(doc, k, kids[k][0] if kids[k] else None, after.get(k), f"t{k}", k * 2) for k in range(n)]


def test_read_outline(spark):
    docs = {1: tree(1, 60, 1), 2: tree(2, 40, 2, deep=True), 3: tree(3, 300, 3), 4: [(4, 0, 1, None, "", 0)] + [(4, k, None, k + 1, None, k) for k in range(1, 9_001)], 5: [(5, 0, None, None, "r", 0)], 6: [(6, 1, 2, 1, "x", 0)]}
    rows = [x for d in docs.values() for x in d]
    got = read_outline(spark.createDataFrame(rows + docs[1][:9], SCHEMA)).orderBy("doc_id", "ord").collect()
    for d, own in docs.items():
        mine = [r for r in got if r.doc_id == d]
        assert [(r.depth, r.node) for r in mine] == walk(own)
        assert [r.ord for r in mine] == list(range(len(mine)))
    assert max(r.depth for r in got if r.doc_id == 2) == 31
    assert {r.title for r in got if r.doc_id == 4} == {""}


def test_damaged_and_empty_outlines(spark):
    # Entry 3 names its ancestor 1 as its child, and 9 is led to by nothing: each entry stands once.
    rows = [(1, 0, 1, None, "", 0), (1, 1, 2, None, "a", 1), (1, 2, None, 3, "b", 2), (1, 3, 1, 77, "c", 3), (1, 9, 2, None, "d", 4), (None, 1, None, None, "e", 5)]
    got = read_outline(spark.createDataFrame(rows, SCHEMA)).orderBy("ord").collect()
    assert [(r.depth, r.node) for r in got] == [(0, 1), (1, 2), (1, 3)]
    assert read_outline(spark.createDataFrame([], SCHEMA)).count() == 0


def test_only_what_the_outline_reads_stays_stored(spark):
    folder = Path(shared_folder(spark).removeprefix("file://"))
    stored = lambda: {p for p in folder.rglob("*") if p.is_dir() and any(x.is_file() for x in p.iterdir())}
    before = stored()
    got = read_outline(spark.createDataFrame(tree(1, 200, 5, deep=True) + tree(2, 400, 6), SCHEMA))
    # The entries, and the ways to them from the root; no round's tables.
    assert len(stored() - before) == 2
    assert [r.node for r in got.where("doc_id = 2").orderBy("ord").collect()] == [n for _, n in walk(tree(2, 400, 6))]


def standing(rows, root=0):
    """Entries of any outline, damaged or not, by the rule: the root's list or that of the smallest parent that stands in a list."""
    by = {r[1]: r for r in rows}

    def listed(parent):
        out, at = [], by[parent][2]
        while at is not None and at not in out:
            out.append(at)
            at = by[at][3] if at in by else None
        return out

    lists = {p: listed(p) for p in by}
    inside = {x for v in lists.values() for x in v}
    own = {}
    for p in sorted((p for p in lists if p == root or p in inside), key=lambda p: (p != root, p)):
        for k, x in enumerate(lists[p]):
            own.setdefault(x, (p, k))
    out = []

    def show(parent, depth):
        for x in sorted((x for x in own if x != root and x in by and own[x][0] == parent), key=lambda x: own[x][1]):
            out.append((depth, x))
            show(x, depth + 1)

    show(root, 0)
    return out


def test_whole_outline_has_no_bounds(spark):
    long = [(4, 0, 1, None, "", 0)] + [(4, k, None, k + 1, None, k) for k in range(1, 9_001)]
    docs = {1: tree(1, 300, 3), 2: tree(2, 100, 2, deep=True), 4: long}
    got = whole_outline(spark.createDataFrame([x for d in docs.values() for x in d], SCHEMA)).orderBy("doc_id", "ord").collect()
    for d, own in docs.items():
        mine = [r for r in got if r.doc_id == d]
        assert [(r.depth, r.node) for r in mine] == walk(own, nodes=10**6, levels=10**6)
        assert [r.ord for r in mine] == list(range(len(mine)))
    assert (max(r.depth for r in got), sum(r.doc_id == 4 for r in got)) == (98, 9_000)


def test_query_reads_deep_books_to_their_end(spark):
    got = QUERIES["outline_pointers"](spark, "/root/testdata/sf0.001").where("doc_id = 1001")
    assert sorted(r.depth for r in got.collect()) == list(range(49))


def test_whole_outline_of_damaged_pointers(spark):
    r = random.Random(9)
    any_ = lambda n: r.choice([None, None, *range(n + 2)])
    # 2 leads nowhere from the root and is a smaller parent than 5; 3 stands in its list alone; 11 and 12 are each other's child.
    docs = {0: [(0, 0, 5, None, "", 0), (0, 2, 7, None, "", 0), (0, 5, 7, 6, "", 0), (0, 6, None, None, "", 0), (0, 7, None, None, "", 0), (0, 11, 12, None, "", 0), (0, 12, 11, None, "", 0)], 99: tree(99, 30, 1)}
    docs |= {d: [(d, k, any_(n), any_(n), "", 0) for k in range(n)] for d in range(1, 60) for n in [r.randrange(2, 16)]}
    got = whole_outline(spark.createDataFrame([x for d in docs.values() for x in d], SCHEMA)).orderBy("doc_id", "ord").collect()
    for d, own in docs.items():
        assert [(x.depth, x.node) for x in got if x.doc_id == d] == standing(own), d
    assert [x.node for x in got if x.doc_id == 0] == [5, 7, 6]
