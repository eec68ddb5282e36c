"""Jaccard self-join of documents' word shingles, exact at its threshold.

Documents with equal shingle sets form a class, and one of each class goes on. Tokens
(shingles) are hashed into groups twice.

*Meeting.* Two sets that link differ in ``k`` shingles at most, ``k`` following from the
threshold and their size class. Of more than ``k`` groups at least one is then the same in
both, so sets meet under the digests of whole groups. A group of several shingles is rarely
equal by chance, however large the corpus is, so the rows that meet grow with the input.
Groups with too few shingles are not used; a set with too many of these also appears under
finer groupings, and at last under its first shingles (see :class:`Grouping`).

*Searching.* The sets that meet under a digest are a bucket. Each set is a point, its
shingles per group of a second, fixed hashing, and every bucket becomes R-trees over its
members' points, whose nodes hold the coordinates' maxima. The summed minima of two
points' coordinates cannot be less than the overlap of their sets, so only candidates that
may link come out. In a first round a bucket's members ask in turn, but not those that
another one found before; in further rounds only members ask that lie in another component
than their bucket's centre. A group of copies thus costs about as many pairs as it has
members, and no link between components is lost. Large buckets are dealt out in blocks.

*Verifying.* Candidates are compared on their words.

Defined results: A-Z count as a-z. A text of fewer words than a shingle has its word
sequence as its only shingle; null, empty and blank texts have none and link with
nothing. Every row counts for itself, so rows may share a doc_id; a null doc_id takes part
with its text but names no component (null where no row of a component has an id). Other
columns, whatever their names, are ignored; an empty table gives an empty result. Classes
are told apart by 128 bits of digests over 64-bit shingle hashes.
"""

from __future__ import annotations

import math
import re
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import components
from .runtime import Scratch, materialize, named, tidy
from .textscan import mix, shingles

#: Coordinates of a point, and those of inner nodes.
GROUPS = 256
FOLDED = 16
#: Members of a bucket that share an R-tree.
BLOCK = 1_024
#: Candidates of each component that a member asks for first; the rest only if these leave it apart.
BEST = 4
#: Tested pairs that a member takes along so as not to find them again.
KNOWN = 1_000
#: Rounds in which a member's candidates are verified one at a time.
FIRST_ROUNDS = 2
#: Bits of a membership map for each value, and of all (16 MB); it keeps most other rows out of a pass, and a join decides.
BITS_EACH = 16
MAP_BITS = 1 << 27
#: Stands for a missing id, after all others.
LAST = (1 << 63) - 1
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def group_counts(hashes: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """The point of a set: its members per hash group, in bytes if they fit."""
    counts = np.bincount((mix(hashes) & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    return counts.astype("u1" if counts.max(initial=0) < 256 else "<u4")


def fold(points: np.ndarray, groups: int) -> np.ndarray:
    """Points with fewer groups: groups that agree in their low bits are added up."""
    return points.reshape(*points.shape[:-1], -1, groups).sum(-2)


def overlap_bound(a: np.ndarray, b: np.ndarray) -> int:
    """At least the overlap of the two sets."""
    return int(np.minimum(a.astype(np.int64), b.astype(np.int64)).sum())


class CountRTree:
    """Packed R-tree over count points; every node has its members' coordinate maxima and size range."""

    FANOUT = 16

    def __init__(self, points: np.ndarray, num: int, den: int) -> None:
        self.num, self.den = num, den
        self.points = points.astype(np.int64)
        self.sizes = self.points.sum(1)
        folded = fold(self.points, FOLDED)
        # Sort-tile: by size, then within slices by the widest coordinate.
        order = np.argsort(self.sizes, kind="stable")
        tile = self.FANOUT * self.FANOUT
        if len(order) > tile:
            wide = int(folded.var(0).argmax())
            order = np.concatenate([s[np.argsort(folded[s, wide], kind="stable")] for s in np.split(order, range(tile, len(order), tile))])
        self.order = order
        level = (folded[order], self.sizes[order], self.sizes[order])
        self.levels = [level]
        while len(level[0]) > 1:
            at = np.arange(0, len(level[0]), self.FANOUT)
            level = (np.maximum.reduceat(level[0], at), np.minimum.reduceat(level[1], at), np.maximum.reduceat(level[2], at))
            self.levels.append(level)

    def search(self, point: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Members whose overlap with ``point`` may reach the threshold, and their bounds."""
        point = point.astype(np.int64)
        n = int(point.sum())
        q = fold(point, FOLDED)
        nodes = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            upper, least, most = self.levels[depth]
            if depth < len(self.levels) - 1:
                nodes = (nodes[:, None] * self.FANOUT + np.arange(self.FANOUT)).ravel()
                nodes = nodes[nodes < len(upper)]
            nodes = nodes[(self.den * most[nodes] >= self.num * n) & (self.num * least[nodes] <= self.den * n)]
            # |A & B| >= num / (num + den) * (|A| + |B|)
            nodes = nodes[np.minimum(upper[nodes], q).sum(1) * (self.num + self.den) >= self.num * (n + least[nodes])]
        found = self.order[nodes]
        sums = np.minimum(self.points[found], point).sum(1)
        near = (self.num + self.den) * sums >= self.num * (n + self.sizes[found])
        return found[near], sums[near]


class Grouping:
    """The digests under which sets meet, for one threshold.

    Size classes are so wide that sets which link lie in one or in neighbouring classes.
    Pairs whose smaller set lies in class ``p`` differ in ``most(p)`` shingles at most. A set
    therefore appears under groupings for its own class and for the one below. A grouping
    is good for a set if more than ``most(p)`` groups have ``least`` shingles or more; a set
    for which it is not also appears under the class's next grouping, and after the last one
    under its first shingles in the order of hashes, a prefix that sets which link share one
    of. Of two sets, that with fewer groupings has a good one last, and both appear in it.
    """

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        self.width = 1.001 * math.log(den / num)
        self.plans: dict[int, tuple[int, list[tuple[int, int]]]] = {}

    def most(self, p: int) -> int:
        """Sets that link, the smaller one in class p, differ in so many shingles at most."""
        return int((self.den - self.num) * (math.exp((p + 1) * self.width) + math.exp((p + 2) * self.width)) / (self.den + self.num))

    def plan(self, p: int) -> tuple[int, list[tuple[int, int]]]:
        """(most(p), groupings as (groups, least shingles))."""
        if p not in self.plans:
            k, size = self.most(p), math.exp((p + 0.25) * self.width)

            def groups(least: int, upto: float) -> int | None:
                for g in range(k + 1, int(upto * (k + 1)) + 1):
                    rate = size / g
                    few = sum(math.exp(-rate) * rate**i / math.factorial(i) for i in range(least))
                    if g * (1 - few) - (g * few * (1 - few)) ** 0.5 >= k + 1:
                        return g
                return None

            out = []
            for least, upto in ((4, 1.15), (3, 1.15), (2, 1.2), (1, 2.0)):
                g = groups(least, upto)
                if g:
                    out = [(g, least), (int(1.3 * g) + 1, 1)]
                    break
            self.plans[p] = (k, out)
        return self.plans[p]

    def digests(self, h: np.ndarray) -> np.ndarray:
        """Of a set given as its sorted hashes."""
        n, out = len(h), []
        top = int(math.log(n) / self.width) if n and self.num < self.den else -1
        values = None
        for p in (top, top - 1):
            if p < 0:
                continue
            k, plan = self.plan(p)
            if k == 0:  # only equal sets
                continue
            for level, (groups, least) in enumerate(plan):
                own = (mix(h + np.uint64((p << 8) + level + 1)) % np.uint64(groups)).astype(np.int64)
                order = np.argsort(own, kind="stable")
                own = own[order]
                first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                if values is None:
                    values = mix(h ^ np.uint64(0xA0761D6478BD642F))
                sums = np.add.reduceat(values[order], first)
                full = np.diff(first, append=n) >= least
                place = own[first[full]].astype(np.uint64) + np.uint64((p << 40) + (level << 32))
                out.append(mix(sums[full] + mix(place)))
                if int(full.sum()) > k:
                    break
            else:
                out.append(mix(h[: n - -(-self.num * n // self.den) + 1] + np.uint64((p << 8) + 255)))
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(list(map(len, parts)))]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _scan(slim: DataFrame, size: int) -> DataFrame:
    """(row, doc_id, tx, n, d1, d2): a row's number, its text's hash, the size and digests of its set."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, d1, d2 = [], [], []
            for _, h in shingles(b.column("text"), size):
                n.append(len(h))
                d1.append(h.sum(dtype=np.uint64))
                d2.append(mix(h + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64))
            arrays = [pa.array(n, pa.int32()), *(pa.array(np.array(d, np.uint64).view(np.int64)) for d in (d1, d2))]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), b.column("tx"), *arrays], ["row", "doc_id", "tx", "n", "d1", "d2"])

    numbered = slim.select(F.monotonically_increasing_id().alias("row"), "doc_id", "tx", "text")
    return numbered.mapInArrow(tidy(rows), "row bigint, doc_id bigint, tx bigint, n int, d1 bigint, d2 bigint")


def _all_digests(slim: DataFrame, size: int, grouping: Grouping) -> DataFrame:
    """(digest) of all groups of all rows."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, held = [], 0
            for _, h in shingles(b.column("text"), size):
                out.append(grouping.digests(h))
                held += len(out[-1])
                if held > 1 << 18:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64))], ["digest"])
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64))], ["digest"])

    return slim.select("text").mapInArrow(tidy(rows), "digest bigint")


def _digests_in(slim: DataFrame, size: int, grouping: Grouping, bitmap: np.ndarray) -> DataFrame:
    """(doc_id, tx, point, digests) of the rows with digests in the map, these digests only."""
    shared = slim.sparkSession.sparkContext.broadcast(bitmap)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, points, digests = [], [], []
            for r, h in shingles(b.column("text"), size):
                own = grouping.digests(h)
                own = own[in_map(shared.value, own.view(np.int64))]
                if len(own):
                    at.append(r)
                    points.append(group_counts(h).tobytes())
                    digests.append(own)
            some = b.select(["doc_id", "tx"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(points, pa.binary()), _lists(digests)], ["doc_id", "tx", "point", "digests"])

    return slim.select("doc_id", "tx", "text").mapInArrow(tidy(rows), "doc_id bigint, tx bigint, point binary, digests array<bigint>")


def _bits(ids: np.ndarray, size: int) -> np.ndarray:
    return (mix(ids.view(np.uint64)) & np.uint64(size - 1)).astype(np.int64)


def membership_map(ids: DataFrame) -> np.ndarray:
    """A bit map of bounded size with the bits of all values of the one column, which are read twice.

    It only keeps other rows out of a pass: what it lets through besides is dropped by
    the join that follows, however full the map is.
    """
    size = min(MAP_BITS, 1 << (BITS_EACH * ids.count() + 1_024).bit_length())

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = np.unique(_bits(b.column(0).to_numpy(zero_copy_only=False), size))
            yield pa.RecordBatch.from_arrays([pa.array(bits >> 6), pa.array((np.uint64(1) << (bits & 63).astype(np.uint64)).view(np.int64))], ["word", "bit"])

    # At most size / 64 rows, however many values there are.
    table = ids.mapInArrow(tidy(words), "word bigint, bit bigint").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[table.column("word").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return out


def in_map(bitmap: np.ndarray, ids: np.ndarray) -> np.ndarray:
    bits = _bits(ids, len(bitmap) * 64)
    return (bitmap[bits >> 6] >> (bits & 63).astype(np.uint64)) & np.uint64(1) == 1


def picked(slim: DataFrame, column: str, ids: DataFrame, schema: str) -> DataFrame:
    """The rows of ``slim`` whose ``column`` is in the one column ``ids``, and few others."""
    shared = slim.sparkSession.sparkContext.broadcast(membership_map(ids))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pc.is_valid(b.column(column)))
            if b.num_rows:
                yield b.filter(pa.array(in_map(shared.value, b.column(column).to_numpy())))

    return slim.mapInArrow(tidy(rows), schema)


def _of_nodes(rows: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    """The rows that stand for a class, one each, with its ``key``."""
    r, n = rows.alias("r"), nodes.select("key", "doc_id", "tx").alias("n")
    same = F.col("r.doc_id").eqNullSafe(F.col("n.doc_id")) & (F.col("r.tx") == F.col("n.tx"))
    return r.join(n, same).select("n.key", *[f"r.{c}" for c in columns]).dropDuplicates(["key"])


def _buckets(scratch: Scratch, slim: DataFrame, nodes: DataFrame, size: int, grouping: Grouping) -> tuple[DataFrame, DataFrame]:
    """(digest, centre, blocks, key): the buckets with several members, equal buckets once; and (key, point)."""
    digests = scratch.table(_all_digests(slim, size, grouping).groupBy("digest").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("digest"), "digests")
    sets = scratch.table(_of_nodes(_digests_in(slim, size, grouping, membership_map(digests)), nodes, "point", "digests"), "sets")
    single = sets.select("key", F.explode("digests").alias("digest"))
    members = [F.bit_xor(F.xxhash64("key", F.lit(k))).alias(f"m{k}") for k in (1, 2)]
    whole = single.groupBy("digest").agg(F.count(F.lit(1)).alias("times"), F.min("key").alias("centre"), *members).where("times > 1")
    whole = whole.groupBy("times", "m1", "m2").agg(F.min(F.struct("digest", "centre")).alias("one"))
    whole = whole.select("one.*", F.ceil(F.col("times") / BLOCK).cast("int").alias("blocks"))
    return scratch.table(single.join(whole, "digest").select("digest", "centre", "blocks", "key"), "buckets"), sets.select("key", "point")


FOUND = "a bigint, b bigint, more boolean, digest bigint"


def _rows(pairs: list[tuple[int, int, bool]], digests: list[int]) -> pa.RecordBatch:
    """Found pairs, and the digests of buckets to look at again."""
    a, b, more = zip(*pairs, strict=True) if pairs else ((), (), ())
    none = len(digests)
    return pa.RecordBatch.from_arrays(
        [pa.array([*a, *[None] * none], pa.int64()), pa.array([*b, *[None] * none], pa.int64()), pa.array([*more, *[False] * none], pa.bool_()), pa.array([*[None] * len(pairs), *digests], pa.int64())],
        ["a", "b", "more", "digest"],
    )


def _dealt(rows: DataFrame, points: DataFrame) -> DataFrame:
    return rows.join(points, "key").repartition("digest", "block").sortWithinPartitions("digest", "block", "asks", "key")


def _points(rows: list[dict]) -> np.ndarray:
    return np.stack([np.frombuffer(r["point"], "u1" if len(r["point"]) == GROUPS else "<u4").astype(np.int64) for r in rows])


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, dict | None]]:
    """(whether a new bucket or block begins, row), and a last (True, None)."""
    key = None
    for b in batches:
        for at in range(0, b.num_rows, 512):
            for r in b.slice(at, 512).to_pylist():
                fresh = (r["digest"], r["block"]) != key
                key = (r["digest"], r["block"])
                yield fresh, r
    yield True, None


def _first_search(buckets: DataFrame, points: DataFrame, num: int, den: int) -> DataFrame:
    """Candidates (a, b), and as ``digest`` the buckets whose members were not all compared.

    In each block the members ask in order of their sizes, those left out that were found already.
    The centre of a bucket of several blocks is put into all of them.
    """
    own = F.pmod(F.xxhash64("key"), "blocks").cast("int")
    block = F.when((F.col("blocks") > 1) & (F.col("key") == F.col("centre")), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))
    dealt = _dealt(buckets.select("digest", F.explode(block).alias("block"), (F.col("key") != F.col("centre")).alias("asks"), "key", "blocks"), points)

    def pairs(members: list[dict]) -> tuple[list[tuple[int, int, bool]], list[int]]:
        if len(members) < 2:
            return [], []
        own = _points(members)
        tree = CountRTree(own, num, den)
        waiting, found_at_all, out = np.ones(len(members), bool), np.zeros(len(members), bool), []
        skipped = False
        # The centre stands first, then by size.
        for i in [0, *(k for k in tree.order.tolist() if k)]:
            if waiting[i]:
                found, _ = tree.search(own[i])
                me = members[i]["key"]
                out += [(min(me, x), max(me, x), False) for x in (members[k]["key"] for k in found.tolist() if k != i and not found_at_all[k])]
                skipped |= bool(found_at_all[found[found != i]].any())
                waiting[found] = False
                found_at_all[found[found != i]] = True
        # Pairs are missing where a found member was left out, or where two of them were: neither asks.
        return out, [members[0]["digest"]] if members[0]["blocks"] > 1 or skipped or found_at_all.sum() > 1 else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        out: dict[tuple[int, int, bool], None] = {}
        again: list[int] = []
        for fresh, r in _grouped(batches):
            if fresh:
                found, digest = pairs(held)
                out.update(dict.fromkeys(found))
                again += digest
                held = []
                if r is None or len(out) + len(again) > 8_192:
                    yield _rows(list(out), again)
                    out, again = {}, []
            held.append(r)

    return dealt.mapInArrow(tidy(run), FOUND)


def _further_search(scratch: Scratch, buckets: DataFrame, points: DataFrame, again: DataFrame, labels: DataFrame, tested: DataFrame, num: int, den: int, most: int | None, lot: int | None) -> DataFrame | None:
    """Candidates (a, b, more) of members in another component than their bucket's centre, with all other members; None if
    there are no such members.

    Askers go to all blocks of their bucket. With a ``lot`` a member asks in one of its buckets only, since groups of near
    copies share many; a search without one follows. With ``most``, a member gets only so many of the best of each component
    in a block, and ``more`` tells that others were left for a later search. ``tested`` pairs are not found again (of a member
    with more than ``KNOWN`` of them some are; they go before anything is verified).
    """
    label = labels.select(F.col("node").alias("key"), "component")
    centre = labels.select(F.col("node").alias("centre"), F.col("component").alias("top"))
    m = buckets.join(again, "digest", "left_semi").join(label, "key", "left").join(centre, "centre", "left")
    m = m.withColumns({"component": F.coalesce("component", "key"), "top": F.coalesce("top", "centre")})
    m = scratch.table(m.select("digest", "blocks", "key", "component", (F.col("component") != F.col("top")).alias("asks")), "asking")
    asking = m.where("asks")
    if lot is not None:
        asking = asking.join(asking.groupBy("key").agg(F.min_by("digest", F.xxhash64("digest", F.lit(lot))).alias("digest")), ["key", "digest"], "left_semi")
    both = tested.select(F.col("a").alias("key"), "b").union(tested.select("b", "a"))
    known = both.join(asking.select("key").distinct(), "key", "left_semi").join(label.select(F.col("key").alias("b"), F.col("component").alias("cb")), "b", "left").join(label, "key", "left")
    known = known.where("coalesce(component, key) <> coalesce(cb, b)").withColumn("n", F.row_number().over(W.partitionBy("key").orderBy("b"))).where(F.col("n") <= KNOWN)
    asking = scratch.table(asking.join(known.groupBy("key").agg(F.collect_list("b").alias("known")), "key", "left"), "askers")
    if asking.isEmpty():
        return None
    m = m.join(asking.select("digest").distinct(), "digest", "left_semi")
    stored = m.select("digest", F.pmod(F.xxhash64("key"), "blocks").cast("int").alias("block"), F.lit(False).alias("asks"), "key", "component", F.lit(None).cast("array<bigint>").alias("known"))
    asking = asking.select("digest", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "asks", "key", "component", "known")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members: list[dict] = []
        tree = None
        out: dict[tuple[int, int, bool], None] = {}
        for fresh, r in _grouped(batches):
            if fresh:
                members, tree = [], None
            if r is None or len(out) > 8_192:
                yield _rows(list(out), [])
                out = {}
            if r is None:
                break
            if not r["asks"]:
                members.append(r)
                continue
            if not members:
                continue
            tree = tree or CountRTree(_points(members), num, den)
            found: dict[int, list[tuple[int, int]]] = {}
            before = set(r["known"] or ())
            for i, bound in zip(*(x.tolist() for x in tree.search(_points([r])[0])), strict=True):
                x = members[i]
                if x["component"] != r["component"] and x["key"] not in before:
                    found.setdefault(x["component"], []).append((-bound, x["key"]))
            for own in found.values():
                for _, x in sorted(own)[:most]:
                    out[min(r["key"], x), max(r["key"], x), most is not None and len(own) > most] = None

    found = _dealt(stored.union(asking), points).mapInArrow(tidy(run), FOUND)
    return found.groupBy("a", "b").agg(F.max("more").alias("more"))


def word_set(text: str | None, size: int) -> set[tuple[bytes, ...]]:
    """A text's shingles as words."""
    w = WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
    if len(w) >= size:
        return set(zip(*(w[k:] for k in range(size)), strict=False))
    return {tuple(w)} if w else set()


def _verified(scratch: Scratch, pairs: DataFrame, slim: DataFrame, nodes: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets of words reach the threshold."""
    ids = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    chosen = scratch.table(nodes.join(ids, "key", "left_semi").select("key", "doc_id", "tx"), "chosen")
    near = picked(slim.select("doc_id", "tx", "text"), "tx", chosen.select("tx"), "doc_id bigint, tx bigint, text string")
    texts = scratch.table(_of_nodes(near, chosen, "text"), "texts")
    both = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[int, set] = OrderedDict()

        def own(key: int, text: str) -> set:
            if key not in known:
                known[key] = word_set(text, size)
                while len(known) > 8:
                    known.popitem(last=False)
            known.move_to_end(key)
            return known[key]

        for b in (whole.slice(at, 64) for whole in batches for at in range(0, whole.num_rows, 64)):
            linked = []
            for r in b.to_pylist():
                x, y = own(r["a"], r["ta"]), own(r["b"], r["tb"])
                shared = len(x & y)
                linked.append(den * shared >= num * (len(x) + len(y) - shared))
            yield b.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return both.select("a", "b", "ta", "tb").mapInArrow(tidy(rows), "a bigint, b bigint")


def _linked(docs: DataFrame, size: int, num: int, den: int, id_col: str, text: str) -> DataFrame:
    """Per row: row (its number in this scan), doc_id, tx, n, component (the smallest row number in it)."""
    slim = docs.select(named(id_col).cast("long").alias("doc_id"), named(text).alias("text")).withColumn("tx", F.xxhash64("text"))
    grouping = Grouping(num, den)
    with Scratch(docs.sparkSession) as scratch:
        scan = scratch.table(_scan(slim, size), "scan")
        nodes = scan.where("n > 0").groupBy("d1", "d2", "n").agg(F.min(F.struct("row", "doc_id", "tx")).alias("one"))
        nodes = scratch.table(nodes.select("d1", "d2", "n", F.col("one.row").alias("key"), "one.doc_id", "one.tx"), "nodes")
        buckets, points = _buckets(scratch, slim, nodes, size, grouping)
        found = scratch.table(_first_search(buckets, points, num, den), "found")
        again = scratch.table(found.where("digest is not null").select("digest").distinct(), "again")
        waiting = scratch.table(found.where("a is not null").select("a", "b").distinct(), "pairs")
        pairs, labels = waiting.limit(0), components(waiting.limit(0))

        def tested(more: DataFrame) -> DataFrame:
            # What is known already goes on as one link from each node to its component.
            joined = labels.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
            return components(scratch.table(joined.union(_verified(scratch, more, slim, nodes, size, num, den)), "links"))

        def apart(some: DataFrame) -> DataFrame:
            """Pairs of different components that were not tested yet."""
            of = lambda side: labels.select(F.col("node").alias(side), F.col("component").alias("c" + side))
            out = some.join(pairs, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left")
            return scratch.table(out.where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b"), "apart")

        # First one pair a member at a time, then all that still join two components.
        for k in range(FIRST_ROUNDS + 1):
            waiting = apart(waiting)
            if waiting.isEmpty():
                break
            some = waiting if k == FIRST_ROUNDS else scratch.table(waiting.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "first-pairs")
            labels = tested(some)
            pairs = pairs.union(some)
        for most, lot in ((BEST, 0), (BEST, None), (None, None)):
            searched = _further_search(scratch, buckets, points, again, labels, pairs, num, den, most, lot)
            if searched is None:
                break
            searched = scratch.table(searched, "searched")
            # Before known pairs go: what a member's best candidates left out counts even if all of them were tested already.
            more = not searched.where("more").isEmpty()
            rest = apart(searched.select("a", "b"))
            if not rest.isEmpty():
                labels = tested(rest)
                pairs = pairs.union(rest)
            if lot is None and not more:
                break
        by_class = nodes.join(labels.withColumnRenamed("node", "key"), "key", "left").select("d1", "d2", "n", F.coalesce("component", "key").alias("component"))
        linked = scan.where("n > 0").join(by_class, ["d1", "d2", "n"]).select("row", "doc_id", "tx", "n", "component")
        alone = scan.where("n = 0").select("row", "doc_id", "tx", "n", F.col("row").alias("component"))
        return materialize(linked.union(alone), "linked")


def near_duplicates(docs: DataFrame, size: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id.

    Documents link when ``den * |A & B| >= num * |A | B|`` for their sets of ``size``-word shingles.
    """
    linked = _linked(docs, size, num, den, id_col, text)
    names = linked.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return linked.join(names, "component").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def keep_first(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each component the row with the smallest id, with all its columns, whatever their names.

    Rows without an id come last; of rows with one id and text any is the one that stays.
    Texts without words link with nothing, so their rows all stay.
    """
    linked = _linked(docs, size, num, den, id_col, text).where("n > 0")
    id_ = F.coalesce("doc_id", F.lit(LAST))
    firsts = linked.groupBy("component").agg(F.min(F.struct(id_.alias("id"), "tx")).alias("one")).select("one.*")
    rows = docs.select(F.struct(*map(named, docs.columns)).alias("row"))
    field = F.col("row").getField
    words = F.coalesce(field(text).rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    kept = rows.where(words).select("row", F.coalesce(field(id_col).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(field(text)).alias("tx"))
    kept = kept.join(firsts, ["id", "tx"]).dropDuplicates(["id", "tx"])
    return kept.select("row.*").union(rows.where(~words).select("row.*"))
