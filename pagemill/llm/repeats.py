"""Removal of long byte strings that stand earlier in the corpus, by suffix sorting.

A removed byte lies in a ``LENGTH``-byte string that also starts earlier (in a document
with a smaller id, or before in the same one).

1. Texts equal as a whole are grouped by SHA-256; all but the first are removed whole.
2. Every ``LENGTH``-byte window has a minimizer, the smallest hash among its
   ``GRAM``-byte strings; equal windows have equal minimizers, and neighbouring windows
   mostly share one. Only minimizers that occur twice or more can belong to repeated
   windows. They are found by one pre-aggregated count and one join of plain numbers.
3. Runs of windows with such a minimizer are cut out as short strings and counted once
   each, with their first place. Those of one minimizer meet in one task, which sorts
   their suffixes in two stages: suffixes smaller than their successors are sorted
   directly, the others are induced from them by scanning the buckets of first bytes.
   Adjacent common prefixes of ``LENGTH`` bytes or more make a class of equal windows,
   whose first place stays.
4. Each document then drops what its repeated windows cover, except its first places.

A minimizer of more than ``HOT`` documents (a passage in many of them, each time between
other words) is dealt out further: its windows go by how far they reach beyond the
minimizer's string on their shorter side, in steps of doubling length, and by the bytes of
that reach which all windows of the step have. Equal windows stay together; what stands
between other words parts, and short reaches have few different strings.

No text is sent anywhere but those of documents with repeated minimizers, which a
fixed-size bit map picks out (the map only saves work; joins decide).

Defined results: null counts as empty; texts shorter than ``LENGTH`` lose nothing. A
document is an id with a text: rows that share both are one document and get the same
result, and of rows that share an id only, one text counts as the earlier (by its hash).
Rows without an id come after all others. Other columns, whatever their names, are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jaccard import LAST, in_map, membership_map, picked
from .runtime import Scratch, materialize, named, tidy
from .textscan import chunks, prefix_hash, span_hash

LENGTH = 100
GRAM = 32
CHUNK = 1 << 19
#: Bytes of cut-out strings that are sorted at once.
SORT_BYTES = 2 << 20
#: Documents with a minimizer beyond which it is dealt out further.
HOT = 256
PLACE_BITS = np.uint64((1 << 24) - 1)


def runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first window, last window, minimizer, its place) of all runs of windows, in order; places are in ``data``."""
    none = np.zeros(0, np.int64)
    total = len(data)
    if total < length:
        return none, none, none, none.astype(np.uint64), none
    grams = total - gram + 1
    at = np.arange(grams)
    hashes = span_hash(prefix_hash(data), at, at + gram)
    least = (hashes & ~PLACE_BITS) | (at.astype(np.uint64) & PLACE_BITS)
    span, done = length - gram + 1, 1
    while 2 * done <= span:
        least = np.minimum(least[: len(least) - done], least[done:])
        done *= 2
    if span > done:
        least = np.minimum(least[: len(least) - (span - done)], least[span - done :])
    windows = total - length + 1
    inside = np.zeros(windows, bool)
    row_of = np.zeros(windows, np.int64)
    for r in np.flatnonzero(np.diff(offsets) >= length):
        a, b = offsets[r], offsets[r + 1] - length + 1
        inside[a:b] = True
        row_of[a:b] = r
    start = np.flatnonzero(inside)
    place = start + ((least[start] - start.astype(np.uint64)) & PLACE_BITS).astype(np.int64)
    fresh = np.ones(len(start), bool)
    fresh[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1) | (row_of[start[1:]] != row_of[start[:-1]])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(start)) - 1
    return row_of[start[first]], start[first], start[last], hashes[place[first]], place[first]


def _words_at(text: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as numbers that sort like them."""
    out = np.zeros(len(places), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | text[places + k]
    return out


def _sort_directly(text: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """``places`` by their next ``depth`` bytes: eight at a time, ties only."""
    order = places
    group = np.zeros(len(order), np.int64)
    live = np.arange(len(order))  # where in the order ties are left
    for at in range(0, depth, 8):
        if not len(live):
            break
        keys = _words_at(text, order[live] + at)
        by = np.lexsort((keys, group[live]))
        order[live] = order[live][by]
        keys, own = keys[by], group[live]
        fresh = np.ones(len(live), bool)
        fresh[1:] = (keys[1:] != keys[:-1]) | (own[1:] != own[:-1])
        group[live] = np.cumsum(fresh) - 1
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        live = live[tied]
    return order


def sort_suffixes(text: np.ndarray, wanted: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """The ``wanted`` places (a mask) by what follows them, to ``depth`` bytes, in two stages.

    A suffix is small if it is smaller than its successor. Small ones are sorted directly.
    Scanning the buckets of first bytes upwards, each suffix then puts its large
    predecessor at the front of that one's bucket. The scan needs each large suffix's
    successor, so the wanted places are extended up to the next small suffix.
    """
    n = len(text)
    text = np.concatenate([text, np.array([0, 255], np.uint8), np.zeros(depth + 16, np.uint8)])
    change = np.flatnonzero(text[: n + 1] != text[1 : n + 2])
    after = change[np.searchsorted(change, np.arange(n + 1))]
    small = text[after] < text[after + 1]
    # Extend to the right, up to and with the next small suffix.
    smalls = np.flatnonzero(small)
    member = np.zeros(n + 2, np.int64)
    at = np.flatnonzero(wanted)
    np.add.at(member, at, 1)
    np.add.at(member, smalls[np.searchsorted(smalls, at)] + 1, -1)
    member = np.cumsum(member)[: n + 1] > 0
    direct = _sort_directly(text, np.flatnonzero(member & small), depth)
    bounds = np.searchsorted(text[direct], np.arange(257))
    large = member & ~small
    buckets: list[list[np.ndarray]] = [[] for _ in range(256)]
    out: list[np.ndarray] = []

    def scan(found: np.ndarray) -> None:
        out.append(found)
        before = found - 1
        before = before[before >= 0]
        before = before[large[before]]
        if len(before):
            letters = text[before]
            by = np.argsort(letters, kind="stable")
            before, letters = before[by], letters[by]
            cut = np.flatnonzero(np.diff(letters)) + 1
            for part in np.split(before, cut):
                buckets[text[part[0]]].append(part)

    for c in range(256):
        k = 0
        while k < len(buckets[c]):  # equal letters in a row add to the bucket being scanned
            scan(buckets[c][k])
            k += 1
        buckets[c] = []
        scan(direct[bounds[c] : bounds[c + 1]])
    order = np.concatenate(out)
    return order[np.append(wanted, np.zeros(n + 1 - len(wanted), bool))[order]]


def common_prefix_reached(text: np.ndarray, order: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Whether each place in the order shares ``length`` bytes with the one before."""
    text = np.concatenate([text, np.zeros(16, np.uint8)])
    same = np.ones(len(order), bool)
    if len(order):
        same[0] = False
    live = np.flatnonzero(same)
    for at in [*range(0, length - 7, 8), length - 8]:
        equal = _words_at(text, order[live] + at) == _words_at(text, order[live - 1] + at)
        same[live[~equal]] = False
        live = live[equal]
    return same


def first_places(strings: list[bytes], ids: np.ndarray, texts: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(id, text, first window, last window) of the windows that stand nowhere earlier in ``strings``."""
    sizes = np.array(list(map(len, strings)), np.int64)
    text = np.frombuffer(b"\0".join(strings), np.uint8)
    heads = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    windows = sizes - length + 1
    of = np.repeat(np.arange(len(strings)), windows)
    offset = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
    place = heads[of] + offset
    wanted = np.zeros(len(text), bool)
    wanted[place] = True
    order = sort_suffixes(text, wanted, length)
    new = ~common_prefix_reached(text, order, length)
    number = np.zeros(len(text), np.int64)
    number[place] = np.arange(len(place))
    index = number[order]
    start = starts[of[index]] + offset[index]
    kind = np.cumsum(new)
    by = np.lexsort((start, texts[of[index]], ids[of[index]], kind))
    leads = np.ones(len(by), bool)
    leads[1:] = kind[by][1:] != kind[by][:-1]
    first = np.zeros(len(place), bool)
    first[index[by[leads]]] = True
    at = np.flatnonzero(first)
    fresh = np.ones(len(at), bool)
    fresh[1:] = (at[1:] != at[:-1] + 1) | (of[at[1:]] != of[at[:-1]])
    a = np.flatnonzero(fresh)
    b = np.append(a[1:], len(at)) - 1
    return ids[of[at[a]]], texts[of[at[a]]], starts[of[at[a]]] + offset[at[a]], starts[of[at[b]]] + offset[at[b]]


def _marks(slim: DataFrame) -> DataFrame:
    """(id, tx, marks): each document's minimizers, those of several places twice."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, to, data, offsets in chunks(b.column("text"), CHUNK):
                row, _, _, mark, _ = runs(data, offsets)
                by = np.lexsort((mark, row))
                row, mark = row[by], mark[by]
                same = np.zeros(len(row), np.int64)
                same[1:] = (row[1:] == row[:-1]) & (mark[1:] == mark[:-1])
                third = same.copy()
                third[1:] &= same[:-1]
                row, mark = row[third == 0], mark[third == 0]
                cut = np.searchsorted(row, np.arange(to - at + 1)).astype(np.int32)
                own = b.select(["id", "tx"]).slice(at, to - at)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.ListArray.from_arrays(pa.array(cut), pa.array(mark.view(np.int64)))], ["id", "tx", "marks"])

    return slim.mapInArrow(tidy(rows), "id bigint, tx bigint, marks array<bigint>")


def _in_map(marks: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """The documents with marks in the map, these marks only."""
    shared = marks.sparkSession.sparkContext.broadcast(bitmap)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("marks")
            flat = column.flatten().to_numpy()
            found = in_map(shared.value, flat)
            offsets = column.offsets.to_numpy() - column.offsets[0].as_py()
            upto = np.concatenate([[0], np.cumsum(found)])[offsets].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(upto), pa.array(flat[found]))
            some = pa.array(np.diff(upto) > 0)
            yield pa.RecordBatch.from_arrays([*b.select(["id", "tx"]).columns, lists], ["id", "tx", "marks"]).filter(some)

    return marks.mapInArrow(tidy(rows), "id bigint, tx bigint, marks array<bigint>")


def _marked_runs(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, its bytes, first windows, last windows, minimizers, their places) of the runs whose minimizer is in ``marks``."""
    marks = b.column("marks")
    for at, to, data, offsets in chunks(b.column("text"), CHUNK):
        row, first, last, mark, place = runs(data, offsets)
        cut = np.searchsorted(row, np.arange(to - at + 1))
        for r in range(to - at):
            own = slice(cut[r], cut[r + 1])
            known = np.sort(marks[at + r].values.to_numpy().view(np.uint64))
            hit = known[np.minimum(np.searchsorted(known, mark[own]), len(known) - 1)] == mark[own]
            yield at + r, data[offsets[r] : offsets[r + 1]], first[own][hit] - offsets[r], last[own][hit] - offsets[r], mark[own][hit], place[own][hit] - offsets[r]


#: Windows by their shorter reach beyond the minimizer's string: (least, most).
STEPS = tuple((a, min(2 * a - 1, (LENGTH - GRAM) // 2) if a else 0) for a in (0, 1, 2, 4, 8, 16, 32))


def dealt_out(text: bytes, first: int, last: int, mark: int, place: int) -> Iterator[tuple[int, int, int]]:
    """(key, first window, last window): a hot minimizer's run in parts; equal windows have equal keys."""
    over = LENGTH - GRAM
    for least, most in STEPS:
        # Right reach of a window at w: w + over - place; left reach: place - w.
        for side, a, z, reach in (
            (0, place - over + least, place - over + most, text[place + GRAM : place + GRAM + least]),
            (1, place - min(most, (over - 1) // 2), place - least, text[place - least : place]),
        ):
            a, z = max(a, first), min(z, last)
            if a <= z:
                key = hashlib.blake2b(reach, digest_size=8, key=b"%d,%d,%d" % (mark, side, least)).digest()
                yield int.from_bytes(key, "little", signed=True), a, z


def _cut_out(marked: DataFrame) -> DataFrame:
    """(mark, string, id, tx, start) of the marked runs, each string once a document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, hot = (b.column(c).to_pylist() for c in ("id", "tx", "hot"))
            out: list[tuple[int, bytes, int, int, int]] = []
            for r, data, first, last, mark, place in _marked_runs(b):
                whole, hot_ones = data.tobytes(), set(hot[r])
                for a, z, m, p in zip(first.tolist(), last.tolist(), mark.view(np.int64).tolist(), place.tolist(), strict=True):
                    for key, x, y in dealt_out(whole, a, z, m, p) if m in hot_ones else ((m, a, z),):
                        out.append((key, whole[x : y + LENGTH], ids[r], texts[r], x))
            types = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], ["mark", "string", "id", "tx", "start"])

    return marked.mapInArrow(tidy(rows), "mark bigint, string binary, id bigint, tx bigint, start bigint")


def _first_windows(cuts: DataFrame) -> DataFrame:
    """(id, tx, a, b): ranges of windows that stand nowhere earlier."""
    once = cuts.groupBy("mark", "string").agg(F.min(F.struct("id", "tx", "start")).alias("at"))
    dealt = once.select("mark", "string", "at.id", "at.tx", "at.start").repartition("mark").sortWithinPartitions("mark")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def sorted_out(t: pa.RecordBatch) -> pa.RecordBatch:
            found = first_places(t.column("string").to_pylist(), *(t.column(c).to_numpy() for c in ("id", "tx", "start")))
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["id", "tx", "a", "b"])

        def joined() -> pa.RecordBatch:
            return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.nbytes
            if size > SORT_BYTES:
                t = joined()
                marks = t.column("mark").to_numpy()
                whole = int(np.searchsorted(marks, marks[-1]))  # the last mark may go on
                if whole:
                    yield sorted_out(t.slice(0, whole))
                    held, size = [t.slice(whole)], t.slice(whole).nbytes
        if held:
            yield sorted_out(joined())

    return dealt.mapInArrow(tidy(rows), "id bigint, tx bigint, a bigint, b bigint")


def removed_mask(size: int, first: np.ndarray, last: np.ndarray, keep: list[tuple[int, int]], length: int = LENGTH) -> np.ndarray:
    """The bytes covered by windows in the ranges, those to keep left out."""
    step = np.zeros(size + 1, np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, last + 1, -1)
    windows = np.cumsum(step)[:size] > 0
    for a, b in keep:
        windows[a : b + 1] = False
    upto = np.concatenate([[0], np.cumsum(windows)])
    at = np.arange(1, size + 1)
    return upto[at] - upto[np.maximum(at - length, 0)] > 0


def _edited(marked: DataFrame) -> DataFrame:
    """(id, tx, n_removed, n_spans, kept_sha256, kept) of the marked documents that lose bytes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, keeps = (b.column(c).to_pylist() for c in ("id", "tx", "keep"))
            out: list[tuple] = []
            for r, data, first, last, _, _ in _marked_runs(b):
                gone = removed_mask(len(data), first, last, [(x["a"], x["b"]) for x in keeps[r] or ()])
                if gone.any():
                    kept = data[~gone].tobytes()
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    out.append((ids[r], texts[r], int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = zip(*out, strict=True) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], ["id", "tx", "n_removed", "n_spans", "kept_sha256", "kept"])

    return marked.mapInArrow(tidy(rows), "id bigint, tx bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept string")


def _edits(slim: DataFrame, bytes_too: bool) -> DataFrame:
    """Per row of ``(doc_id, text)``: id, tx, n_bytes, sha, copy (an earlier document has the whole text), and its edit if any."""
    with Scratch(slim.sparkSession) as scratch:
        text = F.coalesce("text", F.lit(""))
        slim = slim.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("id"), F.xxhash64("text").alias("tx"), "text")
        sizes = materialize(slim.select("doc_id", "id", "tx", F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(text, 256)).alias("sha")), "sizes")
        firsts = sizes.groupBy("sha").agg(F.min(F.struct("id", "tx", "n_bytes")).alias("one"))
        slim = slim.where(F.octet_length("text") >= LENGTH).select("id", "tx", "text")
        marks = scratch.table(_marks(slim).join(firsts.where(F.col("one.n_bytes") >= LENGTH).select("one.id", "one.tx"), ["id", "tx"], "left_semi"), "marks")
        twice = scratch.table(marks.select(F.explode("marks").alias("mark")).groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "twice")
        single = _in_map(marks, membership_map(twice.select("mark"))).select("id", "tx", F.explode("marks").alias("mark"))
        hot = F.collect_set(F.when(F.col("n") > HOT, F.col("mark")))
        flags = scratch.table(single.join(twice, "mark").groupBy("id", "tx").agg(F.collect_set("mark").alias("marks"), hot.alias("hot")), "flags")
        marked = picked(slim, "tx", flags.select("tx"), "id bigint, tx bigint, text string").join(flags, ["id", "tx"])
        keep = scratch.table(_first_windows(_cut_out(marked)), "first-windows").groupBy("id", "tx").agg(F.collect_list(F.struct("a", "b")).alias("keep"))
        edited = _edited(marked.join(keep, ["id", "tx"], "left")).dropDuplicates(["id", "tx"])
        edits = materialize(edited if bytes_too else edited.drop("kept"), "edits")
        both = sizes.join(firsts.select("sha", F.col("one.id").alias("first")), "sha").join(edits, ["id", "tx"], "left")
        return both.withColumn("copy", (F.col("id") > F.col("first")) & (F.col("n_bytes") >= LENGTH))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    out = _edits(docs.select(named(id_col).alias("doc_id"), named(text).alias("text")), False)
    none = hashlib.sha256(b"").hexdigest()
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(F.col("copy"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("copy"), F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("copy"), F.lit(none)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The documents with repeats cut out of their text, with all their columns, whatever their names.

    Cut characters' remaining bytes are dropped, ``n_chars`` follows where the column
    exists, and a document all of whose bytes go stays as an empty text.
    """
    out = _edits(docs.select(named(id_col).alias("doc_id"), named(text).alias("text")), True)
    out = out.where(F.col("copy") | F.col("kept").isNotNull()).select("id", "tx", F.when(F.col("copy"), F.lit("")).otherwise(F.col("kept")).alias("kept")).dropDuplicates(["id", "tx"])
    field = F.col("row").getField
    rows = docs.select(F.struct(*map(named, docs.columns)).alias("row"))
    rows = rows.select("row", F.coalesce(field(id_col), F.lit(LAST)).alias("id"), F.xxhash64(field(text)).alias("tx"))
    both = rows.join(out, ["id", "tx"], "left")
    fresh = {text: F.col("kept")}
    if n_chars in docs.columns:
        fresh[n_chars] = F.length("kept").cast(docs.schema[n_chars].dataType)
    return both.select(*[F.when(F.col("kept").isNull(), field(c)).otherwise(fresh[c]).alias(c) if c in fresh else field(c).alias(c) for c in docs.columns])
