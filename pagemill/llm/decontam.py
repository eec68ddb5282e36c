"""Benchmark decontamination with a positional inverted index of the documents.

Indexing is one narrow pass: each document becomes its own slice of the index, a row
with the places of every benchmark term in it (gaps between places, so that Parquet
packs them), written to the shared folder. A hot term's postings are thus spread over
all slices. The terms' total counts come from the index; they order each window's
terms from the rarest up.

Look-up is a second narrow pass, over the index alone: a window is tried only where
its rarest term stands; the postings of its other terms, moved by their offsets, are
intersected with the candidates until none is left or all agree. With a ``slop`` above
0 a term may be so many words off its place, which gives proximity matches.

Benchmarks go to the tasks in blocks of at most ``BLOCK_CHARS`` characters, so what is
broadcast has a bound; the blocks' matches meet by document.

Defined results: null has no words; items or documents without words match nothing;
rows with one item_id count as one item; a null item_id is written as an empty string;
repeated documents are judged alike; other columns are ignored; with an empty
benchmark no document is hit; an empty documents table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import keyed, materialize, named, tidy

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 13
BLOCK_CHARS = 16_000_000
#: Rows whose words or postings are Python objects at once.
ROWS = 512


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


class Windows:
    """A block of items: their terms, and their windows by the rarest term."""

    def __init__(self, items: list[tuple[int | None, str | None]], size: int = WINDOW) -> None:
        self.terms: dict[bytes, int] = {}
        self.items: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.terms.setdefault(w, len(self.terms)) for w in words_of(text)]
            for k in range(max(len(ids) - size + 1, 1) if ids else 0):
                self.items.setdefault(tuple(ids[k : k + size]), set()).add("" if item is None else str(item))

    def by_rarest(self, counts: dict[int, int]) -> dict[int, list[tuple[int, list[tuple[int, int]], int, set[str]]]]:
        """rarest term -> (its offset, the others rarest first as (term, offset), words, items)."""
        out: dict[int, list] = {}
        for window, items in self.items.items():
            if all(t in counts for t in window):
                order = sorted(range(len(window)), key=lambda o: (counts[window[o]], o))
                rarest = window[order[0]]
                out.setdefault(rarest, []).append((order[0], [(window[o], o) for o in order[1:]], len(window), items))
        return out


INDEX = "doc_id bigint, digest bigint, n_words int, terms array<int>, counts array<int>, gaps array<int>"


def build_index(slim: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """A row per document with the places of each of ``terms`` in it."""
    shared = slim.sparkSession.sparkContext.broadcast(terms)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                digests, n_words, term_lists, count_lists, gap_lists = [], [], [], [], []
                for x in part.column("text"):
                    text = x.as_py() or ""
                    words = words_of(text)
                    ids = np.fromiter((known.get(w, -1) for w in words), np.int32, len(words))
                    places = np.flatnonzero(ids >= 0)
                    order = places[np.argsort(ids[places], kind="stable")]
                    own, first, counts = np.unique(ids[order], return_index=True, return_counts=True)
                    gaps = np.diff(order, prepend=0)
                    gaps[first] = order[first]
                    digests.append(int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True))
                    n_words.append(len(words))
                    term_lists.append(own)
                    count_lists.append(counts.astype(np.int32))
                    gap_lists.append(gaps.astype(np.int32))
                arrays = [part.column("doc_id").cast(pa.int64()), pa.array(digests, pa.int64()), pa.array(n_words, pa.int32())]
                arrays += [pa.array(x, pa.list_(pa.int32())) for x in (term_lists, count_lists, gap_lists)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "digest", "n_words", "terms", "counts", "gaps"])

    return slim.mapInArrow(tidy(rows), INDEX)


class Postings:
    """One document's slice of the index."""

    def __init__(self, terms: list[int], counts: list[int], gaps: np.ndarray) -> None:
        self.at = dict(zip(terms, np.cumsum([0, *counts[:-1]]).tolist() if counts else [], strict=True))
        self.n = dict(zip(terms, counts, strict=True))
        self.gaps = gaps
        self.lists: dict[int, list[int]] = {}
        self.sets: dict[int, set[int]] = {}

    def places(self, t: int) -> list[int]:
        if t not in self.lists:
            self.lists[t] = np.cumsum(self.gaps[self.at[t] : self.at[t] + self.n[t]]).tolist()
        return self.lists[t]

    def starts(self, rarest: int, offset: int, others: list[tuple[int, int]], slop: int) -> list[int]:
        if any(t not in self.at for t, _ in others):
            return []
        found = [p - offset for p in self.places(rarest)]
        for t, o in others:
            if not found:
                break
            if slop:
                places = self.places(t)
                found = [s for s in found if (k := bisect_left(places, s + o - slop)) < len(places) and places[k] <= s + o + slop]
            else:
                own = self.sets.get(t)
                if own is None:
                    own = self.sets[t] = set(self.places(t))
                found = [s for s in found if s + o in own]
        return found


def look_up(index: DataFrame, windows: Windows, slop: int = 0) -> DataFrame:
    """(doc_id, digest, n_words, starts, lengths, items) of every row of the index."""
    counted = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy("t.terms").agg(F.sum("t.counts").alias("n"))
    # One row for each term of the block at most.
    counts = {r.terms: r.n for r in counted.collect()}
    shared = index.sparkSession.sparkContext.broadcast(windows.by_rarest(counts))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            starts, lengths, items = [], [], []
            term_lists, count_lists = b.column("terms").to_pylist(), b.column("counts").to_pylist()
            for k in range(b.num_rows):
                hits: set[tuple[int, int]] = set()
                own: set[str] = set()
                if any(t in table for t in term_lists[k]):
                    postings = Postings(term_lists[k], count_lists[k], b.column("gaps")[k].values.to_numpy())
                    for t in term_lists[k]:
                        for offset, others, size, names in table.get(t, ()):
                            found = postings.starts(t, offset, others, slop)
                            if found:
                                hits.update((s, size) for s in found)
                                own |= names
                ordered = sorted(hits)
                starts.append([s for s, _ in ordered])
                lengths.append([n for _, n in ordered])
                items.append(sorted(own))
            arrays = [b.column("doc_id"), b.column("digest"), b.column("n_words"), pa.array(starts, pa.list_(pa.int32())), pa.array(lengths, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "digest", "n_words", "starts", "lengths", "items"])

    return index.mapInArrow(tidy(rows), "doc_id bigint, digest bigint, n_words int, starts array<int>, lengths array<int>, items array<string>")


def covered(starts: list[int], lengths: list[int]) -> int:
    """Words inside any of the stretches."""
    total = upto = 0
    for s, n in sorted(zip(starts, lengths, strict=True)):
        total += max(0, s + n - max(s, upto))
        upto = max(upto, s + n)
    return total


def blocks_of(benchmark: DataFrame, item_col: str = "item_id", text: str = "text") -> Iterator[list[tuple[int | None, str | None]]]:
    """The items, streamed to the driver a block at a time."""
    block: list[tuple[int | None, str | None]] = []
    chars = 0
    for r in benchmark.select(F.col(item_col).alias("i"), F.col(text).alias("t")).where("t is not null").toLocalIterator():
        block.append((r.i, r.t))
        chars += len(r.t)
        if chars > BLOCK_CHARS:
            yield block
            block, chars = [], 0
    yield block


def phrase_matches(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, slop: int = 0, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document row: doc_id, n_words, starts, lengths, items of all window matches; exact ones, or within ``slop``."""
    slim = docs.select(named(id_col).alias("doc_id"), named(text).alias("text"))
    parts = []
    for block in blocks_of(benchmark):
        windows = Windows(block, size)
        parts.append(look_up(materialize(build_index(slim, windows.terms), "index"), windows, slop))
    if len(parts) == 1:
        return parts[0].drop("digest")
    key = ["doc_id", "digest", "n_words"]
    same = [F.col("l." + c).eqNullSafe(F.col("r." + c)) for c in key]
    found = parts[0].distinct()
    for p in parts[1:]:
        found = found.union(p.distinct())
    merged = found.groupBy(*key).agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "lengths", "items")])
    rows = parts[0].select(*key).alias("l").join(merged.alias("r"), same)
    return rows.select("l.doc_id", "l.n_words", "r.starts", "r.lengths", F.array_sort(F.array_distinct("r.items")).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, percent: int = 5, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (hit words are ``percent`` or more)."""
    matches = phrase_matches(docs, benchmark, size, 0, id_col, text)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words = b.column("n_words").to_numpy().astype(np.int64)
            hit = np.array([covered(s, n) if s else 0 for s, n in zip(b.column("starts").to_pylist(), b.column("lengths").to_pylist(), strict=True)], np.int64)
            items = b.column("items").to_pylist()
            digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
            arrays = [b.column("doc_id"), pa.array(n_words), pa.array(hit), pa.array(map(len, items), pa.int64()), pa.array(digests, pa.string()), pa.array((hit > 0) & (100 * hit >= percent * n_words))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return matches.select("doc_id", "n_words", "starts", "lengths", "items").mapInArrow(tidy(rows), "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are not contaminated, with all their columns.

    Each row has its own verdict, so that ids may repeat or be null.
    """
    rows = keyed(docs, "documents")
    slim = rows.select("key", F.col("row").getField(text).alias("text"))
    gone = decontaminate(slim, benchmark, id_col="key").where("contaminated").select(F.col("doc_id").alias("key"))
    return rows.join(gone, "key", "left_anti").select("row.*")
