"""Collocations by hierarchical pair naming: phrases that score best at their weakest cut.

Texts are cut into chunks of some MB for each language (a long text at the ends of pieces), and a chunk is written as a
sequence of local numbers of its words, 0 where a piece ends. Level by level each chunk sends its distinct names with their
counts, packed, to the buckets that their hashes fall into. A bucket adds up the counts, gives what is frequent a global id
and answers each chunk with its ids. Places where two frequent (k-1)-grams follow one another become the pairs of the next
level. A k-gram is thus the pair of the two (k-1)-grams in it, and a pair's row is its parent pointer: the counts of the
parts of every cut, the words, and the longer phrases of a candidate follow from joins with the level below. No
phrase of fewer than ``least`` occurrences has an extension with more, so nothing is lost by naming frequent ones only.

A candidate inside a longer one is also inside one that is a word longer and occurs as often at least. So the drop rule is
tested on the next level's pairs alone.

Occurrences are counted in their chunk before anything is exchanged: a word that makes up a third of all text is one number a
chunk, so buckets are even. There is a bucket for every ``BUCKET`` words of all texts, and chunks and buckets both pass as
sorted streams, so a task holds one of them at a time. A level is one job from written tables to a written table. A
language's best rows are picked from ``SALTS`` shares of at most ``top`` rows. Counts are 64-bit, products decimals of 38 digits.

Defined results: a null or empty text has no words; null languages count as ``und``; rows count each for itself; other
columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .runtime import Scratch, materialize, named, tidy
from .textscan import mix

CHUNK_BYTES = 8 << 20
#: Bytes of all languages together that wait for their chunks to fill.
HELD_BYTES = 24 << 20
#: Words for each bucket of names, and buckets at least.
BUCKET, BUCKETS = 1 << 20, 64
SALTS = 64
#: A-Z to a-z, what ends a piece to a line feed, tab to space.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
TOKEN = re.compile(rb"[^ \n]+|\n+")


def pack(numbers: np.ndarray) -> bytes:
    """Whole numbers from 0, as many bytes each as the largest needs, kept apart and compressed."""
    width = max((int(numbers.max(initial=0)).bit_length() + 7) // 8, 1)
    planes = np.ascontiguousarray(numbers.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return len(numbers).to_bytes(8, "little") + bytes([width]) + (pa.compress(planes.tobytes(), "zstd", asbytes=True) if len(numbers) else b"")


def unpack(data: bytes) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), data[8]
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, :width] = np.frombuffer(pa.decompress(data[9:], width * n, "zstd"), np.uint8).reshape(width, n).T
    return out.view("<i8").ravel()


def parts(text: str) -> Iterator[bytes]:
    """A folded text in stretches of a chunk's size that end where a piece ends."""
    data = text.encode().translate(FOLDED)
    at = 0
    while len(data) - at > CHUNK_BYTES:
        cut = data.rfind(b"\n", at, at + CHUNK_BYTES)
        if cut < 0:
            cut = data.find(b"\n", at + CHUNK_BYTES)
        if cut < 0:
            break
        yield data[at:cut]
        at = cut + 1
    yield data[at:]


def words(folded: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(local numbers, 0 where a piece ends; counts; the words they number from 1)."""
    tokens = TOKEN.findall(b"\n".join(folded))
    coded = pa.array(tokens, pa.large_binary()).dictionary_encode()
    names = coded.dictionary.to_pylist()
    real = np.array([not x.startswith(b"\n") for x in names], bool)
    number = np.where(real, np.cumsum(real), 0)
    own = number[coded.indices.to_numpy()] if names else np.zeros(0, np.int64)
    return own, np.bincount(own, minlength=int(real.sum()) + 1)[1:], [x for x in names if not x.startswith(b"\n")]


def pairs(own: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(left ids, right ids, counts, numbers from 1 at each place) of neighbours that both have an id.

    ``own`` has local numbers, ``ids`` the global id of each local number, 0 for none.
    """
    out = np.zeros(len(own), np.int64)
    known = ids[own] > 0
    at = np.flatnonzero(known[:-1] & known[1:]) if len(own) else np.zeros(0, np.int64)
    codes, unique = pd.factorize(own[at] * len(ids) + own[at + 1])
    out[at] = codes + 1
    return ids[unique // len(ids)], ids[unique % len(ids)], np.bincount(codes, minlength=len(unique)), out


def buckets(slots: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places of its names) for 32-bit hashes, in order; buckets without names are left out."""
    own = slots * most >> 32
    order = np.argsort(own, kind="stable")
    cuts = np.flatnonzero(np.diff(own[order])) + 1
    for places in np.split(order, cuts) if len(order) else ():
        yield int(own[places[0]]), places


def pair_slots(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (mix(mix(left.view(np.uint64)) + right.view(np.uint64)) >> np.uint64(32)).astype(np.int64)


CHUNK = "lang string, n bigint, words binary, counts binary, slots binary, own binary"


def _chunks(slim: DataFrame) -> DataFrame:
    """(lang, n, words, counts, slots, own) of chunks of texts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}

        def chunk(lang: str) -> pa.RecordBatch:
            size.pop(lang)
            own, counts, names = words(held.pop(lang))
            salt = zlib.crc32(lang.encode())
            slots = np.array([zlib.crc32(x, salt) for x in names], np.int64)
            packed = [pa.array([x], pa.binary()) for x in (b" ".join(names), pack(counts), pack(slots), pack(own))]
            return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([int(counts.sum())], pa.int64()), *packed], ["lang", "n", "words", "counts", "slots", "own"])

        for b in batches:
            for lang, text in zip(b.column("lang"), b.column("text"), strict=True):
                lang = lang.as_py()
                for part in parts(text.as_py() or ""):
                    held.setdefault(lang, []).append(part)
                    size[lang] = size.get(lang, 0) + len(part) + 1
                    if size[lang] >= CHUNK_BYTES:
                        yield chunk(lang)
                if sum(size.values()) >= HELD_BYTES:
                    for lang in list(held):
                        yield chunk(lang)
        for lang in list(held):
            yield chunk(lang)

    return slim.mapInArrow(tidy(rows), CHUNK)


SENT = "bucket int, chunk bigint, lang string, words binary, lefts binary, rights binary, counts binary"


def _sent(bucket: int, chunk: int, lang: str | None, words: bytes | None, lefts: bytes | None, rights: bytes | None, counts: bytes) -> pa.RecordBatch:
    arrays = [pa.array([bucket], pa.int32()), pa.array([chunk], pa.int64()), pa.array([lang], pa.string()), *(pa.array([x], pa.binary()) for x in (words, lefts, rights, counts))]
    return pa.RecordBatch.from_arrays(arrays, ["bucket", "chunk", "lang", "words", "lefts", "rights", "counts"])


def _sent_words(chunks: DataFrame, most: int) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                r = b.slice(at, 1).to_pylist()[0]
                names, counts = r["words"].split(b" "), unpack(r["counts"])
                for bucket, places in buckets(unpack(r["slots"]), most):
                    yield _sent(bucket, r["chunk"], r["lang"], b" ".join([names[k] for k in places]), None, None, pack(counts[places]))

    return chunks.select("chunk", "lang", "words", "counts", "slots").mapInArrow(tidy(rows), SENT)


def _sent_pairs(chunks: DataFrame, answers: DataFrame, level: int, most: int) -> DataFrame:
    """The pairs of a level, from the chunks' words and the ``answers`` (chunk, level, bucket, ids) of all levels below."""
    no = F.lit(None).cast("binary")
    head = chunks.select("chunk", F.lit(0).alias("level"), F.lit(0).alias("bucket"), no.alias("ids"), "slots", "own")
    tail = answers.select("chunk", "level", "bucket", "ids", no.alias("slots"), no.alias("own"))
    dealt = head.union(tail).repartition("chunk").sortWithinPartitions("chunk", "level", "bucket")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, own, slots = None, np.zeros(0, np.int64), np.zeros(0, np.int64)
        found: list[list[np.ndarray]] = []

        def made() -> Iterator[pa.RecordBatch]:
            names, at = own, slots
            left = right = counts = None
            for ids in found:
                full = np.zeros(len(at) + 1, np.int64)
                order = [places for _, places in buckets(at, most)]
                if order:
                    full[np.concatenate(order) + 1] = np.concatenate(ids)
                left, right, counts, names = pairs(names, full)
                at = pair_slots(left, right)
            for bucket, places in buckets(at, most):
                yield _sent(bucket, chunk, None, None, pack(left[places]), pack(right[places]), pack(counts[places]))

        for b in batches:
            for at in range(b.num_rows):
                r = b.slice(at, 1).to_pylist()[0]
                if r["level"] == 0:
                    if chunk is not None:
                        yield from made()
                    chunk, own, slots, found = r["chunk"], unpack(r["own"]), unpack(r["slots"]), [[] for _ in range(level - 1)]
                else:
                    found[r["level"] - 1].append(unpack(r["ids"]))
        if chunk is not None:
            yield from made()

    return dealt.mapInArrow(tidy(rows), SENT)


NAMED = "id bigint, lang string, phrase string, left bigint, right bigint, a bigint, chunk bigint, bucket int, ids binary"


def _named(sent: DataFrame, least: int) -> DataFrame:
    """The frequent names with their ids and counts, and the answers to the chunks (chunk, bucket, ids; 0 for no id)."""

    def answers(bucket: int, held: list[dict], ids: list[np.ndarray]) -> pa.RecordBatch:
        n = len(held)
        empty = [pa.nulls(n, t) for t in (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())]
        own = [pa.array([r["chunk"] for r in held], pa.int64()), pa.array([bucket] * n, pa.int32()), pa.array(map(pack, ids), pa.binary())]
        return pa.RecordBatch.from_arrays([*empty, *own], [c.split()[0] for c in NAMED.split(", ")])

    def names(bucket: int, n: int, lang: list | None, phrase: list | None, left: np.ndarray | None, right: np.ndarray | None, a: np.ndarray) -> pa.RecordBatch:
        ids = pa.array((bucket << 32) + 1 + np.arange(n), pa.int64())
        columns = [pa.nulls(n, t) if x is None else pa.array(x, t) for x, t in ((lang, pa.string()), (phrase, pa.string()), (left, pa.int64()), (right, pa.int64()), (a, pa.int64()))]
        return pa.RecordBatch.from_arrays([ids, *columns, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], [c.split()[0] for c in NAMED.split(", ")])

    def of_words(bucket: int, held: list[dict]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, bytes], int] = {}
        split = [(r["lang"], r["words"].split(b" ")) for r in held]
        for (lang, own), r in zip(split, held, strict=True):
            for w, n in zip(own, unpack(r["counts"]).tolist(), strict=True):
                total[lang, w] = total.get((lang, w), 0) + n
        kept = [key for key, n in total.items() if n >= least]
        number = {key: (bucket << 32) + 1 + k for k, key in enumerate(kept)}
        yield names(bucket, len(kept), [lang for lang, _ in kept], [w.decode() for _, w in kept], None, None, np.array([total[key] for key in kept], np.int64))
        yield answers(bucket, held, [np.array([number.get((lang, w), 0) for w in own], np.int64) for lang, own in split])

    def of_pairs(bucket: int, held: list[dict]) -> Iterator[pa.RecordBatch]:
        left, right, counts = (np.concatenate([unpack(r[c]) for r in held]) for c in ("lefts", "rights", "counts"))
        sizes = [int.from_bytes(r["counts"][:8], "little") for r in held]
        (l, ls), (r, rs) = pd.factorize(left), pd.factorize(right)
        codes, unique = pd.factorize(l * len(rs) + r)
        total = np.zeros(len(unique), np.int64)
        np.add.at(total, codes, counts)
        frequent = total >= least
        kept = unique[frequent]
        number = np.where(frequent, (bucket << 32) + np.cumsum(frequent), 0)[codes]
        yield names(bucket, len(kept), None, None, ls[kept // len(rs)], rs[kept % len(rs)], total[frequent])
        yield answers(bucket, held, np.split(number, np.cumsum(sizes)[:-1]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def made() -> Iterator[pa.RecordBatch]:
            if held:
                yield from (of_words if held[0]["words"] is not None else of_pairs)(held[0]["bucket"], held)
                held.clear()

        for b in batches:
            for r in b.to_pylist():
                if held and held[0]["bucket"] != r["bucket"]:
                    yield from made()
                held.append(r)
        yield from made()

    return sent.repartition("bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(tidy(rows), NAMED)


def _wide(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("decimal(20,0)")


def _best_cut(level: int) -> Column:
    """(score, k, l, r) of the lowest-scoring cut of rows (a, pre, suf): counts of the first and of the last words."""
    cuts = []
    for k in range(1, level):
        l, r = F.get("pre", F.lit(k - 1)), F.get("suf", F.lit(level - k - 1))
        # The quotient of two decimals, without its fraction.
        score = F.call_function("div", (F.lit(2_000_000).cast("decimal(7,0)") * _wide("a")).cast("decimal(38,0)"), (_wide(l) + _wide(r)).cast("decimal(38,0)"))
        cuts.append(F.struct(score.cast("bigint").alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r")))
    return F.array_min(F.array(*cuts))


def _best(rows: DataFrame, top: int) -> DataFrame:
    """Each language's first rows with their rank; first of shares of it, so that no task has all of a language."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    share = rows.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = share.withColumn("rank", F.row_number().over(W.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, longest: int = 4, least: int = 30, top: int = 2_000, share: int = 80, lang: str = "lang", text: str = "text") -> DataFrame:
    """Per language its ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    Candidates have 2 to ``longest`` words and ``least`` occurrences or more; those with ``share`` hundredths or more of their
    occurrences inside a longer candidate go.
    """
    slim = docs.select(F.coalesce(named(lang).cast("string"), F.lit("und")).alias("lang"), named(text).alias("text"))
    with Scratch(docs.sparkSession) as scratch:
        chunks = scratch.table(_chunks(slim).select(F.monotonically_increasing_id().alias("chunk"), "*"), "chunks")
        total = chunks.groupBy("lang").agg(F.sum("n").alias("n"))
        most = max(-(-(chunks.agg(F.sum("n")).first()[0] or 0) // BUCKET), BUCKETS)
        chunks = chunks.where("n > 0")
        answers: DataFrame | None = None
        below: DataFrame | None = None
        levels: list[DataFrame] = []
        for k in range(1, longest + 1):
            sent = _sent_words(chunks, most) if answers is None else _sent_pairs(chunks, answers, k, most)
            level = scratch.table(_named(sent, least), f"level-{k}")
            scratch.tidy()
            own = level.where("chunk is not null").select("chunk", F.lit(k).alias("level"), "bucket", "ids")
            answers = own if answers is None else answers.union(own)
            found = level.where("id is not null")
            if below is None:
                no = F.array().cast("array<bigint>")
                below = found.select("id", "lang", "phrase", "a", F.col("phrase").alias("last"), no.alias("pre"), no.alias("suf"))
                continue
            l = below.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("start"), F.col("a").alias("la"), "pre")
            r = below.select(F.col("id").alias("right"), F.col("a").alias("ra"), "last", "suf")
            both = found.select("id", "left", "right", "a").join(l, "left").join(r, "right")
            both = both.select("id", "left", "right", "lang", F.concat_ws(" ", "start", "last").alias("phrase"), "a", "last", F.array_append("pre", F.col("la")).alias("pre"), F.array_append("suf", F.col("ra")).alias("suf"))
            below = scratch.table(both, f"names-{k}")
            levels.append(below)
        out = None
        for k, (own, above) in enumerate(zip(levels, [*levels[1:], None], strict=True), start=2):
            if above is not None:
                inside = above.select("a", F.explode(F.array("left", "right")).alias("id")).groupBy("id").agg(F.max("a").alias("most"))
                own = own.join(inside, "id", "left").where(F.col("most").isNull() | (_wide("most") * 100 < _wide("a") * share))
            own = own.withColumn("cut", _best_cut(k)).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
            out = own if out is None else out.union(own)
        # As many rows as there are languages.
        best = _best(out, top).join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
        return materialize(best, "collocations")
