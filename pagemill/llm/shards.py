"""Balanced shards by label propagation over links between equal texts.

Documents with equal texts are linked. Each starts in a shard by hash, and a text's state
is one row with its number of documents in each shard, however many copies it has. Each
round every text that lies in several shards looks at its votes there and asks for the
shard with most of them that still has room, ties by hash, to take all its documents. Asks
are granted by lots, so that nothing has to be sorted: each shard takes as many lots as fit
its quota, departures counted. Rounds go on until no text is left in several shards.

Texts of more than 1 in ``shards * LARGE`` documents, which may not fit in a lot or a shard, are
placed first, one by one, at most that many rows on the driver: in the shard with most votes
that takes them whole, or else from the emptiest shard on, shard after shard. Texts alone
in the corpus never move.

Rounds end: a shard is asked only if its room is half the mean room or more (one always
is), so a round that refuses an ask fills such a shard to within one lot, and a text that
moved lies in one shard and never moves again. With lots of up to half that room
(``LOTS`` and ``LARGE`` are chosen for it) each round but the last moves at least
``(SLACK - 1) / (4 * shards)`` of all documents, which bounds the rounds.

At last the law ``rows`` is made exact: documents are ordered by (shard, text, id) over
all range partitions, and the order is cut into equal slices. A slice boundary splits at
most one text, and large texts are split where capacity demands it.

Defined results: null and empty texts have sizes of 1 and crc32 0, and are one text;
repeated rows are dealt out each for itself; a null doc_id sorts first; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .runtime import materialize, named

SHARDS = 8
#: A shard may hold so much more than its even part while texts move.
SLACK = 1.05
LARGE = 256
LOTS = 1_024


def place_large(large: list[Row], loads: list[int], capacity: int) -> list[tuple[bytearray, int]]:
    """The shard of each text, that of its first part if no shard has room for it; ``loads`` are brought up to date."""
    out = []
    for r in sorted(large, key=lambda r: (-r.n, r.text_key)):
        for s, v in enumerate(r.votes):
            loads[s] -= v
        room = [capacity - x for x in loads]
        fits = [s for s, x in enumerate(room) if x >= r.n]
        first = max(fits or range(len(loads)), key=lambda s: (r.votes[s] if fits else room[s], zlib.crc32(bytes([*r.text_key, s]))))
        left = r.n
        for s in (*range(first, len(loads)), *range(first - 1, -1, -1)):
            part = min(left, max(0, room[s]))
            loads[s] += part
            left -= part
        out.append((r.text_key, first))
    return out


def grant(flows: np.ndarray, loads: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Of asks ``flows[wish, lot, source]`` the number of lots each shard takes, and the loads after."""
    upto = [flows.shape[1]] * len(loads)
    sums = np.concatenate([np.zeros_like(flows[:, :1]), flows.cumsum(1)], 1)
    while True:
        moved = np.stack([sums[w, k] for w, k in enumerate(upto)])
        after = np.array(loads) + moved.sum(1) - moved.sum(0)
        full = [s for s in range(len(loads)) if after[s] > capacity and moved[s].any()]
        if not full:
            return upto, after.tolist()
        # What one shard refuses stays elsewhere: lots are only ever taken back.
        for s in full:
            come = sums[s].sum(1)
            upto[s] = int(np.searchsorted(come, come[upto[s]] - (after[s] - capacity), "right")) - 1 if come[upto[s]] > after[s] - capacity else 0


def propagate(texts: DataFrame, loads: list[int]) -> DataFrame:
    """``(text_key, votes, n)`` -> with the one ``shard`` of each text; ``loads`` are all documents of each shard."""
    shards, total, loads = len(loads), sum(loads), list(loads)
    capacity = int(SLACK * total / shards) + 1
    cut = F.size(F.filter("votes", lambda v: v > 0)) > 1
    large = texts.where(cut & (F.col("n") * (shards * LARGE) > total)).collect()
    fixed = texts.sparkSession.createDataFrame(place_large(large, loads, capacity), "text_key binary, shard int")
    state = texts.join(F.broadcast(fixed), "text_key", "left").withColumn("shard", F.when(cut, F.col("shard")).otherwise(F.array_position("votes", F.col("n")).cast("int") - 1))
    state = materialize(state, "texts")
    placed = state.where("shard is not null")
    state = state.where("shard is null")
    for k in range(int(4 * shards / (SLACK - 1)) + 2):
        room = [capacity - x for x in loads]
        asked = [s for s in range(shards) if 2 * shards * room[s] >= sum(room)]
        best = F.array_max(F.array(*[F.struct(F.get("votes", F.lit(s)).alias("v"), F.xxhash64("text_key", F.lit(s)).alias("tie"), F.lit(s).alias("s")) for s in asked]))
        asks = state.withColumns({"shard": best["s"], "lot": F.pmod(F.xxhash64("text_key", F.lit("lot"), F.lit(k)), F.lit(LOTS)).cast("int")})
        moves = asks.select("shard", "lot", F.posexplode("votes").alias("source", "v")).where("v > 0 and source <> shard")
        flows = np.zeros((shards, LOTS, shards), np.int64)
        # At most shards * LOTS * shards rows.
        for r in moves.groupBy("shard", "lot", "source").agg(F.sum("v").alias("v")).collect():
            flows[r.shard, r.lot, r.source] = r.v
        upto, loads = grant(flows, loads, capacity)
        took = F.col("lot") < F.get(F.array(*map(F.lit, upto)), F.col("shard"))
        placed = placed.union(asks.where(took).drop("lot"))
        if not any(flows[s, upto[s] :].any() for s in range(shards)):
            return placed
        state = materialize(asks.where(~took).withColumn("shard", F.lit(None).cast("int")).drop("lot"), "asking")
    raise RuntimeError("texts are left in several shards")


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    t = F.coalesce(named(text), F.lit(""))
    slim = docs.select(named(id_col).alias("doc_id"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t).alias("text_crc32"), F.unhex(F.md5(t)).alias("text_key"))
    start = F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(shards)).cast("int")
    slim = materialize(slim.withColumn("start", start), "sizes")
    loads = [0] * shards
    for r in slim.groupBy("start").agg(F.count(F.lit(1)).alias("n")).collect():
        loads[r.start] = r.n
    total = sum(loads)
    votes = F.array(*[F.count(F.when(F.col("start") == s, 1)) for s in range(shards)])
    texts = materialize(slim.groupBy("text_key").agg(votes.alias("votes"), F.count(F.lit(1)).alias("n")).where("n > 1"), "votes")
    placed = propagate(texts, loads).select("text_key", "shard", F.posexplode("votes").alias("start", "v")).where("v > 0").drop("v")
    docs_placed = slim.join(placed, ["text_key", "start"], "left").withColumn("wanted", F.coalesce("shard", "start")).drop("shard", "start")
    # A global order without a global sort in one task: ranges, then each row's place in its range.
    ranged = docs_placed.repartitionByRange("wanted", "text_key", "doc_id").sortWithinPartitions("wanted", "text_key", "doc_id")
    ranged = materialize(ranged.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "ordered")
    # One row for each range partition.
    parts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("k"))
    before = parts.select("part", F.coalesce(F.sum("k").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.col("before") + F.col("place")
    out = ranged.join(F.broadcast(before), "part").withColumn("rank", rank)
    # Slice s holds the ranks from ceil(s * n / shards) on: sizes differ by one at most.
    out = out.withColumn("shard", F.expr(f"cast((rank * {shards}) div {max(total, 1)} as int)"))
    first = F.expr(f"(cast(shard as bigint) * {max(total, 1)} + {shards - 1}) div {shards}")
    return out.select("doc_id", "size", F.col("text_crc32").cast("long"), F.lit("rows").alias("law"), "shard", (F.col("rank") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
