"""Repair of conversations' structure: the cheapest edits that make roles ``(s?(ua)+)?``, by a DP over a trie.

Every row of a conversation is one symbol: must go (blank, or repeating an earlier row), or the class of its role, in
upper case if its text is cut off. A conversation is the signature of its rows' symbols. Different signatures are few
against conversations, and each is solved once: sorted, they walk a prefix trie in order, so only the path from the root
to the present node is held, with one DP layer for each of its nodes. What two signatures share at their start is
computed once for both; an answer is read where a signature ends.

A layer has, for the four states of the grammar (nothing, after s, after u, after a), the least cost and the least of the
cheapest edits' strings. Strings are never compared as a whole: of states' strings only the order matters, and two
different states' strings that ended with a row part at a place before both ends, so ranks and the insertions since
the last row decide. States that cost ``HOPELESS`` more than the best can no longer win. What is left is one of a few
shapes of layers, so that a node is two numbers, and the step from a shape by a symbol is computed once for a worker.

Repeated rows are found by one aggregation over (conversation, role, text), which copies only enter once a task. A
conversation's rows then pass one task twice in their order as a sorted stream, once to make its signature (a character a
row) and once to be edited and digested; a digest of ordered text is sequential, and neither pass holds the rows.

Defined results: rows come by turn (nulls first), then role, text; null roles and texts are one space; a null conv_id is
a conversation of its own; rows that are alike are told apart only by their number, so each but the first is a
duplicate; other columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Scratch, materialize, named, tidy

SPACES = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3
#: States of the grammar.
NOTHING, AFTER_S, AFTER_U, AFTER_A = range(4)
#: From any state the rest costs at most so much more than from any other: a kept s deleted (4) and two insertions (6).
HOPELESS = 10
MUST_GO = "d"
#: cost and edits since the last row: of each state or None, relative to the best; edits are the base's rank and insertions.
Entry = tuple[int, int, int]
Shape = tuple[Entry | None, Entry | None, Entry | None, Entry | None]


def after(state: int, initial: str) -> int | None:
    """The state that a row with this role leads to."""
    if initial == "s":
        return AFTER_S if state == NOTHING else None
    if initial == "u":
        return AFTER_U if state != AFTER_U else None
    return AFTER_A if initial == "a" and state == AFTER_U else None


def wanted(state: int) -> str:
    """The role that an inserted or changed row takes."""
    return "a" if state == AFTER_U else "u"


class RepairTrie:
    """Answers for signatures that come in order; holds the path to the last of them."""

    def __init__(self) -> None:
        self.shapes: list[Shape] = []
        self.numbers: dict[Shape, int] = {}
        #: (shape, symbol) -> (shape, cost, per state the state before and the edits).
        self.steps: dict[tuple[int, str], tuple[int, int, tuple]] = {}
        root, cost, self.first = self._closed({NOTHING: (0, 0)}, {NOTHING: (None, "")})
        self.nodes, self.costs, self.path = array("q", [root]), array("q", [cost]), ""

    def _closed(self, before: dict[int, tuple[int, int]], came: dict[int, tuple[int | None, str]]) -> tuple[int, int, tuple]:
        """The layer of (cost, rank) entries after insertions, as (shape, least cost, where from)."""
        full: list[tuple[int, int, str] | None] = [None] * 4
        base = [None] * 4
        for q, (cost, rank) in before.items():
            full[q], base[q] = (cost, rank, ""), q
        for to, sources in ((AFTER_U, (NOTHING, AFTER_S, AFTER_A)), (AFTER_A, (AFTER_U,))):
            for q in sources:
                if full[q] is not None:
                    cost, rank, ins = full[q]
                    entry = (cost + INSERT, rank, ins + "I")
                    if full[to] is None or entry < full[to]:
                        full[to], base[to] = entry, base[q]
        least = min(e[0] for e in full if e is not None)
        shape = tuple(None if e is None or e[0] - least > HOPELESS else (e[0] - least, e[1], len(e[2])) for e in full)
        if shape not in self.numbers:
            self.numbers[shape] = len(self.shapes)
            self.shapes.append(shape)
        back = tuple(None if e is None else (came[base[q]][0], came[base[q]][1] + e[2]) for q, e in enumerate(full))
        return self.numbers[shape], least, back

    def _step(self, node: int, symbol: str) -> tuple[int, int, tuple]:
        if (node, symbol) not in self.steps:
            best: dict[int, tuple[int, tuple[int, str], int, str]] = {}
            more = CUT_OFF if symbol.isupper() else 0
            for q, entry in enumerate(self.shapes[node]):
                if entry is None:
                    continue
                cost, rank, inserted = entry
                ways = [(q, DELETE, "D")]
                if symbol != MUST_GO:
                    to = after(q, symbol.lower())
                    ways += [(to, KEEP + more, "K")] if to is not None else []
                    ways.append((after(q, wanted(q)), REROLE + more, "R"))
                for to, price, letter in ways:
                    # Of one base the edits since its row decide, of two their ranks.
                    found = (cost + price, (rank, "I" * inserted + letter), q, letter)
                    if to not in best or found[:2] < best[to][:2]:
                        best[to] = found
            ranks = {key: k for k, key in enumerate(sorted(b[1] for b in best.values()))}
            self.steps[node, symbol] = self._closed({to: (b[0], ranks[b[1]]) for to, b in best.items()}, {to: (b[2], b[3]) for to, b in best.items()})
        return self.steps[node, symbol]

    def answer(self, signature: str) -> tuple[int, str]:
        """(cost, edits) of a signature; layers of what it shares with the one before are not computed again."""
        shared, most = 0, min(len(self.path), len(signature))
        if self.path[:most] == signature[:most]:
            shared = most
        else:
            low, high = 0, most
            while low < high:
                mid = (low + high + 1) // 2
                low, high = (mid, high) if self.path[:mid] == signature[:mid] else (low, mid - 1)
            shared = low
        del self.nodes[shared + 1 :], self.costs[shared + 1 :]
        for symbol in signature[shared:]:
            node, cost, _ = self._step(self.nodes[-1], symbol)
            self.nodes.append(node)
            self.costs.append(self.costs[-1] + cost)
        self.path = signature
        ends = [(e[0], e[1], "I" * e[2], q) for q, e in enumerate(self.shapes[self.nodes[-1]]) if e is not None and q in (NOTHING, AFTER_A)]
        cost, _, _, q = min(ends)
        edits = []
        for k in range(len(signature), 0, -1):
            q, letters = self.steps[self.nodes[k - 1], signature[k - 1]][2][q]
            edits.append(letters)
        edits.append(self.first[q][1])
        return self.costs[-1] + cost, "".join(reversed(edits))


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults set in by crc32 of ``conv_id:turn``, modulo 20 (nulls: one space)."""
    own = lambda c: F.coalesce(named(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(own("conv_id"), F.lit(":"), own("turn"))) % 20
    rows = conversations.select(named("conv_id").alias("conv_id"), named("turn").alias("turn"), own("role").alias("role"), own("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.where("kind <> 0").withColumns({"text": text, "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))})
    times = F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", "role", "text", F.explode(times).alias("copy")).drop("copy")


def _faults(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, uid, fault, symbol): each row's first fault, or null."""
    slim = rows.select(named("conv_id").alias("conv_id"), named("turn").cast("bigint").alias("turn"), *(F.coalesce(named(c), F.lit(" ")).alias(c) for c in ("role", "text")))
    slim = scratch.table(slim.withColumn("uid", F.monotonically_increasing_id()), "rows")
    # Of rows that are alike the first by turn; rows of one turn that are alike differ in nothing.
    first = slim.groupBy("conv_id", "role", "text").agg(F.min(F.struct("turn", "uid")).alias("one")).select(F.col("one.uid").alias("uid"), F.lit(True).alias("first"))
    end = F.right(F.rtrim(F.col("text"), F.lit(SPACES)), F.lit(1))
    fault = F.when(end == "", "blank").when(F.col("first").isNull(), "duplicate").when(~end.isin(".", "!", "?"), "truncated")
    role = F.substring("role", 1, 1)
    kind = F.when(role.isin("s", "u", "a"), role).otherwise("x")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), MUST_GO).when(F.col("fault") == "truncated", F.upper(kind)).otherwise(kind)
    return slim.join(first, "uid", "left").withColumn("fault", fault).drop("first").withColumn("symbol", symbol)


ORDER = ("turn", "role", "text", "uid")


def _signatures(rows: DataFrame) -> DataFrame:
    """(conv_id, signature, illegal) from rows in order."""
    dealt = rows.select("conv_id", *ORDER, "symbol").repartition("conv_id").sortWithinPartitions("conv_id", *ORDER)
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv: object = run  # nothing is equal to it
        symbols: list[str] = []
        illegal, before = 0, ""
        type_: pa.DataType | None = None

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([conv], type_), pa.array(["".join(symbols)]), pa.array([illegal], pa.int64())], ["conv_id", "signature", "illegal"])

        for b in batches:
            type_ = b.schema.field("conv_id").type
            for own, role, symbol in zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("symbol").to_pylist(), strict=True):
                if conv is run or own != conv:
                    if symbols:
                        yield made()
                    conv, symbols, illegal, before = own, [], 0, None
                illegal += before is not None and before + role[:1] not in ("su", "ua", "au")
                before = role[:1]
                symbols.append(symbol)
        if symbols:
            yield made()

    return dealt.mapInArrow(tidy(run), f"conv_id {kind}, signature string, illegal bigint")


def _answers(signatures: DataFrame) -> DataFrame:
    """(signature, cost, audit) of the different signatures, neighbours in order in one task."""
    dealt = signatures.select("signature").distinct().repartitionByRange("signature").sortWithinPartitions("signature")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = RepairTrie()
        for b in batches:
            signature = b.column("signature").to_pylist()
            cost, audit = zip(*map(trie.answer, signature), strict=True) if signature else ((), ())
            yield pa.RecordBatch.from_arrays([b.column("signature"), pa.array(cost, pa.int64()), pa.array(audit, pa.string())], ["signature", "cost", "audit"])

    return dealt.mapInArrow(tidy(run), "signature string, cost bigint, audit string")


#: Roles of new and changed rows.
ROLE = {"u": "user", "a": "assistant"}


class Edited:
    """Applies a conversation's edits to its rows, which come one at a time."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, NOTHING

    def _inserted(self) -> Iterator[tuple[str, str]]:
        while self.audit.startswith("I", self.at):
            self.at += 1
            own = wanted(self.state)
            self.state = after(self.state, own)
            yield ROLE[own], ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            own = role[:1] if edit == "K" else wanted(self.state)
            self.state = after(self.state, own)
            yield role if edit == "K" else ROLE[own], text

    def end(self) -> Iterator[tuple[str, str]]:
        yield from self._inserted()


def _edited(rows: DataFrame, audits: DataFrame, digest: bool) -> DataFrame:
    """(conv_id, place, role, text) of the repaired rows, or (conv_id, repaired_sha256)."""
    none = F.lit(None)
    head = audits.select("conv_id", F.lit(0).alias("part"), none.cast("bigint").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(0).cast("bigint").alias("uid"))
    tail = rows.select("conv_id", F.lit(1).alias("part"), *ORDER)
    dealt = head.union(tail).repartition("conv_id").sortWithinPartitions("conv_id", "part", *ORDER)
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, edits = None, None
        sha, place = hashlib.sha256(), 0
        type_: pa.DataType | None = None
        out: list[tuple] = []

        def take(some: Iterator[tuple[str, str]]) -> None:
            nonlocal place
            for role, text in some:
                if digest:
                    sha.update(("\n" * (place > 0) + f"{role}:{text}").encode())
                else:
                    out.append((conv, place, role, text))
                place += 1

        def close() -> None:
            if edits is not None:
                take(edits.end())
                if digest:
                    out.append((conv, sha.hexdigest()))

        names, types = (("conv_id", "repaired_sha256"), (pa.string(),)) if digest else (("conv_id", "place", "role", "text"), (pa.int64(), pa.string(), pa.string()))

        def made() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else ((),) * len(names)
            rows = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (type_, *types), strict=True)], list(names))
            out.clear()
            return rows

        for b in batches:
            type_ = b.schema.field("conv_id").type
            for own, part, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "part", "role", "text")), strict=True):
                if part == 0:
                    close()
                    conv, edits, sha, place = own, Edited(text), hashlib.sha256(), 0
                else:
                    take(edits.row(role, text))
            yield made()
        close()
        if out:
            yield made()

    return dealt.mapInArrow(tidy(run), f"conv_id {kind}, repaired_sha256 string" if digest else f"conv_id {kind}, place bigint, role string, text string")


def _solved(scratch: Scratch, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with their faults; conv_id, illegal, cost, audit)."""
    rows = scratch.table(_faults(scratch, rows), "faults")
    signatures = scratch.table(_signatures(rows), "signatures")
    answers = scratch.table(_answers(signatures), "answers")
    return rows, scratch.table(signatures.join(answers, "signature").select("conv_id", "illegal", "cost", "audit"), "audits")


def repair(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), role, text."""
    with Scratch(rows.sparkSession) as scratch:
        rows, audits = _solved(scratch, rows)
        return materialize(_edited(rows, audits, digest=False), "repaired")


def repair_report(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """Of every conv_id in ``conversations``, from its ``rows``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256."""
    ids = conversations.select(named("conv_id").alias("conv_id")).distinct()
    with Scratch(rows.sparkSession) as scratch:
        rows, audits = _solved(scratch, rows)
        turns = rows.groupBy("conv_id", "turn").agg(*(F.count(F.when(F.col("fault") == x, 1)).alias(x) for x in ("blank", "duplicate", "truncated")))
        gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
        counts = turns.groupBy("conv_id").agg(gaps.alias("gaps"), *(F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated")))
        own = scratch.table(_edited(rows, audits, digest=True), "digests").withColumnRenamed("conv_id", "conv")
        out = ids
        for side in (counts, audits, own.withColumnRenamed("conv", "conv_id")):
            side = side.withColumnRenamed("conv_id", "other")
            out = out.join(side, F.col("conv_id").eqNullSafe(F.col("other")), "left").drop("other")
        numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
        empty = hashlib.sha256(b"").hexdigest()
        out = out.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in numbers), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
        return materialize(out, "repair-report")
