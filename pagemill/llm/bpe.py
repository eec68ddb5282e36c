"""Byte-level BPE encoding and decoding, exact for texts of any length.

One narrow ``mapInArrow``: documents are encoded where they are read. A long text
is halved until the parts are short, before a lone space between two non-spaces if
there is one near the middle. The parts are encoded on their own, all leaves of a text
in one parallel batch, and at each join of the tree a window around the cut is
encoded again and grown until it agrees with ``AGREE`` consecutive tokens of both
sides, or has become the whole text. Adjacent tokens of a BPE encoding are valid
pair by pair, so agreement on both sides makes the joined encoding the exact one.

Texts of code points below U+0250 only are encoded by the vocabulary's rank file where it
lies beside it, all others by the tokenizers library: the two give equal ids there (tests
hold them together), and the first is several times as fast.

Defined results: null counts as empty; an empty text has no tokens, and its
digests are those of empty input; repeated rows are treated alike; other columns
are ignored; an empty table gives an empty result. Special tokens written in a
text become their ids, as is the library's default.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame

from .runtime import named, tidy

LEAF_CHARS = 16_384
WINDOW_CHARS = 64
AGREE = 4
SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Beyond these code points the two libraries' Unicode tables may differ in version.
WIDE = re.compile("[^\\x00-ɏ]")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CODECS: dict[str, Codec] = {}


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level BPE vocabularies write for bytes."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    """A byte-level BPE vocabulary with exact tree encoding.

    ``vocabulary`` is the content of a tokenizers JSON file. ``ranks``, if given, is the
    content of the same vocabulary's rank file; it serves texts of code points below
    U+0250, where both libraries split alike, at several times the speed.
    """

    def __init__(self, vocabulary: bytes, ranks: bytes | None = None, leaf: int = LEAF_CHARS) -> None:
        self.leaf = leaf
        self.vocabulary = vocabulary
        spec = json.loads(vocabulary)
        letters = byte_alphabet()
        added = {x["id"]: x["content"] for x in spec["added_tokens"]}
        size = max([*spec["model"]["vocab"].values(), *added]) + 1
        self.piece: list[bytes] = [b""] * size
        for token, i in spec["model"]["vocab"].items():
            self.piece[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        for i, token in added.items():
            self.piece[i] = token.encode()
        self.decimal = [b"%d" % i for i in range(size)]
        self.fast = None
        plain = all(not (x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"]) for x in spec["added_tokens"])
        if ranks and plain:
            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={t: i for i, t in added.items()})

    @cached_property
    def tokenizer(self):
        """Loaded when a text needs it."""
        from tokenizers import Tokenizer

        out = Tokenizer.from_str(self.vocabulary.decode())
        out.no_truncation()
        out.no_padding()
        return out

    def _encode_all(self, texts: list[str]) -> list[list[int]]:
        if self.fast and not any(map(WIDE.search, texts)):
            if len(texts) > 1 and sum(map(len, texts)) > self.leaf:
                return self.fast.encode_batch(texts, num_threads=2, allowed_special="all")
            return [self.fast.encode(t, allowed_special="all") for t in texts]
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0]

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(texts)
        groups: dict[bool, list[int]] = {False: [], True: []}
        for k, t in enumerate(texts):
            if len(t) > self.leaf:
                out[k] = self._encode_tree(t)
            elif t:
                groups[bool(WIDE.search(t))].append(k)
        for own in groups.values():
            for k, ids in zip(own, self._encode_all([texts[k] for k in own]), strict=True):
                out[k] = ids
        return out

    def _encode_tree(self, text: str) -> list[int]:
        """Leaves first, then joins of neighbours, level by level."""
        cuts: list[int] = []
        todo = [(0, len(text))]
        while todo:
            lo, hi = todo.pop()
            if hi - lo <= self.leaf:
                continue
            mid = (lo + hi) // 2
            m = SAFE_CUT.search(text, mid, min(mid + self.leaf // 4, hi - 1))
            at = m.start() if m else mid
            cuts.append(at)
            todo += [(lo, at), (at, hi)]
        cuts.sort()
        edges = [0, *cuts, len(text)]
        wide = bool(WIDE.search(text))
        encode = (lambda xs: [e.ids for e in self.tokenizer.encode_batch(xs, add_special_tokens=False)]) if wide else self._encode_all
        leaves = encode([text[a:b] for a, b in zip(edges, edges[1:], strict=False)])
        parts = list(zip(edges, edges[1:], leaves, strict=False))
        while len(parts) > 1:
            joined = []
            for k in range(0, len(parts) - 1, 2):
                (lo, at, left), (_, hi, right) = parts[k], parts[k + 1]
                joined.append((lo, hi, self._join(text, lo, at, hi, left, right, encode)))
            parts = joined + parts[len(joined) * 2 :]
        return parts[0][2]

    def _join(self, text: str, lo: int, at: int, hi: int, left: list[int], right: list[int], encode: Callable) -> list[int]:
        size = WINDOW_CHARS
        while True:
            a, b = max(lo, at - size), min(hi, at + size)
            window = encode([text[a:b]])[0]
            if a == lo and b == hi:
                return window
            pos, starts = -len(text[a:at].encode()), []
            for t in window:
                starts.append(pos)
                pos += len(self.piece[t])
            head = (0, 0) if a == lo else self._agree_left(left, window, starts)
            tail = (len(window), len(right)) if b == hi else self._agree_right(right, window, starts)
            if head and tail and head[1] <= tail[0]:
                return left[: head[0]] + window[head[1] : tail[0]] + right[tail[1] :]
            size *= 2

    def _agree_left(self, left: list[int], window: list[int], starts: list[int]) -> tuple[int, int] | None:
        """(tokens of left to keep, tokens of the window to leave out), at the first agreement."""
        at, known, i = 0, {}, len(left)
        while i and at > starts[0]:
            i -= 1
            at -= len(self.piece[left[i]])
            known[at] = i
        for j in range(len(window) - AGREE + 1):
            i = known.get(starts[j])
            if i is not None and left[i : i + AGREE] == window[j : j + AGREE]:
                return i, j
        return None

    def _agree_right(self, right: list[int], window: list[int], starts: list[int]) -> tuple[int, int] | None:
        """(tokens of the window to keep, tokens of right to leave out), at the last agreement."""
        at, known, over = 0, {}, starts[-1] + len(self.piece[window[-1]])
        for i, t in enumerate(right):
            if at > over:
                break
            known[at] = i
            at += len(self.piece[t])
        for j in range(len(window) - AGREE, -1, -1):
            i = known.get(starts[j]) if starts[j] >= 0 else None
            if i is not None and right[i : i + AGREE] == window[j : j + AGREE]:
                return j + AGREE, i + AGREE
        return None

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.piece.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def decimals(self, ids: list[int]) -> bytes:
        return b",".join(map(self.decimal.__getitem__, ids))


def _files(path: str) -> tuple[bytes, bytes | None]:
    with open(path, "rb") as f:
        vocabulary = f.read()
    beside = os.path.splitext(path)[0] + ".tiktoken"
    if not os.path.exists(beside):
        return vocabulary, None
    with open(beside, "rb") as f:
        return vocabulary, f.read()


def _codec(files: tuple[bytes, bytes | None]) -> Codec:
    """One codec for each worker process and vocabulary."""
    key = hashlib.sha256(files[0]).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = Codec(*files)
    return _CODECS[key]


COLUMNS = {
    "n_tokens": (pa.int64(), "bigint"),
    "ids": (pa.list_(pa.int32()), "array<int>"),
    "decoded": (pa.string(), "string"),
    "ids_sha256": (pa.string(), "string"),
    "decoded_sha256": (pa.string(), "string"),
}


def encode_decode(docs: DataFrame, path: str, columns: tuple[str, ...] = ("n_tokens", "ids", "decoded"), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id and the ``columns`` asked for, out of those in ``COLUMNS``.

    The vocabulary file (a few MB, whatever the corpus) is read once on the driver
    and broadcast; executors need no copy of it.
    """
    slim = docs.select(named(id_col).alias("doc_id"), named(text).alias("text"))
    files = docs.sparkSession.sparkContext.broadcast(_files(path))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(files.value)
        make = {
            "n_tokens": lambda ids: len(ids),
            "ids": lambda ids: ids,
            "decoded": codec.decode,
            "ids_sha256": lambda ids: hashlib.sha256(codec.decimals(ids)).hexdigest(),
            "decoded_sha256": lambda ids: hashlib.sha256(codec.decode_bytes(ids)).hexdigest(),
        }
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                coded = codec.encode_batch([x or "" for x in part.column("text").to_pylist()])
                arrays = [pa.array([make[c](ids) for ids in coded], COLUMNS[c][0]) for c in columns]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *arrays], ["doc_id", *columns])

    return slim.mapInArrow(tidy(rows), ", ".join(["doc_id bigint", *(f"{c} {COLUMNS[c][1]}" for c in columns)]))
