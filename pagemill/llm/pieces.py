"""Sentencepiece encoding that keeps source offsets, and decoding.

*Normalising.* At each place the longest prefix that the model's compiled character map knows is replaced, any other
character stays; spaces become word marks, with one before the text. The original place of every normalised byte is
kept, so each piece is projected to the bytes of the source that it came from.

*Encoding.* Where the vocabulary has no piece with a word mark after another character and none with a line feed, merges
never cross these places, and a normalised text is the sum of its pre-tokens, the stretches between them. Each worker
remembers what pre-tokens become (``CACHE_ENTRIES`` at most, which changes the speed only); unknown ones are merged by
the library, with a model whose own normaliser is switched off. A vocabulary without that property is encoded text by text.

*Decoding.* Pieces give their bytes, byte pieces their byte, and the mark before the text goes again.

One narrow ``mapInArrow`` over whole texts; the model file (under a MB) is read once on the driver and broadcast.

Spans: ``begins`` and ``ends`` are byte offsets in the UTF-8 source. They lie in order and cover every byte that the
normaliser keeps; the mark before the text spans nothing. Of a character written in byte pieces each has its own byte; of
one that the map replaced, the last byte piece has all and those before it nothing.

Defined results: null counts as empty; an empty text has no pieces, and its digests are those of empty input; repeated rows
are treated alike; other columns, whatever their names, are ignored; an empty table gives an empty result. Models that
mark words at their end, that have pieces of the user's own or lack byte pieces are refused with ``ValueError``.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .runtime import named, tidy

MARK = "▁"
MARK_BYTES = MARK.encode()
UNIT = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
CACHE_ENTRIES, CACHED_CHARS = 400_000, 32
ROWS_AT_ONCE = 128
#: The file format's kinds of pieces and the numbers of its fields.
NORMAL, BYTE = 1, 6
KNOWN_KINDS = {1, 2, 3, 5, 6}  # normal, unknown, control, unused, byte
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_KIND = 1, 3
CHARACTER_MAP, DUMMY_PREFIX, EXTRA_SPACES, ESCAPE = 2, 3, 4, 5
SPACE_AS_SUFFIX, BYTE_FALLBACK = 24, 35
#: Of a pre-token: its ids in decimals with a comma before each, its decoded bytes, its pieces' normalised lengths.
Unit = tuple[bytes, bytes, bytes]
_CODECS: dict[str, PieceCodec] = {}


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field, value) of a protocol buffer message: whole numbers, or bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = message[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(message):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            n = number() if kind == 2 else 8 if kind == 1 else 4
            yield key >> 3, message[at : at + n]
            at += n


class CharacterMap:
    """A compiled character map: a double-array trie over bytes, and the replacements it points to."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.texts = blob[4 + size :]
        self.firsts = {b for b in range(256) if self.units and self._child(self._offset(self.units[0]), b) is not None}
        #: Places where a replacement may begin.
        self.start = re.compile(b"[" + b"".join(re.escape(bytes([b])) for b in sorted(self.firsts)) + b"]") if self.firsts else None

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def _child(self, base: int, byte: int) -> int | None:
        """Place of the node that ``byte`` leads to."""
        place = base ^ byte
        return place if place < len(self.units) and self.units[place] & 0x800000FF == byte else None

    def longest(self, source: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes replaced, replacement) of the longest known prefix from ``at`` on."""
        out, base = None, self._offset(self.units[0])
        for k in range(at, len(source)):
            place = self._child(base, source[k])
            if place is None:
                break
            unit = self.units[place]
            base = place ^ self._offset(unit)
            if unit >> 8 & 1:
                value = self.units[base] & 0x7FFFFFFF
                out = k + 1 - at, self.texts[value : self.texts.index(b"\0", value)]
        return out


class Normalizer:
    def __init__(self, blob: bytes, dummy: bool, squeeze: bool, escape: bool) -> None:
        self.map, self.dummy, self.squeeze, self.escape = CharacterMap(blob), dummy, squeeze, escape

    def _replaced(self, source: bytes) -> tuple[bytes, np.ndarray]:
        """The source after the map, and where each byte's replaced stretch begins; one entry more for the end."""
        if self.map.start is None:
            return source, np.arange(len(source) + 1)
        parts, places, at, search = [], [], 0, self.map.start.search
        while at < len(source):
            m = search(source, at)
            stop = m.start() if m else len(source)
            parts.append(source[at:stop])
            places.append(np.arange(at, stop))
            at = stop
            if not m:
                break
            found = self.map.longest(source, at)
            if found:
                n, text = found
                parts.append(text)
                places.append(np.full(len(text), at))
            else:  # a whole character, so that none is cut
                n = 1
                while at + n < len(source) and source[at + n] & 0xC0 == 0x80:
                    n += 1
                parts.append(source[at : at + n])
                places.append(np.arange(at, at + n))
            at += n
        return b"".join(parts), np.concatenate([*places, [len(source)]])

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        """(normalised bytes, for each of them and for their end the place in the source's bytes)."""
        source = text.encode()
        data, place = self._replaced(source)
        if self.squeeze and data:
            own = np.frombuffer(data, np.uint8)
            space = own == 0x20
            again = space.copy()
            again[1:] &= space[:-1]  # spaces after spaces, and at the start
            keep = np.flatnonzero(~again)
            if len(keep) and space[keep[-1]]:
                keep = keep[:-1]
                end = int(place[keep[-1] + 1]) if len(keep) else 0
            else:
                end = len(source)
            data, place = own[keep].tobytes(), np.append(place[keep], end)
        if not data:
            return b"", place[-1:]
        if self.dummy:
            data, place = b" " + data, np.concatenate([place[:1], place])
        if self.escape:
            wide = np.where(np.frombuffer(data, np.uint8) == 0x20, 3, 1)
            data, place = data.replace(b" ", MARK_BYTES), np.append(np.repeat(place[:-1], wide), place[-1])
        return data, place


class PieceCodec:
    def __init__(self, model: bytes) -> None:
        from sentencepiece import SentencePieceProcessor

        trainer, own, pieces = {}, {}, []
        for f, value in fields(model):
            if f == PIECES:
                piece = dict(fields(value))
                pieces.append((piece[PIECE_TEXT].decode(), piece.get(PIECE_KIND, NORMAL)))
            elif f == TRAINER:
                trainer.update(fields(value))
            elif f == NORMALIZER:
                own.update(fields(value))
        if trainer.get(SPACE_AS_SUFFIX) or not trainer.get(BYTE_FALLBACK) or not {k for _, k in pieces} <= KNOWN_KINDS:
            raise ValueError("only models with byte pieces, marks before words and no pieces of the user's own")
        self.normalize = Normalizer(own.get(CHARACTER_MAP, b""), bool(own.get(DUMMY_PREFIX, 1)), bool(own.get(EXTRA_SPACES, 1)), bool(own.get(ESCAPE, 1)))
        # A later field replaces an earlier one: the library's own normaliser passes everything on.
        off = b"".join(bytes([f << 3 | kind, 0]) for f, kind in ((CHARACTER_MAP, 2), (DUMMY_PREFIX, 0), (EXTRA_SPACES, 0), (ESCAPE, 0)))
        self.merger = SentencePieceProcessor(model_proto=model + bytes([NORMALIZER << 3 | 2, len(off)]) + off)
        self.bytes = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.encode().replace(MARK_BYTES, b" ") if kind == NORMAL else b"" for p, kind in pieces]
        #: Normalised bytes of each piece.
        self.lengths = [1 if kind == BYTE else len(p.encode()) for p, kind in pieces]
        self.splits = not any(kind == NORMAL and re.search(f"[^{MARK}]{MARK}|\n", p) for p, kind in pieces)
        self.cache: dict[str, Unit] = {}

    def _learn(self, units: set[str]) -> list[str]:
        """Sees that the cache has all of these pre-tokens; the long ones among the new, which should not stay."""
        cache = self.cache
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        fresh = list(units.difference(cache))
        lengths, parts = self.lengths, self.bytes
        for u, ids in zip(fresh, self.merger.encode(fresh, num_threads=1), strict=True):
            cache[u] = (b",%d" * len(ids) % tuple(ids), b"".join([parts[i] for i in ids]), bytes([lengths[i] for i in ids]))
        return [u for u in fresh if len(u) > CACHED_CHARS]

    def encode(self, texts: list[str]) -> list[tuple[list[Unit], np.ndarray]]:
        """Per text: what its pre-tokens become, and places of its normalised bytes."""
        normal = [self.normalize(t) for t in texts]
        split = [UNIT.findall(data.decode()) if self.splits else [data.decode()] if data else [] for data, _ in normal]
        large = self._learn(set().union(*split))
        known = self.cache.__getitem__
        out = [(list(map(known, units)), place) for units, (_, place) in zip(split, normal, strict=True)]
        for u in large:
            del self.cache[u]
        return out

    def ids(self, units: list[Unit]) -> list[int]:
        return [int(i) for i in b"".join([u[0] for u in units]).split(b",")[1:]]

    def decode(self, units: list[Unit]) -> bytes:
        out = b"".join([u[1] for u in units])
        return out[1:] if (self.normalize.dummy or self.normalize.squeeze) and out[:1] == b" " else out

    def spans(self, units: list[Unit], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begins and ends of the pieces in the source."""
        lengths = np.frombuffer(b"".join([u[2] for u in units]), np.uint8)
        upto = np.zeros(len(lengths) + 1, np.int64)
        np.cumsum(lengths, out=upto[1:])
        at = place[upto]
        return at[:-1], at[1:]


def _codec(model: bytes) -> PieceCodec:
    """One codec for each worker process and model."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = PieceCodec(model)
    return _CODECS[key]


COLUMNS = {
    "n_tokens": (pa.int64(), "bigint"),
    "ids": (pa.list_(pa.int32()), "array<int>"),
    "begins": (pa.list_(pa.int64()), "array<bigint>"),
    "ends": (pa.list_(pa.int64()), "array<bigint>"),
    "decoded": (pa.string(), "string"),
    "ids_sha256": (pa.string(), "string"),
    "decoded_sha256": (pa.string(), "string"),
    "spans_sha256": (pa.string(), "string"),
}
WHOLE = ("n_tokens", "ids", "begins", "ends", "decoded")


def encode_pieces(docs: DataFrame, path: str, columns: tuple[str, ...] = WHOLE, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id and the ``columns`` asked for, out of those in ``COLUMNS``.

    ``spans_sha256`` is that of all begins and then all ends as little-endian 64-bit numbers.
    """
    slim = docs.select(named(id_col).alias("doc_id"), named(text).alias("text"))
    with open(path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model.value)

        def row(units: list[Unit], place: np.ndarray) -> dict[str, object]:
            begins, ends = codec.spans(units, place)
            decoded = codec.decode(units)
            out = {"n_tokens": len(begins), "begins": begins, "ends": ends}
            if "ids" in columns:
                out["ids"] = codec.ids(units)
            if "decoded" in columns:
                out["decoded"] = decoded.decode()
            out["ids_sha256"] = hashlib.sha256(b"".join([u[0] for u in units])[1:]).hexdigest()
            out["decoded_sha256"] = hashlib.sha256(decoded).hexdigest()
            if "spans_sha256" in columns:
                out["spans_sha256"] = hashlib.sha256(begins.astype("<i8").tobytes() + ends.astype("<i8").tobytes()).hexdigest()
            return out

        for b in batches:
            for at in range(0, b.num_rows, ROWS_AT_ONCE):
                part = b.slice(at, ROWS_AT_ONCE)
                made = [row(*x) for x in codec.encode([t or "" for t in part.column("text").to_pylist()])]
                arrays = [pa.array([m[c] for m in made], COLUMNS[c][0]) for c in columns]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *arrays], ["doc_id", *columns])

    return slim.mapInArrow(tidy(rows), ", ".join(["doc_id bigint", *(f"{c} {COLUMNS[c][1]}" for c in columns)]))
