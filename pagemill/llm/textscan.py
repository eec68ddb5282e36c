"""Vectorised scanning of many texts at once, over one buffer of UTF-8 bytes.

Hashes are polynomials over the bytes modulo 2**64 with an odd base, which has an
inverse: the hash of any stretch is a difference of prefix sums times a power of the
inverse. All steps are numpy passes, and a chunk of ``CHUNK_BYTES`` bounds their memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
#: A random-looking value for each byte, so that near bytes are far apart.
BYTE_VALUE = np.array([(b * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) % (1 << 64) | 1 for b in range(256)], np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True


def powers(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        base = BASE if kind == "up" else INVERSE
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = _powers[kind] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after, bytes, offsets of the rows in them) of a string column; nulls are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1, at + 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def prefix_hash(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * powers("up", len(data)), dtype=np.uint64, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each stretch; equal stretches of any two places and buffers have equal hashes."""
    return mix((prefix[ends] - prefix[starts]) * powers("down", len(prefix))[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (stretches without white space), and the words up to each row."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~IS_SPACE[data]
    first = inside[:-1].copy()
    first[1:] &= ~inside[:-2]
    rows = offsets[:-1][offsets[:-1] < len(data)]
    first[rows] = inside[rows]
    last = inside[:-1] & ~inside[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] = inside[ends]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def shingles(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct 64-bit hashes of its word shingles); A-Z count as a-z.

    A text of fewer words than ``size`` has its whole word sequence as its only shingle;
    one without words has none.
    """
    factors = np.array([pow(0xC2B2AE3D27D4EB4F, k + 1, 1 << 64) | 1 for k in range(size)], np.uint64)
    for at, to, data, offsets in chunks(column):
        data = LOWER[data]
        starts, ends, upto = words(data, offsets)
        own = span_hash(prefix_hash(data), starts, ends)
        whole = np.zeros(max(len(own) - size + 1, 0), np.uint64)
        for k in range(size):
            whole += own[k : k + len(whole)] * factors[k]
        whole = mix(whole)
        for r in range(to - at):
            a, b = upto[r], upto[r + 1]
            if b - a >= size:
                yield at + r, np.unique(whole[a : b - size + 1])
            elif b > a:
                few = np.uint64(int(b - a) * 0x9FB21C651E98DF25 % (1 << 64))
                yield at + r, mix((own[a:b] * factors[: b - a]).sum(dtype=np.uint64, keepdims=True) + few)
            else:
                yield at + r, np.zeros(0, np.uint64)
