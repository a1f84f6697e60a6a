"""Vectorised byte kernels shared by the text operators.

All kernels work on one contiguous buffer holding many texts separated by a newline byte, so a
batch of documents costs a handful of numpy passes and no per-word Python work.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Ranges that SpanHash hashes at a time: what it needs beside its results does not grow with a text's length.
_RANGES = 1 << 16
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def words_at(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place of buf as a little-endian number, zeros beyond its end; a view that costs no memory per place."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray((len(buf) + 1,), "<u8", padded.data, 0, (1,))


class SpanHash:
    """64-bit hashes of byte ranges: the sum of the range's 8-byte pieces, each mixed with its place in the range.

    A sum of mixed values has no algebra that strings could cancel by, unlike a polynomial modulo 2^64. Other seeds
    give independent hashes. The work is that of the ranges' bytes, so it suits ranges that overlap little.
    """

    def __init__(self, buf: np.ndarray, seed: int = 0):
        self._at = words_at(buf)
        self._seed = U64(seed * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15 & (1 << 64) - 1)

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        out = np.empty(len(lo), U64)
        for i in range(0, len(lo), _RANGES):
            out[i : i + _RANGES] = self._some(lo[i : i + _RANGES], hi[i : i + _RANGES])
        return out

    def rolling(self, k: int) -> np.ndarray:
        """Hashes of all k-byte ranges of the buffer, in turn; k is a multiple of 8. Not those that a call gives."""
        n = max(0, len(self._at) - k)
        w = self._at[: max(0, n + k - 8)] * U64(0x9FB21C651E98DF25)
        w ^= w >> U64(32)
        out = np.zeros(n, U64)
        for i in range(0, k, 8):
            out += w[i : i + n] * U64((int(self._seed) + i * 0xBF58476D1CE4E5B8 | 1) & (1 << 64) - 1)
        out ^= out >> U64(32)
        out *= U64(0xD6E8FEB86659FD93)
        return out

    def _pieces(self, at: np.ndarray, size: np.ndarray, place: np.ndarray) -> np.ndarray:
        piece = self._at[at] & _MASKS[np.minimum(size, 8)]
        return mix(mix(piece ^ self._seed) + (place.astype(U64) + U64(1)) * U64(0xC2B2AE3D27D4EB4F))

    def _some(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        size = hi - lo
        h = self._pieces(lo, size, np.zeros(1, np.int64))
        long = np.flatnonzero(size > 8)
        while len(long):  # so many longer ranges at a time that their pieces stay bounded, a longer one alone
            ends = np.cumsum((size[long] - 1) // 8)
            some = max(1, int(np.searchsorted(ends, 8 * _RANGES, side="right")))
            part, more = long[:some], np.diff(ends[:some], prepend=0)
            first = ends[:some] - more
            place = np.arange(int(ends[some - 1])) - np.repeat(first, more) + 1
            at = np.repeat(lo[part], more) + 8 * place
            h[part] += np.add.reduceat(self._pieces(at, np.repeat(hi[part], more) - at, place), first)
            long = long[some:]
        return mix(h + size.astype(U64) * U64(0xD6E8FEB86659FD93))


@dataclass
class Block:
    """Texts first..last of an Arrow batch: buf holds them with one newline after each."""

    first: int
    last: int
    buf: np.ndarray
    start: np.ndarray  # of each text in buf
    end: np.ndarray


def blocks(column: pa.Array, size: int = 1 << 19) -> Iterator[Block]:
    """Cuts a batch of binary values (null: empty) into blocks of about `size` bytes of whole texts."""
    return blocks_of([t or b"" for t in column.to_pylist()], size)


def blocks_of(texts: list[bytes], size: int = 1 << 19) -> Iterator[Block]:
    first = 0
    while first < len(texts):
        last, total = first, 0
        while last < len(texts) and (last == first or total + len(texts[last]) <= size):
            total += len(texts[last]) + 1
            last += 1
        part = texts[first:last]
        buf = np.frombuffer(b"\n".join(part) + b"\n", np.uint8)
        lens = np.fromiter(map(len, part), np.int64, len(part))
        start = np.zeros(len(part), np.int64)
        np.cumsum(lens[:-1] + 1, out=start[1:])
        yield Block(first, last, buf, start, start + lens)
        first = last


def byte_table(pattern: bytes | range, *more: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    for part in (pattern, *more):
        t[list(part)] = True
    return t


#: Words of the contracts: maximal runs outside [\x20\x09-\x0D].
IS_SPACE = byte_table(bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal True runs."""
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def per_text(block: Block, flags: np.ndarray) -> np.ndarray:
    """Number of True bytes in each text."""
    if not len(block.start):
        return np.zeros(0, np.int64)
    return np.add.reduceat(flags.view(np.uint8), block.start, dtype=np.int64) - flags[block.end]


def owner(block: Block, pos: np.ndarray) -> np.ndarray:
    """Index (in the block) of the text that each position lies in."""
    return np.searchsorted(block.start, pos, side="right") - 1


def grouped(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """One key for a (text of the block, hash) pair."""
    return mix(h + (doc.astype(U64) + U64(1)) * U64(0xA24BAED4963EE407))
