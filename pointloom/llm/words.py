"""Vectorised word tables over Arrow string buffers.

Python workers see each Arrow batch as two flat buffers (bytes and offsets).
Everything here runs on those with numpy, in chunks of bounded size, so that a
worker's memory depends neither on the batch nor on the number of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
U64 = np.uint64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: Bytes of a word: anything but space and \t \n \v \f \r.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: Bytes of a word: digits, letters a-z (text is lower-cased first), anything not ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift, multiply) on uint64 arrays."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


def exact_pairs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers for each byte string data[start:end] that tell any two different strings apart.

    Up to 15 bytes are held as they are, with their length in the highest byte;
    a longer string has 120 bits of its BLAKE2b digest and 255 there.
    """
    padded = np.concatenate([data, np.zeros(16, dtype=np.uint8)])
    eight = np.ndarray((len(data) + 9,), dtype="<u8", buffer=padded, strides=(1,))
    length = ends - starts
    low = np.minimum(length, 8)
    high = np.clip(length - 8, 0, 7)
    a = eight[starts].astype(U64) & _MASKS[low]
    b = (eight[np.minimum(starts + 8, len(data))].astype(U64) & _MASKS[high]) | (np.minimum(length, 255).astype(U64) << U64(56))
    long = np.flatnonzero(length > 15)
    if len(long):
        raw = data.tobytes()
        digests = b"".join(hashlib.blake2b(raw[x:y], digest_size=16).digest() for x, y in zip(starts[long].tolist(), ends[long].tolist()))
        both = np.frombuffer(digests, dtype="<u8").reshape(-1, 2)
        a[long], b[long] = both[:, 0], both[:, 1] | U64(255 << 56)
    return a, b


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U64)


def scramble(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit hash of two numbers."""
    with np.errstate(over="ignore"):
        return mix(a ^ mix(b + U64(0x9E3779B97F4A7C15)))


class Chunk:
    """Some consecutive rows of a batch: their text bytes and their words."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets
        self.rows = len(offsets) - 1
        inside = self.inside = kind[data]
        before = np.zeros(len(data), dtype=bool)
        after = np.zeros(len(data), dtype=bool)
        if len(data):
            before[1:] = inside[:-1]
            after[:-1] = inside[1:]
            before[offsets[:-1][offsets[:-1] < len(data)]] = False
            ends = offsets[1:]
            after[ends[ends > 0] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        #: Index of the first word of each row, and the number of all words at the end.
        self.word_offsets = np.searchsorted(self.starts, offsets)
        self.word_offsets[-1] = len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.word_offsets)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.counts)

    def identities(self, first: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The :func:`exact_pairs` of each word, or of its first so many bytes."""
        return exact_pairs(self.data, self.starts, self.ends if first is None else np.minimum(self.ends, self.starts + first))

    def hashes(self, first: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word, or of its first so many bytes."""
        return scramble(*self.identities(first))

    def joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, starts, ends): the words with single spaces between those of a row."""
        keep = self.inside.copy()
        gaps = self.ends[self.ends < len(self.data)]
        gaps = gaps[~keep[gaps]]
        data = self.data.copy()
        data[gaps] = 0x20
        keep[gaps] = True
        place = np.cumsum(keep)
        return data[keep], place[self.starts] - 1, place[self.ends - 1]


def pieces(texts: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets): a string column (null: empty) in pieces of about ``limit`` bytes, whole rows each."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    _, raw, body = texts.buffers()
    offsets = np.frombuffer(raw, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        to = min(to, n)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def chunks(texts: pa.Array | pa.ChunkedArray, kind: np.ndarray, lower: bool = False, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The :func:`pieces` of a string column with their words."""
    for at, data, offsets in pieces(texts, limit):
        yield Chunk(at, LOWER[data] if lower else data, offsets, kind)


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive entries (order matters); shorter by n - 1."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=U64)
    with np.errstate(over="ignore"):
        out = np.zeros(m, dtype=U64)
        for j in range(n):
            out = out * U64(0x9E3779B97F4A7C15) + hashes[j : j + m]
        return mix(out)


def covered(length: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Boolean array: the positions inside any of the half-open spans."""
    edge = np.bincount(starts, minlength=length + 1)[: length + 1] - np.bincount(ends, minlength=length + 1)[: length + 1]
    return np.cumsum(edge)[:length] > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half-open [start, end) of each run of True."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
