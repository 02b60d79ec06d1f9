"""Words, hashes and shingles of Arrow text columns as numpy arrays, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE_BYTES = 1 << 20
_BYTES = np.random.default_rng(20240229).integers(0, 2**64, 256, dtype=np.uint64)
_STEP = {"byte": 0x9E3779B97F4A7C13, "one": 0xD1B54A32D192ED0B, "two": 0xABC98388FB8FAC03}


def byte_class(breaks) -> np.ndarray:
    kept = np.ones(256, bool)
    kept[list(breaks)] = False
    return kept


#: Bytes inside words: everything but blanks; ASCII letters, digits and everything beyond ASCII.
BLANK_WORDS = byte_class([0x20, *range(0x09, 0x0E)])
PLAIN_WORDS = byte_class([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@lru_cache(maxsize=8)
def _powers(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    step = _STEP[kind]
    both = []
    for factor in (step, pow(step, -1, 2**64)):
        row = np.full(n, factor, np.uint64)
        row[0] = 1
        both.append(np.multiply.accumulate(row))
    return both[0], both[1]


def powers(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, in sizes that repeat."""
    return _powers(kind, 1 << max(16, int(n - 1).bit_length()))


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(31))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(29)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(32)
    return h


@dataclass
class Words:
    """All words of some texts. data: bytes; first, past: byte range of each word; doc: row of each word; at: index of each row's
    first word, with one more at the end."""

    data: np.ndarray
    first: np.ndarray
    past: np.ndarray
    doc: np.ndarray
    at: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self.first):
            return np.zeros(0, np.uint64)
        up, down = powers("byte", len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTES[self.data] * up[: len(self.data)], out=sums[1:])
        return mix((sums[self.past] - sums[self.first]) * down[self.first] + (self.past - self.first).astype(np.uint64))

    def position(self) -> np.ndarray:
        return np.arange(len(self.doc)) - self.at[self.doc]


def column_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and each row's byte offsets, from 0."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("" if not pa.types.is_binary(texts.type) and not pa.types.is_large_binary(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if not len(texts) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def split_words(data: np.ndarray, ends: np.ndarray, inside: np.ndarray, lower: bool) -> Words:
    """Words of rows data[ends[i]:ends[i+1]]."""
    if lower:
        data = LOWER[data]
    n, rows = len(data), len(ends) - 1
    if not n:
        return Words(data, *(np.zeros(0, np.int64) for _ in range(3)), np.zeros(rows + 1, np.int64))
    word = inside[data]
    edge = np.zeros(n + 1, bool)
    edge[ends] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    first = np.flatnonzero(word & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    past = np.flatnonzero(word & (~after | edge[1:])) + 1
    at = np.searchsorted(first, ends)
    return Words(data, first, past, np.repeat(np.arange(rows), np.diff(at)), at)


def slices(ends: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of about `limit` bytes, so that working arrays stay small; a longer row is alone."""
    i, rows = 0, len(ends) - 1
    while i < rows:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def word_slices(texts: pa.Array, inside: np.ndarray, lower: bool) -> Iterator[tuple[int, int, Words]]:
    """(first row, past row, words) over a whole column."""
    data, ends = column_bytes(texts)
    for i, j in slices(ends):
        yield i, j, split_words(data[ends[i] : ends[j]], ends[i : j + 1] - ends[i], inside, lower)


def runs(hashes: np.ndarray, k: int, kind: str = "one") -> np.ndarray:
    """Hash of every k consecutive words, also across rows (see `within`)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(kind, len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[:n])


def within(doc: np.ndarray, k: int) -> np.ndarray:
    """True where the k words from a position on belong to one row."""
    return doc[: len(doc) - k + 1] == doc[k - 1 :] if len(doc) >= k else np.zeros(0, bool)


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """True at each of n positions that some [start, start + length) holds."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + lengths, -1)
    return np.cumsum(change[:n]) > 0


def sliding_min_at(h: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest value in each window of `width`, the first of equal ones; by doubling, a few passes."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    value, place, reach = h, np.arange(len(h)), 1

    def merge(step: int):
        left, right = value[: len(value) - step], value[step:]
        later = right < left
        return np.where(later, right, left), np.where(later, place[step:], place[: len(place) - step])

    while reach * 2 <= width:
        value, place = merge(reach)
        reach *= 2
    if reach < width:
        value, place = merge(width - reach)
    return place[:n]
