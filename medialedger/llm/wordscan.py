"""Words and rolling hashes of whole Arrow batches, without a Python loop over documents or words.

A word is a run of bytes other than space and U+0009 to U+000D; bytes of multi-byte UTF-8 characters are never white
space, so the bytes can be scanned as they are. A word's hash is the sum of a mixed number for each byte and its place, so no
pattern of bytes cancels out. Hashes of runs of words are polynomials modulo the prime 2**61 - 1 from prefix sums (Rabin-Karp),
finished with a mixing step; modulo a power of two, long runs of certain patterns would collide whatever the base is.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SEGMENT = 1 << 18
_U = np.uint64
_PRIME = (1 << 61) - 1
_P = _U(_PRIME)
_BASES = {"gram": 0x1D6E8FEB86659FD9, "side": 0x10761D6478BD642F}
_powers: dict[str, tuple[np.ndarray, np.ndarray]] = {}

IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits of a uint64 array."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, for any 64-bit x."""
    x = (x >> _U(61)) + (x & _P)
    return np.where(x >= _P, x - _P, x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, both below it: the product in halves of 31 bits, whose parts stay below 2**64."""
    a_high, a_low, b_high, b_low = a >> _U(31), a & _U(0x7FFFFFFF), b >> _U(31), b & _U(0x7FFFFFFF)
    middle = a_low * b_high + a_high * b_low
    return _reduced(_U(2) * a_high * b_high + (middle >> _U(30)) + ((middle & _U(0x3FFFFFFF)) << _U(31)) + _reduced(a_low * b_low))


def _prefix_sums(x: np.ndarray) -> np.ndarray:
    """Sums of the first i numbers below the prime, modulo it; one more than there are numbers (fewer than 2**31)."""
    out = np.zeros(len(x) + 1, dtype=np.uint64)
    high = _reduced(np.cumsum(x >> _U(31)))
    turned = ((high << _U(31)) & _P) | (high >> _U(30))  # times 2**31
    out[1:] = _reduced(turned + _reduced(np.cumsum(x & _U(0x7FFFFFFF))))
    return out


def _powers_of(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    size, step = 1, base
    while size < n:
        more = out[size : 2 * size]
        more[:] = _times(out[: len(more)], np.full(len(more), step, dtype=np.uint64))
        size, step = 2 * size, step * step % _PRIME
    return out


def _power(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo the prime for i below n at least."""
    have = _powers.get(kind)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16, 2 * len(have[0]) if have else 0)
        have = _powers[kind] = (_powers_of(_BASES[kind], size), _powers_of(pow(_BASES[kind], -1, _PRIME), size))
    return have


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: str) -> np.ndarray:
    """Hash of values[start:end] for each pair, from one prefix sum; the values are hashes themselves."""
    up, down = _power(kind, len(values) + 1)
    prefix = _prefix_sums(_times(_reduced(values), up[: len(values)]))
    return mix(_times(_reduced(prefix[ends] + (_P - prefix[starts])), down[starts]))


def bytes_hash(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes in each span; spans are not empty, rise and don't overlap. ``codes`` are the bytes' random numbers."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    lengths = (ends - starts).astype(np.uint64)
    place = np.arange(len(codes) + 1, dtype=np.uint64)
    place[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, len(place)))).astype(np.uint64)
    place *= _U(0x9FB21C651E98DF25)
    place[:-1] += codes
    place ^= place >> _U(32)
    place *= _U(0xD6E8FEB86659FD93)
    place ^= place >> _U(29)
    bounds = np.column_stack([starts, ends]).ravel()
    return mix(np.add.reduceat(place, bounds)[::2] + lengths * _U(0xA0761D6478BD642F))


@dataclass
class Words:
    """The words of some rows in order: row number, hash, and byte range in ``data``."""

    data: np.ndarray
    offsets: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray

    @property
    def per_row(self) -> np.ndarray:
        return np.bincount(self.row, minlength=len(self.offsets) - 1)

    @property
    def first(self) -> np.ndarray:
        """For each row the number of its first word; one more entry for the end."""
        return np.concatenate([[0], np.cumsum(self.per_row)])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column (null: empty) and the offsets of its rows."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _segments(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about a quarter of a megabyte that end at a row's end or, in a longer row, at white space."""
    at, n = 0, len(data)
    while at < n:
        row = np.searchsorted(offsets, at + _SEGMENT, "right") - 1
        end = int(offsets[row])
        if end <= at:  # a row of more than a segment
            limit = int(offsets[np.searchsorted(offsets, at, "right")])
            end = min(at + _SEGMENT, limit)
            while end < limit:
                gap = np.flatnonzero(~IS_WORD[data[end : min(limit, end + _SEGMENT)]])
                if len(gap):
                    end += int(gap[0])
                    break
                end = min(limit, end + _SEGMENT)
        yield at, end
        at = end


def scan_words(column: pa.Array, fold: bool = False) -> Words:
    """The words of a string column; with ``fold``, A-Z count as a-z."""
    data, offsets = text_bytes(column)
    table = _FOLDED if fold else _BYTE
    parts = []
    for lo, hi in _segments(data, offsets):
        part = data[lo:hi]
        inside = IS_WORD[part]
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        cuts = offsets[np.searchsorted(offsets, lo, "left") : np.searchsorted(offsets, hi, "left")] - lo
        cuts = cuts[cuts > 0]
        begins[cuts] = inside[cuts]
        stops[cuts - 1] = inside[cuts - 1]
        s, e = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        parts.append((bytes_hash(table[part], s, e), s + lo, e + lo))
    if not parts:
        none = np.zeros(0, dtype=np.int64)
        return Words(data, offsets, none, none.astype(np.uint64), none, none)
    hashes, starts, ends = (np.concatenate(x) for x in zip(*parts, strict=True))
    return Words(data, offsets, np.searchsorted(offsets, starts, "right") - 1, hashes, starts, ends)


def windows(words: Words, k: int, kind: str = "gram") -> tuple[np.ndarray, np.ndarray]:
    """(number of the first word, hash) of every run of k consecutive words of one row."""
    n = len(words.hash) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    at = np.flatnonzero(words.row[:n] == words.row[k - 1 :])
    return at, spans_hash(words.hash, at, at + k, kind)


def distinct_rows(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks over (row, hash) pairs in order: is it the first of its kind, and does its kind occur twice or more?"""
    first, again = np.ones(len(rows), dtype=bool), np.zeros(len(rows), dtype=bool)
    order = np.lexsort((hashes, rows))
    same = (hashes[order[1:]] == hashes[order[:-1]]) & (rows[order[1:]] == rows[order[:-1]])
    first[order[1:][same]] = False
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return first, again


def give_back() -> None:
    """Return free memory to the system at a task's end: Python workers outlive their tasks, some of them idle."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows of about ``max_bytes`` of text; one longer row comes by itself."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        at = 0
        while at < len(batch):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + max_bytes, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end
        del batch
    give_back()
