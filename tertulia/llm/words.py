"""Words and shingles of whole texts, on the bytes of Arrow string columns.

A word is a run of bytes other than space and 0x09-0x0D, with A-Z lower-cased; both
rules are about single bytes, so UTF-8 needs no decoding. Words get 64-bit hashes from
running sums over the bytes. Work goes in pieces of about a megabyte, cut at white
space, so a very long text needs no more memory than a short one beyond its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
SHINGLE = 5

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, dtype=bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_CODES = np.random.Generator(np.random.PCG64(20240)).integers(1, 1 << 63, 256, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit number over all of them."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    filled, factor = 1, base
    while filled < n:
        step = min(filled, n - filled)
        out[filled : filled + step] = out[:step] * np.uint64(factor)
        filled += step
        factor = factor * factor % (1 << 64)
    return out


class Words:
    """Splits byte pieces into words; keeps the tables of powers between pieces.

    ``blank`` says which bytes, lower-cased, are no part of a word.
    """

    def __init__(self, blank: np.ndarray = BLANK):
        self.blank = blank
        self.up = _powers(_BASE, PIECE + 1)
        self.down = _powers(_INVERSE, PIECE + 1)

    def of(self, data: np.ndarray, cuts: np.ndarray | None = None):
        """Starts, ends, hashes and lower-cased bytes; no word spans a position in ``cuts``."""
        low = LOWER[data]
        solid = ~self.blank[low]
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        if cuts is not None and len(cuts):
            begins[cuts] = solid[cuts]
        stops = solid.copy()  # the last byte of each word
        stops[:-1] &= ~solid[1:] | begins[1:]
        starts = np.flatnonzero(begins)
        ends = np.flatnonzero(stops) + 1
        if len(low) > len(self.up):
            self.up, self.down = _powers(_BASE, len(low) + 1), _powers(_INVERSE, len(low) + 1)
        sums = np.empty(len(low) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(_CODES[low] * self.up[: len(low)], out=sums[1:])
        self.sums = sums
        return starts, ends, self.span_hashes(starts, ends), low

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges of the piece that was split last."""
        raw = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        return mixed(raw + (ends - starts).astype(np.uint64))


def pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """Parts of one text of about PIECE bytes, cut before white space."""
    at = 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        while end < len(data) and not BLANK[data[end]]:
            ahead = np.flatnonzero(BLANK[data[end : end + PIECE]])
            end = end + int(ahead[0]) if len(ahead) else min(len(data), end + PIECE)
        yield data[at:end]
        at = end


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)
    offsets = offsets[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw else np.zeros(0, dtype=np.uint8)
    return data, offsets


def runs(offsets: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows with about ``most`` bytes together."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end
        at = end


def word_hashes(split: Words, data: np.ndarray, offsets: np.ndarray, first: int, last: int):
    """Word hashes of rows ``first`` to ``last`` and how many belong to each row."""
    span = data[offsets[first] : offsets[last]]
    if last == first + 1 and len(span) > PIECE:
        hashes = [split.of(p)[2] for p in pieces(span)]
        found = np.concatenate(hashes)
        return found, np.array([len(found)])
    if not len(span):
        return np.zeros(0, dtype=np.uint64), np.zeros(last - first, dtype=np.int64)
    local = offsets[first : last + 1] - offsets[first]
    starts, _, hashes, _ = split.of(span, local[:-1][local[:-1] < len(span)])
    return hashes, np.diff(np.searchsorted(starts, local))


_TURNS = [np.uint64(x | 1) for x in (0x8CB92BA72F3D8DD7, 0x2545F4914F6CDD1D, 0xC2B2AE3D27D4EB4F,
                                     0x165667B19E3779F9, 0xA0761D6478BD642F)]


def shingles(hashes: np.ndarray, most: int = SHINGLE) -> np.ndarray:
    """Hashes of the runs of ``most`` words; a shorter sequence is one shingle, none for no words."""
    n = len(hashes)
    if n == 0:
        return hashes
    size = min(n, most)
    out = np.zeros(n - size + 1, dtype=np.uint64)
    for i in range(size):
        out += mixed(hashes[i : n - size + 1 + i] * _TURNS[i])
    return mixed(out + np.uint64(size))


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    keep = np.ones(len(values), dtype=bool)
    np.not_equal(values[1:], values[:-1], out=keep[1:])
    return values[keep]


def shingle_sets(
    column: pa.Array, split: Words | None = None, shorter: tuple[int, ...] = ()
) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each row, with those of all runs of ``shorter`` words."""
    split = split or Words()
    data, offsets = buffers(column)
    for first, last in runs(offsets):
        hashes, counts = word_hashes(split, data, offsets, first, last)
        every = shingles(hashes)  # those across two rows are not used
        more = [(size, shingles(hashes, size)) for size in shorter]
        at = 0
        for n in counts.tolist():
            whole = every[at : at + n - SHINGLE + 1] if n >= SHINGLE else shingles(hashes[at : at + n])
            parts = [found[at : at + n - size + 1] for size, found in more if n >= size]
            yield distinct(np.concatenate([whole, *parts]) if parts else whole)
            at += n
