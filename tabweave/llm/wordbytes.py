"""Words of a batch of texts as bytes: all separators are ASCII, so no text is decoded and no object is made per word."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from tabweave.llm.arrays import mix, segment_hashes

SLICE_BYTES = 8_000_000


def byte_table(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode())] = True
    return table


@dataclass
class Words:
    """data: the bytes of all words, one after another; offsets: where each begins there, and the end; doc: the text each
    is of; broken: whether a break, or the begin of a text, stands before it."""

    data: np.ndarray
    offsets: np.ndarray
    doc: np.ndarray
    broken: np.ndarray

    def __len__(self) -> int:
        return len(self.doc)

    def strings(self) -> pa.Array:
        return pa.Array.from_buffers(pa.large_utf8(), len(self), [None, pa.py_buffer(self.offsets.astype(np.int64)), pa.py_buffer(self.data)])

    def hashes(self) -> np.ndarray:
        return segment_hashes(self.data, self.offsets[:-1], self.offsets[1:])


def _words(data: np.ndarray, doc_offsets: np.ndarray, gap: np.ndarray, cut: np.ndarray | None) -> Words:
    between = gap[data]
    breaks = None
    if cut is not None:
        breaks = cut[data]
        between |= breaks
    solid = ~between
    first = solid.copy()
    first[1:] &= between[:-1]
    inner = doc_offsets[:-1]
    inner = inner[inner < len(data)]
    first[inner] = solid[inner]
    at = np.flatnonzero(first)
    offsets = np.append(np.cumsum(solid, dtype=np.int64)[at] - 1, int(solid.sum()))
    doc = np.searchsorted(doc_offsets, at, side="right") - 1
    broken = np.ones(len(at), bool)
    if len(at):
        broken[1:] = doc[1:] != doc[:-1]
        if breaks is not None:
            seen = np.cumsum(breaks, dtype=np.int64)[at]
            broken[1:] |= seen[1:] != seen[:-1]
    return Words(data[solid], offsets, doc, broken)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def word_slices(column: pa.Array, gap: np.ndarray, cut: np.ndarray | None = None, lower: bool = False, most: int = SLICE_BYTES):
    """Words of a string column (null: empty), in slices of about `most` bytes. A slice ends with a text, or inside one
    at a break (where there are breaks) or between words (where there are none); only a piece without such a place is
    longer. Yields (Words, number of the slice's first text)."""
    column = (column if column.type == pa.large_string() else column.cast(pa.large_string())).fill_null("")
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data_buffer, np.uint8)[offsets[0] : offsets[-1]] if data_buffer is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    ending = gap if cut is None else cut
    lo = 0
    while lo < len(data):
        hi = min(lo + most, len(data))
        if hi < len(data):
            begin = int(offsets[np.searchsorted(offsets, hi, side="right") - 1])
            if begin > lo:
                hi = begin
            else:  # inside one text
                end = int(offsets[np.searchsorted(offsets, lo, side="right")])
                hi = end if end <= hi else _break_before(data, lo, hi, end, ending)
        from_doc, to_doc = int(np.searchsorted(offsets, lo, side="right")) - 1, int(np.searchsorted(offsets, hi, side="left"))
        part = data[lo:hi]
        yield _words(lowered(part) if lower else part, np.clip(offsets[from_doc : to_doc + 1], lo, hi) - lo, gap, cut), from_doc
        lo = hi


def _break_before(data: np.ndarray, lo: int, hi: int, end: int, ending: np.ndarray) -> int:
    """After the last separator of data[lo:hi], or after the first one from hi on."""
    at = np.flatnonzero(ending[data[lo:hi]])
    if len(at):
        return lo + int(at[-1]) + 1
    step = 1 << 16
    while hi < end:
        at = np.flatnonzero(ending[data[hi : min(hi + step, end)]])
        if len(at):
            return hi + int(at[0]) + 1
        hi = min(hi + step, end)
    return end


def gram_hashes(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A hash of every n consecutive values, by doubling: place i is that of h[i : i + n]."""
    factor = np.uint64(0x9E3779B97F4A7C15 ^ (2 * seed))
    join = lambda a, b, shift: mix(a[: len(b) - shift] * factor + b[shift:]) if len(b) > shift else b[:0]
    with np.errstate(over="ignore"):
        out, have, level, size = None, 0, h, 1
        while size <= n:
            if n & size:
                out = level if out is None else mix(out[: max(0, len(level) - have)] * factor + level[have : have + len(out)])
                have += size
            level, size = join(level, level, size), size * 2
    return out[: max(0, len(h) - n + 1)]


def sliding_min(g: np.ndarray, n: int) -> np.ndarray:
    """The least of every n consecutive values."""
    size = 1
    whole = max(0, len(g) - n + 1)
    while 2 * size <= n:
        g = np.minimum(g[: max(0, len(g) - size)], g[size:])
        size *= 2
    return np.minimum(g[:whole], g[n - size : n - size + whole])
