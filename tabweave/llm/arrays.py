"""Vectorised helpers over many texts at once: code points, segments, ragged gathers and segment hashes.

A batch of texts is one array of code points plus document offsets, so the work per character is a few
NumPy passes and no Python object is made per word.
"""

from __future__ import annotations

import ctypes
import sys
import unicodedata

import numpy as np
import pyarrow as pa

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
#: White_Space of Unicode, which is what \s means to the tokenizers' patterns (fixed values).
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Letters and numbers of Unicode 16, which the tokenizers' patterns know and the interpreter's database may not (fixed values).
LATER_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
LATER_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]

_FACTORS = np.zeros(0, np.uint64)
_CLASSES: np.ndarray | None = None


def classes() -> np.ndarray:
    """A class for every code point; built once per process from the Unicode database."""
    global _CLASSES
    if _CLASSES is None:
        kinds = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
        for kind, ranges in ((LETTER, LATER_LETTERS), (NUMBER, LATER_NUMBERS)):
            for first, last in ranges:
                table[first : last + 1] = kind
        table[WHITE_SPACE] = SPACE
        _CLASSES = table
    return _CLASSES


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def release() -> None:
    """Gives memory that the last batch has left in the allocators back to the system (malloc_trim is glibc's); workers
    are reused by later stages, and an executor's memory counts all of them."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def chunks(texts: list[str], most: int = 500_000):
    """Index ranges of at most `most` characters; a longer text stands alone."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        if i > start and total + len(t) > most:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


def offsets(lengths) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[i], starts[i]+1, ... lengths[i] of them, for all i in order."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _factors(n: int) -> np.ndarray:
    """Random odd factors, one for each place of a segment; as many as the longest segment so far asks for."""
    global _FACTORS
    if len(_FACTORS) < n:
        with np.errstate(over="ignore"):
            places = np.arange(1, max(1 << 12, 1 << int(n - 1).bit_length()) + 1, dtype=np.uint64)
            _FACTORS = mix(mix(places * np.uint64(0x9E3779B97F4A7C15)) + np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)
    return _FACTORS


def segment_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[s:e] for each segment (ascending, apart); equal contents give equal hashes.

    A sum of values times the random factors of their places, so no regular pattern of values cancels out as it does in
    a polynomial modulo a power of two.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    begin, n = int(starts[0]), int(ends[-1])
    factors = _factors(int(lengths.max()))
    with np.errstate(over="ignore"):
        place = np.arange(n - begin)
        place -= np.repeat(starts - begin, np.diff(np.append(starts, n)))
        x = factors.take(place, mode="clip")  # values between two segments are in no sum
        x *= values[begin:n]
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x, out=sums[1:])
        return mix(sums[ends - begin] - sums[starts - begin] + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def run_starts(cls: np.ndarray, doc_offsets: np.ndarray) -> np.ndarray:
    """True where the class changes or a document begins."""
    out = np.empty(len(cls), bool)
    if len(cls):
        out[0] = True
        np.not_equal(cls[1:], cls[:-1], out=out[1:])
        inner = doc_offsets[:-1]
        out[inner[inner < len(cls)]] = True
    return out


def words(cps: np.ndarray, doc_offsets: np.ndarray):
    """Starts and ends of the runs that are not white space, and how many each document has."""
    cls = classes()[cps]
    solid = cls != SPACE
    first = run_starts(solid, doc_offsets)
    pos = np.flatnonzero(first)
    ends = np.append(pos[1:], len(cps))
    keep = solid[pos] if len(pos) else np.zeros(0, bool)
    starts, ends = pos[keep], ends[keep]
    return starts, ends, np.diff(np.searchsorted(starts, doc_offsets))
