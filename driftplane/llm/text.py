"""Vectorised text primitives shared by the llm operators.

A :class:`Block` holds the code points of a run of documents in one array, so that
words, lines, hashes and n-grams of thousands of documents are a few numpy calls.
Blocks are cut by size (``BLOCK_CHARS``), never inside a document; memory is bounded by
the block size or by the longest single document.

Hashes are 64-bit: a polynomial over mixed code points modulo 2**64, finished by an
avalanche step.  They are pure functions of the text, equal on every machine.
"""

from __future__ import annotations

import ctypes
import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_CHARS = 1 << 18
U64 = np.uint64
_BASE, _STEP = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_INV = pow(_BASE, -1, 1 << 64)
_pow = np.ones(1, U64), np.ones(1, U64)


def mix(h: np.ndarray) -> np.ndarray:
    """Avalanche step over uint64, in place; returns its argument."""
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(29)
    h *= U64(0xA0761D6478BD642F)
    h ^= h >> U64(32)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow
    if len(_pow[0]) < n:
        size = 1 << max(20, int(n - 1).bit_length())
        out = []
        for b in (_BASE, _INV):
            p = np.full(size, b, U64)
            p[0] = 1
            out.append(np.cumprod(p))
        _pow = out[0], out[1]
    return _pow


@functools.cache
def letter_table() -> np.ndarray:
    """uint8 per code point: 1 letter, 2 upper-case letter, 4 decimal digit, 8 mark."""
    t = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            t[c] = 3 if s.isupper() else 1
        elif s.isdecimal():
            t[c] = 4
        elif c > 767 and unicodedata.category(s)[0] == "M":
            t[c] = 8
    return t


@functools.cache
def lower_table() -> np.ndarray:
    """Lower-case code point of each code point (itself where lower-casing gives several)."""
    t = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        if len(low := chr(c).lower()) == 1:
            t[c] = ord(low)
    return t


def is_token(cp: np.ndarray) -> np.ndarray:
    """Code points of words ``[^\\x20\\x09-\\x0D]+``."""
    return (cp != 32) & ((cp - np.uint32(9)) > 4)


def ascii_lower(cp: np.ndarray) -> np.ndarray:
    return np.where((cp - np.uint32(65)) < 26, cp + np.uint32(32), cp)


class Block:
    """Some documents' code points, each document followed by one line feed."""

    def __init__(self, texts: list[str]):
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        self.n = len(texts)
        self.cp = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
        self.end = np.cumsum(lens + 1) - 1
        self.start = self.end - lens
        self.chars = lens

    def runs(self, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and documents of the runs of ``mask`` (False on separators)."""
        edge = np.flatnonzero(mask[1:] != mask[:-1]) + 1
        if mask[0]:
            edge = np.concatenate(([0], edge))
        s, e = edge[0::2], edge[1::2]
        return s, e, self.doc(s)

    def doc(self, pos: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.end, pos, "left")

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.runs(is_token(self.cp))

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends (without the line feed) and documents of the \\n-split lines."""
        e = np.flatnonzero(self.cp == 10)
        s = np.concatenate(([0], e[:-1] + 1))
        return s, e, self.doc(e)

    def sums(self, mask: np.ndarray) -> np.ndarray:
        """Per document, how many code points are in ``mask``."""
        c = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=c[1:])
        return c[self.end] - c[self.start]


class Hasher:
    """Hashes of any spans of an array of code points."""

    def __init__(self, cp: np.ndarray):
        p, self.inv = _powers(len(cp) + 1)
        t = (cp.astype(U64) + U64(0x632BE59BD9B4E019)) * U64(0xE7037ED1A0B428DB)
        t ^= t >> U64(31)
        t *= p[: len(cp)]
        self.h = np.zeros(len(cp) + 1, U64)
        np.cumsum(t, out=self.h[1:])

    def spans(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        h = self.h[e] - self.h[s]
        h *= self.inv[s]
        h += (e - s).astype(U64) * U64(_STEP)
        return mix(h)


def hash_text(s: str) -> int:
    """The hash that :class:`Hasher` gives to a whole string."""
    cp = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4")
    return int(Hasher(cp).spans(np.zeros(1, np.int64), np.array([len(cp)]))[0])


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive word hashes, by position; document limits are the caller's."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    out = h[:m].copy()
    for j in range(1, n):
        out *= U64(_STEP)
        out += h[j : m + j]
    return mix(out)


def firsts(doc: np.ndarray, n: int) -> np.ndarray:
    """Positions where ``n`` consecutive words belong to one document."""
    return np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :]) if len(doc) >= n else np.zeros(0, np.int64)


@functools.cache
def _trim():
    """The C library's way to give freed memory back, if it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return lambda _: 0


def release() -> None:
    """Gives freed memory back to the system: Python workers live on between stages."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def slices(col: pa.Array, limit: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text each, one row at least."""
    size = np.asarray(pc.fill_null(pc.binary_length(col), 0)).astype(np.int64) + 1
    upto = np.cumsum(size)
    lo, n = 0, len(size)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + limit, "right")))
        yield lo, hi
        lo = hi
    release()


def texts_of(col: pa.Array) -> list[str]:
    """Null counts as the empty text."""
    return ["" if x is None else x for x in col.to_pylist()]


def member(sorted_keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Position of each x in ``sorted_keys``, or -1."""
    if not len(sorted_keys):
        return np.full(len(x), -1, np.int64)
    at = np.searchsorted(sorted_keys, x)
    at[at == len(sorted_keys)] = 0
    return np.where(sorted_keys[at] == x, at, -1)
