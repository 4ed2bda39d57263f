"""Vectorised word splitting and hashing over Arrow string columns.

A word is a run of bytes outside [\\x20\\x09-\\x0D].  All functions work on a batch of whole
texts laid end to end in one byte buffer, so the cost is per byte and not per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = b" \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
_ODD = U(0x9E3779B97F4A7C15)
_ODD_2 = U(0xC2B2AE3D27D4EB4F)
_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], U)
#: Words of more bytes are hashed one by one.
_LONG = 256
_rng = np.random.Generator(np.random.PCG64(20240501))
_GRAM = _rng.integers(0, 2**63, 64, dtype=U) * U(2) + U(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


@dataclass
class Texts:
    """Some whole texts: bytes laid end to end and len + 1 offsets."""

    buf: np.ndarray
    offs: np.ndarray
    first: int

    def __len__(self) -> int:
        return len(self.offs) - 1

    def parts(self, most: int) -> Iterator[Texts]:
        """The same texts, at most so many at a time."""
        for lo in range(0, len(self), most):
            hi = min(len(self), lo + most)
            a, b = self.offs[lo], self.offs[hi]
            yield Texts(self.buf[a:b], self.offs[lo : hi + 1] - a, self.first + lo)

    def text(self, i: int) -> bytes:
        return self.buf[self.offs[i] : self.offs[i + 1]].tobytes()


def text_slices(column: pa.Array | pa.ChunkedArray, limit: int = 1 << 21) -> Iterator[Texts]:
    """The column in runs of whole texts of about `limit` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if not len(column):
        return
    column = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        yield Texts(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], lo)
        lo = hi


@dataclass
class Words:
    """Words of a Texts: byte ranges, place of the text, and counts by text."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    bound: np.ndarray  # words of text i are bound[i]:bound[i + 1]


def find_words(t: Texts) -> Words:
    n = len(t.buf)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(z, z, z, np.zeros(len(t) + 1, np.int64))
    word = ~_SPACE[t.buf]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    begins = t.offs[:-1]
    before[begins[begins < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    ends = t.offs[1:] - 1
    after[ends[ends >= 0]] = False
    start = np.flatnonzero(word & ~before)
    end = np.flatnonzero(word & ~after) + 1
    bound = np.searchsorted(start, t.offs)
    doc = np.repeat(np.arange(len(t)), np.diff(bound))
    return Words(start, end, doc, bound)


def hash_words(t: Texts, w: Words, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes, wherever the word stands; another seed gives an independent one.

    A word is taken eight bytes at a time, and the state is mixed after each, so no arrangement of few letters
    cancels out as it would in a polynomial modulo a power of two.
    """
    n = len(t.buf)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = t.buf
    eight = np.ndarray((n + 1,), "<u8", padded, strides=(1,))
    size = w.end - w.start
    start = U(0x5851F42D4C957F2D * (2 * seed + 1) % 2**64)
    h = mix(size.astype(U) * _ODD_2 + start)
    h = mix(h ^ (eight[w.start] & _BYTES[np.minimum(size, 8)]))
    todo = np.flatnonzero((size > 8) & (size <= _LONG))
    at = 8
    while len(todo):
        left = size[todo] - at
        h[todo] = mix(h[todo] * _ODD ^ (eight[w.start[todo] + at] & _BYTES[np.minimum(left, 8)]))
        at += 8
        todo = todo[left > 8]
    for i in np.flatnonzero(size > _LONG):
        h[i] = hash_bytes(t.buf[w.start[i] : w.end[i]], seed)
    return h


def hash_bytes(data: bytes | np.ndarray, seed: int = 0) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8, key=b"%d" % seed).digest(), "little")


def grams(h: np.ndarray, w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of k consecutive words of one text, and the place of the first word."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    at = np.flatnonzero(w.doc[: n] == w.doc[k - 1 :])
    s = h[:n] * _GRAM[0]
    for j in range(1, k):
        s += h[j : n + j] * _GRAM[j]
    return mix(s[at]), at


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of pairs."""
    n = min(len(a), len(b))
    x = a[:n] * _ODD + b[:n]
    x ^= x >> U(32)
    x *= _ODD_2
    x ^= x >> U(29)
    return x


def long_grams(h: np.ndarray, w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """As grams, at a cost that grows with the logarithm of k: windows of 1, 2, 4, ... words, each of two
    halves, make up those of k."""
    if len(h) < k:
        return np.zeros(0, U), np.zeros(0, np.int64)
    level, size = h, 1
    s, have = None, 0
    while size <= k:
        if k & size:
            s = level if s is None else _joined(s, level[have:])
            have += size
        size *= 2
        if size <= k:
            level = _joined(level, level[size // 2 :])
    at = np.flatnonzero(w.doc[: len(h) - k + 1] == w.doc[k - 1 :])
    return mix(s[at]), at


def shingle_sets(h: np.ndarray, w: Words, n_docs: int, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of k-word windows by text, ascending in each; a shorter text is one window.

    Returns the hashes and n_docs + 1 bounds.
    """
    s, at = grams(h, w, k)
    doc = w.doc[at]
    counts = np.diff(w.bound)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        more = np.array([_short(h[w.bound[i] : w.bound[i + 1]]) for i in short], U)
        s, doc = np.concatenate([s, more]), np.concatenate([doc, short])
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    if len(s):
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
        s, doc = s[keep], doc[keep]
    return s, np.searchsorted(doc, np.arange(n_docs + 1))


def _short(h: np.ndarray) -> int:
    return int(mix(np.array([(h * _GRAM[: len(h)]).sum(dtype=U) + U(len(h))], U))[0])


def per_text(flags: np.ndarray, t: Texts) -> np.ndarray:
    """How many bytes of each text are flagged."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[t.offs[1:]] - total[t.offs[:-1]]
