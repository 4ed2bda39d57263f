"""Tokens of lower-cased text, many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_INSIDE = np.zeros(256, bool)
_INSIDE[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")] = True
LEAST = 2


def token_slices(texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, pa.Array]]:
    """For runs of whole texts of about `limit` bytes: the first and the number of texts, and of each token the text
    in the run and the token.  Null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "").cast(pa.large_binary())
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        yield lo, hi - lo, *_tokens(whole[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        lo = hi


def _tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    n = len(buf)
    inside = _INSIDE[buf]
    first = np.zeros(n, bool)
    first[1:] = ~inside[:-1]
    begins = offs[:-1]
    first[begins[begins < n]] = True
    start = np.flatnonzero(inside & first)
    before = np.concatenate([[0], np.cumsum(inside)])
    size = np.diff(np.append(before[start], before[-1]))  # bytes inside from one start to the next
    long = size >= LEAST
    data = buf[inside][np.repeat(long, size)]
    edge = np.concatenate([[0], np.cumsum(size[long])])
    tokens = pa.Array.from_buffers(pa.large_string(), int(long.sum()), [None, pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(data)])
    return np.searchsorted(offs, start[long], side="right") - 1, tokens
