"""Hashes shuffled as sorted, delta-coded blocks instead of rows.

A row holds, for one run of documents and one range of the hash space, the ascending 50-bit hashes found in
those documents as 4-byte steps, the place of each one's document (2 bytes), and a table of the documents.
That is about 6 bytes a hash, a fifth of what a row of two longs costs in a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

HASH_BITS = 50
PLACE_BITS = 14
MOST_DOCS = (1 << PLACE_BITS) - 1
_PLACE = np.uint64((1 << PLACE_BITS) - 1)
_FILL = 0xFFFF


def range_bits(items: int, per_range: int = 2_000_000) -> int:
    """How many leading bits name a range, for about so many hashes in each."""
    return max(0, min(24, int(np.ceil(np.log2(max(1, items / per_range))))))


def packed(h: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The leading 50 bits of each hash before the place of its document; sorts by hash, then place."""
    return (h >> np.uint64(64 - HASH_BITS)) << np.uint64(PLACE_BITS) | place.astype(np.uint64)


def unpacked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return key >> np.uint64(PLACE_BITS), (key & _PLACE).astype(np.int64)


def cut_ranges(h50: np.ndarray, bits: int) -> np.ndarray:
    """Bounds of the ranges in ascending 50-bit hashes."""
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(HASH_BITS - bits)
    return np.concatenate([[0], np.searchsorted(h50, edges), [len(h50)]])


def encode(h50: np.ndarray, place: np.ndarray, bits: int, p: int) -> tuple[bytes, bytes, np.ndarray]:
    """Steps, places, and the position of each hash among them (a step too large is cut by fillers)."""
    step = np.diff(h50, prepend=np.uint64(p << (HASH_BITS - bits)))
    extra = (step // np.uint64(0xFFFFFFFF)).astype(np.int64)
    if not extra.any():
        return step.astype("<u4").tobytes(), place.astype("<u2").tobytes(), np.arange(len(h50))
    at = np.arange(len(h50)) + np.cumsum(extra)
    steps = np.full(len(h50) + int(extra.sum()), 0xFFFFFFFF, "<u4")
    places = np.full(len(steps), _FILL, "<u2")
    steps[at] = step % np.uint64(0xFFFFFFFF)
    places[at] = place
    return steps.tobytes(), places.tobytes(), at


def decode(steps: bytes, places: bytes, bits: int, p: int) -> tuple[np.ndarray, np.ndarray]:
    h50 = np.cumsum(np.frombuffer(steps, "<u4").astype(np.uint64)) + np.uint64(p << (HASH_BITS - bits))
    place = np.frombuffer(places, "<u2").astype(np.int64)
    if (place == _FILL).any():
        keep = place != _FILL
        return h50[keep], place[keep]
    return h50, place


def table(columns: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


# ---------------------------------------------------------------- back to the documents

OWNED = pa.schema([("bucket", pa.int32()), ("owners", pa.binary()), ("extra", pa.binary()), ("counts", pa.binary()), ("data", pa.binary())])
OWNED_DDL = "bucket int, owners binary, extra binary, counts binary, data binary"


def by_owner(owner: np.ndarray, data: np.ndarray, bits: int, extra: np.ndarray | None = None) -> pa.RecordBatch:
    """Items and the documents they belong to, a row for each of 2**bits buckets of documents.

    extra is a number that all items of a document share.  The number of rows follows the buckets, not
    documents times ranges.
    """
    h = owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    bucket = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(owner), np.int64)
    order = np.lexsort((owner, bucket))
    owner, data, bucket = owner[order], data[order], bucket[order]
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(owner)))
    names, at = np.unique(bucket[first], return_index=True)
    edge = np.append(at, len(first))
    shared = extra[order][first] if extra is not None else np.zeros(len(first), np.int64)
    out: dict[str, list] = {f.name: [] for f in OWNED}
    for b, lo, hi in zip(names.tolist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        a, z = int(first[lo]), int(first[hi - 1] + size[hi - 1])
        for name, v in zip(OWNED.names, (b, owner[first[lo:hi]].astype("<i8").tobytes(), shared[lo:hi].astype("<i8").tobytes(), size[lo:hi].astype("<i4").tobytes(), data[a:z].tobytes()), strict=True):
            out[name].append(v)
    return table(out, OWNED)


def gathered(rows: pa.Table, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Owners, their extra, bounds, and all their items, from the rows of one bucket."""
    owners, extras, items = [], [], []
    for r in rows.to_pylist():
        size = np.frombuffer(r["counts"], "<i4")
        owners.append(np.repeat(np.frombuffer(r["owners"], "<i8"), size))
        extras.append(np.repeat(np.frombuffer(r["extra"], "<i8"), size))
        items.append(np.frombuffer(r["data"], dtype))
    owner, extra, item = np.concatenate(owners), np.concatenate(extras), np.concatenate(items)
    order = np.argsort(owner, kind="stable")
    owner, extra, item = owner[order], extra[order], item[order]
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
    return owner[first], extra[first], np.append(first, len(owner)), item
