"""Improbable-feature digests: entropy-ranked byte windows in chained Bloom filters.

Every window of 32 bytes has an entropy, and every entropy a rank: the fewer windows of the corpus have it, the
lower.  The counts are over all windows of all documents; digests can be compared if they were made under one
table of ranks, which has a version.  In each stretch of 32 consecutive windows (fewer at the ends of the text) the leftmost of
lowest rank scores a point; a window with at least 8 points is a feature.  Features go in order into Bloom filters of 2048 bits, 5 bits each, at most
160 to a filter.  Two digests are compared filter by filter: the bits shared beyond what chance gives, over
the most that could be shared.

Defined results: a null text is empty; an empty text has the digest "", alike 1 to another empty one and 0
to any other; a text without a feature has one, its whole bytes; equal texts have equal digests.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import _ODD, U, hash_bytes, mix

SIZE = 32
STRETCH = 32
POINTS = 8
BITS, PER_FEATURE, MOST = 2048, 5, 160
CUT = 0.3
_PART = 1 << 18

# entropy of a window from the counts of its bytes, in fixed point so that it doesn't depend on the way it is summed
_ONE = 1 << 20
_F = np.array([0, *(round(c * math.log2(c) * _ONE) for c in range(1, SIZE + 2))], np.int64)
_TOP = SIZE * _ONE * (SIZE.bit_length() - 1)
_REMOVE, _ADD = (_F[:-1] - _F[1:])[:SIZE], (_F[1:] - _F[:-1])[:SIZE]
#: Under this entropy, in thousandths, a window is a run of a few bytes; it says nothing and is never a feature.
_WEAK = 100
_NEVER = 1 << 20
_NONE = 1 << 60


def ranks_of(counts: np.ndarray) -> np.ndarray:
    """Ranks of the entropies 0 to 1000 from the number of windows that have each: the rarest first, the lower
    of equally rare ones first."""
    rank = np.empty(len(counts), np.int64)
    rank[np.lexsort((np.arange(len(counts)), counts))] = np.arange(len(counts))
    rank[:_WEAK] = _NEVER
    return rank


def version_of(ranks: np.ndarray) -> str:
    """Names a table of ranks; only digests made under one table can be compared."""
    return hashlib.sha256(ranks.astype("<i8").tobytes()).hexdigest()[:16]


def _entropies(buf: np.ndarray) -> np.ndarray:
    """Entropy in thousandths of every window."""
    n = len(buf)
    after = np.zeros(n, np.uint8)
    before = np.zeros(n, np.uint8)
    for d in range(1, SIZE):
        same = (buf[d:] == buf[:-d]).view(np.uint8)
        after[:-d] += same
        before[d:] += same
    steps = np.empty(n - SIZE + 1, np.int64)
    steps[0] = _F[np.bincount(buf[:SIZE], minlength=256)].sum()
    steps[1:] = _REMOVE[after[: n - SIZE]] + _ADD[before[SIZE:]]
    total = np.cumsum(steps)
    return ((_TOP - total) * 1000 // _TOP).clip(0, 1000)


def _lowest(low: np.ndarray) -> np.ndarray:
    """The least of every STRETCH consecutive values."""
    width = 1
    while width < STRETCH:
        low = np.minimum(low[:-width], low[width:]) if len(low) > width else low[:0]
        width *= 2
    return low[low < _NONE] & 0xFFFFFFFF


def _hashed(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the windows that begin at the given places."""
    eight = np.ndarray((len(buf) - 7,), "<u8", np.ascontiguousarray(buf), strides=(1,))
    h = np.full(len(at), SIZE, U)
    for k in range(0, SIZE, 8):
        h = mix(h * _ODD ^ eight[at + k])
    return h


def _features(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the features of texts laid end to end, and the text of each, in order."""
    n = len(buf)
    if n < SIZE:
        return np.zeros(0, U), np.zeros(0, np.int64)
    key = ranks[_entropies(buf)]
    doc = np.repeat(np.arange(len(starts)), ends - starts)
    at = np.flatnonzero(doc[: n - SIZE + 1] == doc[SIZE - 1 :])
    key = key[at]
    # a gap between texts keeps each stretch within one
    gap = STRETCH - 1
    low = np.full(len(at) + gap * (len(starts) + 1), _NONE, np.int64)
    low[np.arange(len(at)) + gap * (doc[at] + 1)] = np.where(key < _NEVER, key << 32 | at, _NONE)
    points = np.bincount(_lowest(low), minlength=n)
    chosen = np.flatnonzero(points >= POINTS)
    return _hashed(buf, chosen), doc[chosen]


def _long_features(buf: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Hashes of the features of one text, as _features has them, part by part.

    A part takes the stretches that end in it, so it also looks at the windows just before it.
    """
    m = len(buf) - SIZE + 1
    gap = STRETCH - 1
    points = np.zeros(m, np.uint8)
    for a in range(0, m, _PART):
        b = min(m, a + _PART)
        first = max(0, a - gap)
        key = ranks[_entropies(buf[first : b + SIZE - 1])]
        head, tail = gap - (a - first), gap if b == m else 0
        low = np.full(head + b - first + tail, _NONE, np.int64)
        low[head : head + b - first] = np.where(key < _NEVER, key << 32 | np.arange(b - first), _NONE)
        points[first:b] += np.bincount(_lowest(low), minlength=b - first).astype(np.uint8)
    return _hashed(buf, np.flatnonzero(points >= POINTS))


def count_entropies(texts: list[bytes]) -> np.ndarray:
    """How many windows of the texts have each entropy."""
    counts = np.zeros(1001, np.int64)
    for _, buf, starts, ends in _runs(texts):
        if starts is None:
            for a in range(0, len(buf) - SIZE + 1, _PART):
                counts += np.bincount(_entropies(buf[a : a + _PART + SIZE - 1]), minlength=1001)
        elif len(buf) >= SIZE:
            doc = np.repeat(np.arange(len(starts)), ends - starts)
            counts += np.bincount(_entropies(buf)[doc[: len(buf) - SIZE + 1] == doc[SIZE - 1 :]], minlength=1001)
    return counts


def _runs(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray | None, np.ndarray | None]]:
    """Place of the first, bytes, starts and ends of short texts laid end to end; a very long one comes alone,
    without starts and ends."""
    k = 0
    while k < len(texts):
        if len(texts[k]) > _PART:
            yield k, np.frombuffer(texts[k], np.uint8), None, None
            k += 1
            continue
        j, size = k, 0
        while j < len(texts) and size + len(texts[j]) <= _PART:
            size += len(texts[j])
            j += 1
        ends = np.cumsum([len(x) for x in texts[k:j]])
        yield k, np.frombuffer(b"".join(texts[k:j]), np.uint8), np.concatenate([[0], ends[:-1]]), ends
        k = j


def digests(texts: list[bytes], ranks: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features in each filter, filters) of every text."""
    hashes: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    for k, buf, starts, ends in _runs(texts):
        if starts is None:
            h = _long_features(buf, ranks)
            d = np.zeros(len(h), np.int64)
        else:
            h, d = _features(buf, starts, ends, ranks)
        hashes.append(h)
        owners.append(d + k)
    h = np.concatenate(hashes) if hashes else np.zeros(0, U)
    owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    count = np.bincount(owner, minlength=len(texts))
    bare = [i for i in np.flatnonzero(count == 0) if texts[i]]
    if bare:
        h = np.concatenate([h, np.array([hash_bytes(texts[i]) for i in bare], U)])
        owner = np.concatenate([owner, bare])
        order = np.argsort(owner, kind="stable")
        h, owner = h[order], owner[order]
        count = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(count) - count
    filters = -(-count // MOST)
    base = np.cumsum(filters) - filters
    which = base[owner] + (np.arange(len(h)) - first[owner]) // MOST
    bits = np.zeros(int(filters.sum()) * BITS, np.uint8)
    for j in range(PER_FEATURE):
        bits[which * BITS + ((h >> U(11 * j)) & U(BITS - 1)).astype(np.int64)] = 1
    packed = np.packbits(bits).reshape(-1, BITS // 8)
    sizes = np.bincount(which, minlength=len(packed))
    return [(sizes[base[i] : base[i] + filters[i]], packed[base[i] : base[i] + filters[i]]) for i in range(len(texts))]


def to_text(d: tuple[np.ndarray, np.ndarray]) -> str:
    sizes, filters = d
    return "" if not len(sizes) else ",".join(map(str, sizes)) + ":" + base64.b64encode(filters.tobytes()).decode()


def from_text(text: str) -> tuple[np.ndarray, np.ndarray]:
    if not text:
        return np.zeros(0, np.int64), np.zeros((0, BITS // 8), np.uint8)
    sizes, _, body = text.partition(":")
    return np.array(sizes.split(","), np.int64), np.frombuffer(base64.b64decode(body), np.uint8).reshape(-1, BITS // 8)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """0 to 1: of the digest with fewer filters, each filter's best match in the other, weighed by its features."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    if (len(a[0]), a[1].tobytes()) > (len(b[0]), b[1].tobytes()):
        a, b = b, a
    na = np.bitwise_count(a[1]).sum(axis=1).astype(float)
    nb = np.bitwise_count(b[1]).sum(axis=1).astype(float)
    best = np.zeros(len(na))
    for i in range(len(na)):
        shared = np.bitwise_count(a[1][i] & b[1]).sum(axis=1)
        most = np.minimum(na[i], nb)
        chance = na[i] * nb / BITS
        floor = chance + CUT * (most - chance)
        best[i] = ((shared - floor) / np.maximum(most - floor, 1e-9)).clip(0, 1).max()
    return float((best * a[0]).sum() / a[0].sum())


# ---------------------------------------------------------------- tables


def entropy_counts(docs: DataFrame) -> np.ndarray:
    """How many windows of all texts have each entropy, 0 to 1000."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1001, np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                counts += count_entropies(pc.drop_null(batch.column(0).slice(k, 512).cast(pa.large_string())).cast(pa.large_binary()).to_pylist())
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at])], names=["e", "n"])

    # at most 1001 rows
    found = docs.select("text").mapInArrow(run, "e int, n long").groupBy("e").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(1001, np.int64)
    for e, n in found:
        counts[e] = n
    return counts


def fingerprints(docs: DataFrame, ranks: np.ndarray | None = None) -> DataFrame:
    """(doc_id, fingerprint) of every row; ranks are those of docs if none are given.

    Defined results: a null text is empty and has the fingerprint ""; a null doc_id stays null; repeated rows have
    equal fingerprints; an empty table gives no rows; other columns, whatever their names, are ignored.
    """
    ranks = ranks_of(entropy_counts(docs)) if ranks is None else ranks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                texts = pc.fill_null(part.column(1).cast(pa.large_string()), "").cast(pa.large_binary()).to_pylist()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([to_text(d) for d in digests(texts, ranks)], pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fingerprint string")


_LEAST = -(2**63)


def _ids(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column, _LEAST).to_numpy(zero_copy_only=False)


def _deal(cuts: np.ndarray, lead: dict[int, int]):
    """Rows to their shard; the first of a shard also to the shard before it, as what is ahead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = np.array(sorted(lead), np.int64)
        for batch in batches:
            ids = _ids(batch.column(0))
            shard = np.searchsorted(cuts, ids, side="left").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(np.zeros(len(ids), bool)), *batch.columns], names=["shard", "ahead", "doc_id", "text"])
            at = np.flatnonzero(np.isin(ids, firsts))
            if len(at):
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array([lead[int(ids[i])] for i in at], pa.int32()), pa.array(np.ones(len(at), bool)), *(c.take(take) for c in batch.columns)], names=["shard", "ahead", "doc_id", "text"])

    return run


def _compare(batches: Iterator[pa.RecordBatch], ranks: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Digests and likenesses of rows in order of (shard, ahead, doc_id, text)."""
    held: list[tuple[int | None, str]] = []
    size = 0
    version = version_of(ranks)

    def flush(after: str | None) -> pa.RecordBatch:
        """All held rows if what follows them is given; else all but the last, which stays."""
        nonlocal held, size
        own = held if after is not None else held[:-1]
        texts = [t for _, t in held] + ([after] if after is not None else [])
        edited = []
        for i in range(len(own)):
            n = len(texts[i])
            edited.append(texts[i][: n - n // 4] + texts[i + 1][: n // 4])
        raw = [x.encode() for x in edited]
        made = digests([t.encode() for t in texts], ranks)
        changed = digests(raw, ranks)
        out = pa.RecordBatch.from_arrays(
            [
                pa.array([d for d, _ in own], pa.int64()),
                pa.array([len(t) for _, t in own], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string()),
                pa.array([to_text(made[i]) for i in range(len(own))], pa.string()),
                pa.array([to_text(x) for x in changed], pa.string()),
                pa.array([likeness(made[i], changed[i]) for i in range(len(own))], pa.float64()),
                pa.array([likeness(made[i], made[i + 1]) for i in range(len(own))], pa.float64()),
                pa.array([version] * len(own), pa.string()),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "ranks"],
        )
        held = held[len(own) :]
        size = sum(len(t) for _, t in held)
        return out

    shard, done = None, False
    for batch in batches:
        for s, ahead, d, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            t = t or ""
            if s != shard:
                shard, done = s, False
            if ahead:
                if not done:  # rows that share the least doc_id: the first of them is what comes next
                    yield flush(t)
                    done = True
                continue
            held.append((d, t))
            size += len(t)
            if size > 2 << 20 and len(held) > 1:
                yield flush(None)


def compare_neighbours(docs: DataFrame, rows: int = 2048, most: int = 20_000, ranks: np.ndarray | None = None) -> DataFrame:
    """Each document's digest, that of its edited text, and its likeness to it and to the next document.

    The order is that of doc_id, a null first, equal ones by text; after the last comes the first.
    Documents are dealt to shards between quantiles of doc_id; a shard gets the first row of the next one
    too, so each text is shuffled once and no window runs over the whole table.

    Defined results: a null text is empty; rows that share a doc_id stand in order of their texts, and repeated ones
    next to each other; a single row is its own next one; an empty table gives no rows; other columns, whatever
    their names, are ignored.  The column ranks names the table of ranks in use, that of docs if none is given.
    """
    ranks = ranks_of(entropy_counts(docs)) if ranks is None else ranks
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    n = docs.count()
    shards = max(1, min(most, -(-n // rows)))
    ids = docs.select(F.coalesce("doc_id", F.lit(_LEAST).cast("long")).alias("doc_id"))
    shares = [k / shards for k in range(1, shards)]
    cuts = np.array(sorted(set(ids.select(F.percentile_approx("doc_id", shares, 10 * shards)).first()[0] or [])) if shares else [], np.int64)

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: dict[int, int] = {}
        for batch in batches:
            x = np.sort(_ids(batch.column(0)))
            s, k = np.unique(np.searchsorted(cuts, x, side="left"), return_index=True)
            for a, b in zip(s.tolist(), x[k].tolist(), strict=True):
                low[a] = min(b, low.get(a, b))
        yield pa.RecordBatch.from_arrays([pa.array(list(low), pa.int32()), pa.array(list(low.values()), pa.int64())], names=["shard", "low"])

    # a row per shard
    lows = sorted(tuple(r) for r in ids.mapInArrow(least, "shard int, low long").groupBy("shard").agg(F.min("low")).collect())
    lead = {low: lows[k - 1][0] for k, (_, low) in enumerate(lows)}
    dealt = docs.mapInArrow(_deal(cuts, lead), "shard int, ahead boolean, doc_id long, text string")
    ordered = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "ahead", "doc_id", "text")
    return ordered.mapInArrow(
        lambda batches: _compare(batches, ranks),
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, ranks string",
    )


def op7_improbable_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_neighbours(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
