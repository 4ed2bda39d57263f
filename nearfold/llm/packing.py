"""Best-fit packing of token sequences by linear grouping.

Lengths are at most the capacity, so the whole plan is made from a histogram of at most `capacity` rows,
at any size of corpus:

1. Large lengths are ranked and cut into groups of equal cardinality; each is rounded up to the largest of
   its group, which leaves few sizes.
2. Which configurations of those sizes fill a sequence, and how often to use each, is a linear programme
   solved by column generation (a knapsack over the capacity prices new configurations).
3. Whole multiples of the configurations are filled with the actual lengths of their groups, so each
   sequence's true remainder is known; large pieces left by rounding down go best-fit, longest first.
4. The bound between large and small is that of 1/2, 1/3, 1/4 and 1/8 of the capacity which needs the fewest
   sequences; pieces of the full capacity stand alone.  Small lengths go best-fit, longest first, into the remainders, then into new sequences.

The plan is kept as runs: "ranks a..b of length l go to sequences s..s+b-a at offset o".  A distributed
rank of each piece among those of its length (a prefix sum over parts of bounded size, so that a hot length is
spread) then finds its run.

Defined results: a null text is empty and packs as its end id alone; repeated rows are packed each for
itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pieces import text_encoder, with_end
from .scratch import Scratch

CAPACITY = 2048
#: Pieces of one length in a part of its ranking.
PART = 2000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


# ---------------------------------------------------------------- the plan


def group_sizes(lengths: np.ndarray, counts: np.ndarray, groups: int) -> list[np.ndarray]:
    """Linear grouping: lengths, longest first, in groups of about equal cardinality."""
    if not len(lengths):
        return []
    total = int(counts.sum())
    step = -(-total // groups)
    place = (np.cumsum(counts) - counts) // step
    return [np.flatnonzero(place == g) for g in np.unique(place)]


def best_configuration(sizes: np.ndarray, value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within the capacity (unbounded knapsack)."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    s, v = sizes[order], value[order]
    for c in range(int(s[0]), capacity + 1):
        k = int(np.searchsorted(s, c, side="right"))
        options = best[c - s[:k]] + v[:k]
        j = int(np.argmax(options))
        best[c], took[c] = best[c - 1], -2
        if options[j] > best[c] + 1e-12:
            best[c], took[c] = options[j], j
    made = np.zeros(len(sizes), np.int64)
    c = capacity
    while c > 0 and took[c] != -1:
        if took[c] == -2:
            c -= 1
        else:
            made[order[took[c]]] += 1
            c -= int(s[took[c]])
    return float(best[capacity]), made


def configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 600) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often to use each, by column generation for the cutting-stock programme."""
    m = len(sizes)
    columns = [np.eye(m, dtype=np.int64)[i] * (capacity // int(sizes[i])) for i in range(m)]
    basis = np.array(columns, float).T
    inverse = np.linalg.inv(basis)
    for k in range(rounds):
        price = np.ones(m) @ inverse
        value, made = best_configuration(sizes, price, capacity)
        if value <= 1 + 1e-7:
            break
        enter = inverse @ made
        x = inverse @ counts
        ratio = np.where(enter > 1e-9, x / np.where(enter > 1e-9, enter, 1), np.inf)
        leave = int(np.argmin(ratio))
        if not np.isfinite(ratio[leave]):
            break
        held = basis[:, leave].copy()
        basis[:, leave] = made
        try:
            inverse = np.linalg.inv(basis)
        except np.linalg.LinAlgError:  # the configurations so far do
            basis[:, leave] = held
            break
        columns[leave] = made
    x = np.maximum(inverse @ counts, 0)
    return [(c, float(t)) for c, t in zip(columns, x, strict=True) if t > 0]


class _Stock:
    """Pieces by length, handed out by rank."""

    def __init__(self, lengths: np.ndarray, counts: np.ndarray):
        self.left = dict(zip(lengths.tolist(), counts.tolist(), strict=True))
        self.next = dict.fromkeys(self.left, 0)

    def take(self, length: int, n: int) -> int:
        rank = self.next[length]
        self.next[length] += n
        self.left[length] -= n
        return rank


def plan(lengths: np.ndarray, counts: np.ndarray, capacity: int, large: float = 1 / 8, groups: int = 64) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, last rank + 1, first sequence, offset) and the number of sequences."""
    order = np.argsort(-lengths)
    lengths, counts = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    stock = _Stock(lengths, counts)
    runs: list[tuple[int, int, int, int, int]] = []
    trays: dict[int, list[tuple[int, int]]] = {}  # by remainder: runs of sequences (first, number)
    sequences = 0

    def put(length: int, n: int, first: int, offset: int) -> None:
        rank = stock.take(length, n)
        runs.append((length, rank, rank + n, first, offset))

    full = int(counts[lengths == capacity].sum())
    if full:  # these fill a sequence each, whatever the rest does
        put(capacity, full, 0, 0)
        sequences = full
    big = (lengths >= capacity * large) & (lengths < capacity)
    parts = group_sizes(lengths[big], counts[big], groups)
    if parts:
        tops = np.array([int(lengths[big][p].max()) for p in parts])
        sizes, merged = np.unique(-tops, return_inverse=True)
        sizes = -sizes
        members = [np.concatenate([p for p, m in zip(parts, merged, strict=True) if m == g]) for g in range(len(sizes))]
        need = np.array([int(counts[big][p].sum()) for p in members])
        for made, often in configurations(sizes, need, capacity):
            uses = int(often)
            queue = [[int(x) for x in lengths[big][members[g]]] for g in np.repeat(np.arange(len(sizes)), made)]
            while uses:
                # as many sequences as keep every slot at one actual length
                now: list[int] = []
                wanted: dict[int, int] = {}
                for slot in queue:
                    x = next((x for x in slot if stock.left[x] > wanted.get(x, 0)), None)
                    if x is None:
                        break
                    now.append(x)
                    wanted[x] = wanted.get(x, 0) + 1
                if len(now) < len(queue):
                    break
                n = min([uses, *(stock.left[x] // k for x, k in wanted.items())])
                at = 0
                for x in now:
                    put(x, n, sequences, at)
                    at += x
                trays.setdefault(capacity - at, []).append((sequences, n))
                sequences += n
                uses -= n
    open_sizes = np.zeros(capacity + 1, bool)
    for r in trays:
        open_sizes[r] = True
    for x in lengths.tolist():  # what rounding down has left, then the small ones: longest first, best fit
        while stock.left[x]:
            fits = np.flatnonzero(open_sizes[x:])
            if len(fits):
                r = x + int(fits[0])
                first, number = trays[r].pop()
                if not trays[r]:
                    open_sizes[r] = False
                n = min(number, stock.left[x])
                if n < number:
                    trays[r].append((first + n, number - n))
                    open_sizes[r] = True
            else:
                r, first = capacity, sequences
                per = capacity // x
                n = max(1, stock.left[x] // per)
                sequences += n
            put(x, n, first, capacity - r)
            trays.setdefault(r - x, []).append((first, n))
            open_sizes[r - x] = True
    return np.array(runs, np.int64).reshape(-1, 5), sequences


def best_plan(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """The plan with the fewest sequences of some bounds between small and large; no plan has fewer than all
    ids over the capacity."""
    least = -(-int((lengths * counts).sum()) // capacity)
    best = None
    for large in (1 / 2, 1 / 3, 1 / 4, 1 / 8):
        found = plan(lengths, counts, capacity, large)
        if best is None or found[1] < best[1]:
            best = found
        if best[1] <= least:
            break
    return best


# ---------------------------------------------------------------- pieces of documents


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: only a longer text is cut, and only the first may be short."""
    first = n % capacity or capacity
    if n <= capacity:
        return [(0, n)]
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def _pieces(vocabulary: str, end_id: int, capacity: int):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = text_encoder(vocabulary, spaced=True)
        for batch in batches:
            doc_ids = batch.column(0)
            for first, ids, bound in encode(batch.column(1)):
                ids, bound = with_end(ids, bound, end_id)
                rows: list[tuple] = []
                for i, (a, b) in enumerate(zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True)):
                    for k, (s, n) in enumerate(cut(b - a, capacity)):
                        rows.append((first + i, k, s, n, zlib.crc32(ids[a + s : a + s + n])))
                where, k, s, n, crc = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(where)), pa.array(k, pa.int32()), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], schema=schema)

    return run


def token_pieces(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pieces(vocabulary, end_id, capacity), PIECES)


def pack(spark: SparkSession, pieces: DataFrame, capacity: int = CAPACITY, part: int = PART) -> DataFrame:
    """Adds sequence_id and offset to rows of (doc_id, piece, length, ...), read more than once."""
    # at most `capacity` rows
    histogram = pieces.groupBy("length").count().collect()
    lengths = np.array([r[0] for r in histogram], np.int64)
    counts = np.array([r[1] for r in histogram], np.int64)
    runs, _ = best_plan(lengths, counts, capacity)
    schema = T.StructType([T.StructField(c, T.LongType(), False) for c in ("length", "rank_from", "rank_to", "first", "offset")])
    planned = spark.createDataFrame(pa.table([pa.array(runs[:, i]) for i in range(5)], names=schema.names), schema)
    # a hot length is ranked in as many parts as it has pieces for; at most `capacity` rows
    parts = spark.createDataFrame(pa.table([pa.array(lengths), pa.array(-(-counts // part))], names=["length", "parts"]), "length long, parts long")
    salted = pieces.join(F.broadcast(parts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.col("parts"))).drop("parts")
    blocks = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    place = F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1
    ranked = salted.withColumn("place", place).join(blocks, ["length", "salt"]).withColumn("rank", F.col("place") + F.col("before"))
    # the plan's size follows the histogram's, not the corpus
    side = F.broadcast(planned) if len(runs) <= 200_000 else planned
    ranked = ranked.drop("place", "before", "salt")
    found = ranked.join(side, (ranked["length"] == side["length"]) & (ranked["rank"] >= side["rank_from"]) & (ranked["rank"] < side["rank_to"])).drop(planned["length"])
    return found.withColumn("sequence_id", F.col("first") + F.col("rank") - F.col("rank_from")).drop("first", "rank", "rank_from", "rank_to")


def pack_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    pieces = Scratch(spark, "pack").save(token_pieces(docs), "pieces")
    return pack(spark, pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
