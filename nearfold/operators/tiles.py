"""Products of all vectors with all vectors, in tiles.

The vocabulary is small, so the rare ends of vectors hold common words and an inverted join meets almost every pair
anyway, at the price of a shuffled row for each.  Here vectors are dealt into blocks, and a task multiplies one block
with another as dense matrices: the pairs live only in the product, and what leaves the task is what the caller wants
(hits, or the nearest of each row).  Products are in single precision with a margin; hits are computed again in
double, term by term, so results don't depend on the way blocks are cut.

Where products over a threshold are wanted, blocks of ROWS vectors or less are shuffled once, as rows of PIECE vectors, and meet in a
Cartesian product, whose tasks read them from there; a task holds two pieces at a time, so neither memory nor disk grow with the tiles.

Elsewhere a tile holds at most ROWS rows of its left side as they come, which are multiplied DENSE at a time with strips of the right side.
There a vector is sent to a tile for each block, so blocks are as large as memory and the number of cores allow.

Of a wide vector the norms over FOLDS groups of terms come first: their products bound those of the vectors, so where few pairs can
reach what is asked for, those pairs alone are computed, and no matrix of all terms is made.

Where the members of a long list are wanted, and there are many blocks, vectors are put into cells first, each with the nearest of up to CELLS
sampled vectors, and the largest and least weight of each term in a cell is noted.  They bound the product of a vector with
any vector of the cell, so a vector is sent only to the tiles of cells that it can have a hit in, and a tile without rows
on both sides is never opened.  Cells only steer what is sent: the hits are the same for any choice.  The bounds of all
cells are a few megabytes at any size of the data.  On 9,274 vectors of the test documents in 72 cells about four tiles in
five stay closed.  Without a threshold each vector is sent to as many tiles as there are blocks, which is n / ROWS.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stage

ROWS = 65_536
STRIP = 1024
DENSE = 4096
#: Groups of terms whose norms bound products.  Vectors of up to twice as many terms are multiplied whole, as are strips of which more
#: than one pair in FEW may have a hit: that many exact products take longer.
FOLDS, FEW = 192, 16
#: Hits that may wait until the nearest of them are sought, or half as many as are held, if that is more.
_WAITING = 50_000
#: What single precision can be off, generously.
MARGIN = 1e-4
#: Pairs of a block and a strip that are multiplied as a dense matrix if they lie together: a row that leads a group has so many at least, and
#: after so many leaders without one the rest is computed pair by pair.
LEADS, IN_VAIN = 16, 8
#: Rows of a block whose bounds are computed at once.
BOUNDED = 256
#: Rows of a batch of hits, and pairs whose exact products are taken at once, so few that they stay in the processor's cache.
_EXACT, _AT_ONCE = 100_000, 1024
_TASKS = 20_000
#: Vectors that make one row where blocks meet without a shuffle, and bytes of their weights: a batch holds several pairs of rows.
PIECE, PIECE_BYTES = 8192, 8 << 20
#: Vectors of a list that every task can have, about 10 MB.
LISTED = 8192
#: There are as many cells as blocks of ROWS, at most CELLS, so a vector goes to fewer tiles than it would without.  With
#: fewer than LEAST_BLOCKS the whole product takes less time than the bounds do, which changes no result.
CELLS, LEAST_BLOCKS = 256, 32

Hits = tuple[np.ndarray, np.ndarray, np.ndarray]


class Rows:
    """Rows as they come: ids, and terms and weights laid end to end."""

    def __init__(self, parts: list[tuple[np.ndarray, ...]]):
        self.ids = np.concatenate([p[0] for p in parts])
        self.size = np.concatenate([p[1] for p in parts])
        self.terms = np.concatenate([p[2] for p in parts])
        self.weights = np.concatenate([p[3] for p in parts])
        self.start = np.cumsum(self.size) - self.size
        self.copies, self.n_copies = np.concatenate([p[4] for p in parts]), np.concatenate([p[5] for p in parts])
        self.first_copy = np.cumsum(self.n_copies) - self.n_copies

    def _span(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, term and weight of what lies in rows lo to hi."""
        a = int(self.start[lo]) if lo < len(self.ids) else len(self.terms)
        b = int(self.start[hi]) if hi < len(self.ids) else len(self.terms)
        return np.repeat(np.arange(hi - lo), self.size[lo:hi]), self.terms[a:b], self.weights[a:b]

    def dense(self, width: int, lo: int, hi: int, kind: type = np.float64) -> np.ndarray:
        m = np.zeros((hi - lo, width), kind)
        row, term, weight = self._span(lo, hi)
        inside = term < width
        m[row[inside], term[inside]] = weight[inside]
        return m

    def some(self, places: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Products of the rows at places with all rows of the dense right, over the terms of these rows alone."""
        n = self.size[places]
        end = np.cumsum(n)
        at = np.repeat(self.start[places] - (end - n), n) + np.arange(int(end[-1]))
        term = self.terms.take(at)
        used = np.zeros(right.shape[1], bool)
        used[term] = True
        column = np.cumsum(used) - 1
        m = np.zeros((len(places), int(column[-1]) + 1))
        m[np.repeat(np.arange(len(places)), n), column[term]] = self.weights.take(at)
        return m @ right[:, used].T

    def folded(self, lo: int, hi: int) -> np.ndarray:
        """The norms over each group of terms."""
        row, term, weight = self._span(lo, hi)
        squares = np.bincount(row * FOLDS + term % FOLDS, weight * weight, (hi - lo) * FOLDS)
        return np.sqrt(squares).astype(np.float32).reshape(hi - lo, FOLDS)


def _parts(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Ids, sizes, terms and weights, and the copies of each row and their number.  Rows without terms are dense: their weights are
    those of terms 0, 1, 2, ..."""
    ti, tw = batch.column("ti"), batch.column("tw")
    size, terms = np.diff(tw.offsets.to_numpy()).astype(np.int64), ti.flatten().to_numpy()
    weights = tw.flatten().to_numpy()
    if len(terms) < len(weights):
        terms = (np.arange(len(weights)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
    ids = batch.column("chunk_id").to_numpy()
    if "copies" not in batch.schema.names:
        return ids, size, terms, weights, ids, np.ones(len(ids), np.int64)
    copies = batch.column("copies")
    return ids, size, terms, weights, copies.flatten().to_numpy(), np.diff(copies.offsets.to_numpy()).astype(np.int64)


def _exact(left: Rows, i: np.ndarray, right: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of rows i of left with rows j of the dense right."""
    out = np.empty(len(i))
    flat, width = right.ravel(), right.shape[1]
    for k in range(0, len(i), _AT_ONCE):
        a, b = i[k : k + _AT_ONCE], j[k : k + _AT_ONCE]
        n = left.size[a]
        end = np.cumsum(n)
        at = np.repeat(left.start[a] - (end - n), n) + np.arange(int(end[-1]))
        product = flat.take(np.repeat(b * width, n) + left.terms.take(at))
        product *= left.weights.take(at)
        out[k : k + _AT_ONCE] = np.add.reduceat(product, end - n)
    return out


def _together(left: Rows, lo: int, right: np.ndarray, found: np.ndarray) -> Iterator[Hits]:
    """Groups of pairs (i, j, product) of found, a matrix of pairs of left from row lo with the dense right, which lose what is given.

    Copies with small changes have the same pairs, so many of these lie in a few dense parts of the matrix.  The row with most pairs leads:
    the rows that have half of them too are multiplied with all of them, in double, over the terms that these rows have.
    """
    count, vain = np.count_nonzero(found, axis=1), 0
    while vain < IN_VAIN and count[lead := int(np.argmax(count))] >= LEADS:
        cols = np.flatnonzero(found[lead])
        part = found[:, cols]
        rows = np.flatnonzero(2 * np.count_nonzero(part, axis=1) >= len(cols))
        if len(rows) < LEADS:
            count[lead], vain = 0, vain + 1
            continue
        part = part[rows]
        i, j = np.nonzero(part)
        product = left.some(lo + rows, right[cols])[i, j]
        count[rows] -= np.count_nonzero(part, axis=1)
        found[np.ix_(rows, cols)] = False
        yield lo + rows[i], cols[j], product


class _Strip:
    """Some rows of the right side."""

    def __init__(self, rows: Rows, lo: int, hi: int, width: int, folded: bool):
        self.rows, self.lo, self.ids = rows, lo, rows.ids[lo:hi]
        self.width, self.made = width, None
        self.folds = rows.folded(lo, hi) if folded else None
        self.single: np.ndarray | None = None

    @property
    def dense(self) -> np.ndarray:
        if self.made is None:
            self.made = self.rows.dense(self.width, self.lo, self.lo + len(self.ids))
        return self.made

    def turned(self) -> np.ndarray:
        if self.single is None:
            self.single = self.dense.astype(np.float32).T
        return self.single


class _Left:
    """The left side of a tile, multiplied DENSE rows at a time."""

    def __init__(self, rows: Rows):
        self.rows, self.n = rows, len(rows.ids)
        self.width = int(rows.terms.max(initial=-1)) + 1
        self.blocks = [(lo, min(self.n, lo + DENSE)) for lo in range(0, self.n, DENSE)]
        self.folded = self.width > 2 * FOLDS
        self.folds = [rows.folded(lo, hi) for lo, hi in self.blocks] if self.folded else []
        self.single: dict[int, np.ndarray] = {}

    def strips(self, right: Iterator[Rows]) -> Iterator[_Strip]:
        for rows in right:
            for lo in range(0, len(rows.ids), STRIP):
                yield _Strip(rows, lo, min(len(rows.ids), lo + STRIP), self.width, self.folded)

    def product(self, k: int, strip: _Strip) -> np.ndarray:
        """Products of the rows of block k with a strip's in single precision."""
        if k not in self.single:
            if self.folded:  # one block at a time
                self.single.clear()
            self.single[k] = self.rows.dense(self.width, *self.blocks[k], np.float32)
        return self.single[k] @ strip.turned()

    def hits(self, k: int, strip: _Strip, reach: Callable[[np.ndarray, int, int], np.ndarray], wanted: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[Hits]:
        """(i, j, product), places in left and strip, of all wanted pairs of block k that reach passes, and of others whose bounds it
        passes.  reach: of products of all of the strip with rows of left, and where these begin and end.  wanted: of ids of left and right, which pairs are."""
        lo, hi = self.blocks[k]
        if self.folded:
            found = np.empty((hi - lo, len(strip.ids)), bool)
            for a in range(lo, hi, BOUNDED):  # so few that their products stay in the processor's cache
                b = min(hi, a + BOUNDED)
                found[a - lo : b - lo] = reach(self.folds[k][a - lo : b - lo] @ strip.folds.T, a, b)
            if np.count_nonzero(found) * FEW > found.size:
                found &= reach(self.product(k, strip), lo, hi)
        else:
            found = reach(self.product(k, strip), lo, hi)
        many = np.count_nonzero(found) >= LEADS * LEADS
        if many:
            for i, j, sim in _together(self.rows, lo, strip.dense, found):
                keep = wanted(self.rows.ids[i], strip.ids[j])
                yield i[keep], j[keep], sim[keep]
        i, j = np.divmod(np.flatnonzero(found), found.shape[1])
        i += lo
        keep = wanted(self.rows.ids[i], strip.ids[j])
        i, j = i[keep], j[keep]
        if len(i):
            yield i, j, _exact(self.rows, i, strip.dense, j)


def _hits(left: Rows | _Left, right: Iterator[Rows], threshold: float, same: bool) -> Iterator[tuple[_Strip, Hits]]:
    """For each block and strip: hits as places in left and in the strip, and products.

    same: both sides are one block, and only pairs of ascending ids are wanted.
    """
    side = left if isinstance(left, _Left) else _Left(left)
    wanted = np.less if same else lambda a, b: np.ones(len(a), bool)
    for strip in side.strips(right):
        for k in range(len(side.blocks)):
            for i, j, sim in side.hits(k, strip, lambda s, lo, hi: s >= threshold - MARGIN, wanted):
                keep = sim >= threshold
                yield strip, (i[keep], j[keep], sim[keep])


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Rows, Iterator[Rows], bool]]:
    """The tiles of a partition in order of (tile, side): the left side, the right side as it comes."""
    queue: list[pa.RecordBatch] = []

    def more() -> bool:
        for batch in batches:
            if batch.num_rows:
                # a piece for each tile and side
                tile, side = batch.column("tile").to_numpy(), batch.column("side").to_numpy()
                cut = np.flatnonzero((tile[1:] != tile[:-1]) | (side[1:] != side[:-1])) + 1
                edge = [0, *cut.tolist(), batch.num_rows]
                queue.extend(pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in batch.slice(a, b - a).columns], schema=batch.schema) for a, b in zip(edge[:-1], edge[1:], strict=True))
                return True
        return False

    def head() -> tuple[int, int] | None:
        if not queue and not more():
            return None
        return queue[0].column("tile")[0].as_py(), queue[0].column("side")[0].as_py()

    while (at := head()) is not None:
        tile, side = at
        if side == 1:  # no left side
            queue.pop(0)
            continue
        parts = []
        same = queue[0].column("same")[0].as_py()
        while head() == (tile, 0):
            parts.append(_parts(queue.pop(0)))

        def right(tile: int = tile) -> Iterator[Rows]:
            while head() == (tile, 1):
                yield Rows([_parts(queue.pop(0))])

        strips, left = right(), Rows(parts)
        parts.clear()  # what a side was read from isn't held beside it
        yield left, strips, same
        del left
        for _ in strips:  # what the caller has left
            pass


def _dealt(left: DataFrame, right: DataFrame | None, fewest: int = 1) -> DataFrame:
    """Rows of (tile, side, same, chunk_id, ti, tw), each tile in one partition, its left side first."""
    spark = left.sparkSession
    # tiles for each core: three or more
    least = math.ceil(math.sqrt((6 if right is None else 3) * spark.sparkContext.defaultParallelism))

    def blocks(df: DataFrame) -> int:
        n = df.count()
        return max(fewest, -(-n // ROWS), min(-(-n // 256), least))

    columns = _columns(left)

    def block(n: int):
        return F.pmod(F.xxhash64("chunk_id"), F.lit(n)).cast("long")

    nl = blocks(left)
    nr = nl if right is None else blocks(right)
    x = left.select(*columns, block(nl).alias("i"))
    y = (left if right is None else right).select(*columns, block(nr).alias("j"))
    x = x.withColumn("j", F.explode(F.sequence(F.col("i") if right is None else F.lit(0).cast("long"), F.lit(nr - 1).cast("long")))).withColumn("side", F.lit(0))
    y = y.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("j") if right is None else F.lit(nl - 1).cast("long")))).withColumn("side", F.lit(1))
    both = x.unionByName(y).withColumn("tile", F.col("i") * nr + F.col("j")).withColumn("same", (F.col("i") == F.col("j")) & F.lit(right is None))
    tasks = min(_TASKS, nl * nr)
    # tiles of a triangle follow each other closely enough in i * nr + j
    spread = both.select("tile", "side", "same", *columns).repartitionById(tasks, F.pmod("tile", F.lit(tasks)).cast("int"))
    return spread.sortWithinPartitions("tile", "side")


def _columns(df: DataFrame) -> list[str]:
    return ["chunk_id", "ti", "tw", *(["copies"] if "copies" in df.columns else [])]


def _vectors(batch: pa.RecordBatch, width: int) -> np.ndarray:
    rows = Rows([_parts(batch)])
    return rows.dense(width, 0, len(rows.ids))


def _cells(left: DataFrame, right: DataFrame | None, threshold: float, each: int) -> tuple[DataFrame, DataFrame, list[int], list[int]]:
    """Both sides as (chunk_id, ti, tw, cell, meets), and how many rows each cell has there.  meets: the cells of the other
    side in which a row can have a product of the threshold or more."""
    n = left.count() if right is None else right.count()
    sample = (left if right is None else right).orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(max(1, min(CELLS, n // each)))
    rows = sample.select("chunk_id", "ti", "tw").toArrow()  # CELLS rows at most
    width = 1
    for b in rows.to_batches():
        width = max(width, int(_parts(b)[2].max(initial=0)) + 1)
    tops = np.concatenate([_vectors(b, width) for b in rows.to_batches()] or [np.zeros((1, 1))]).T.astype(np.float32)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, STRIP):
                part = batch.slice(k, STRIP)
                part = pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in part.columns], schema=part.schema)
                cell = np.argmax(_vectors(part, width).astype(np.float32) @ tops, axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32))], names=[*part.schema.names, "cell"])

    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each cell and term the largest and the least weight of a partition, and a row with term -1 that counts."""
        cells = tops.shape[1]
        up, down, count = np.zeros((cells, width)), np.zeros((cells, width)), np.zeros(cells, np.int64)
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            _, size, terms, weights = _parts(batch)[:4]
            more = int(terms.max(initial=0)) + 1 - up.shape[1]
            if more > 0:  # a term that the sample hasn't
                up, down = np.pad(up, ((0, 0), (0, more))), np.pad(down, ((0, 0), (0, more)))
            at = (np.repeat(cell, size), terms)
            np.maximum.at(up, at, weights)
            np.minimum.at(down, at, weights)
            count += np.bincount(cell, minlength=cells)
        c, t = np.nonzero((up > 0) | (down < 0))
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([c, some]).astype(np.int32)),
                pa.array(np.concatenate([t, np.full(len(some), -1)])),
                pa.array(np.concatenate([up[c, t], count[some].astype(float)])),
                pa.array(np.concatenate([down[c, t], np.zeros(len(some))])),
            ],
            names=["cell", "term", "high", "low"],
        )

    def bounds(df: DataFrame) -> tuple[np.ndarray, np.ndarray, list[int]]:
        e = df.mapInArrow(extremes, "cell int, term bigint, high double, low double").groupBy("cell", "term")
        found = e.agg(F.max("high"), F.min("low"), F.sum("high")).toArrow()  # at most CELLS times the terms
        cell, term, high, low, total = (c.to_numpy() for c in found.columns)
        up = np.zeros((tops.shape[1], max(width, int(term.max(initial=0)) + 1)))
        down = up.copy()
        some = term >= 0
        up[cell[some], term[some]], down[cell[some], term[some]] = high[some], low[some]
        sizes = np.zeros(tops.shape[1])
        sizes[cell[~some]] = total[~some]
        return up, down, sizes.astype(int).tolist()

    def meets(df: DataFrame, up: np.ndarray, down: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(0, batch.num_rows, STRIP):
                    part = batch.slice(k, STRIP)
                    part = pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in part.columns], schema=part.schema)
                    x = _vectors(part, up.shape[1])
                    over = np.maximum(x, 0) @ up.T + np.minimum(x, 0) @ down.T >= threshold - MARGIN
                    edge = np.concatenate([[0], np.cumsum(over.sum(axis=1))]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(edge), pa.array(np.nonzero(over)[1].astype(np.int32)))], names=[*part.schema.names, "meets"])

        return df.mapInArrow(run, f"{ddl}, meets array<int>")

    columns = _columns(left)
    ddl = f"chunk_id bigint, ti array<int>, tw array<double>, {'copies array<bigint>, ' if 'copies' in columns else ''}cell int"
    x = stage(left.select(*columns).mapInArrow(place, ddl), "cells")
    y = x if right is None else stage(right.select(*columns).mapInArrow(place, ddl), "cells")
    up, down, ny = bounds(y)
    if right is None:
        both = meets(x, up, down)
        return both, both, ny, ny
    own_up, own_down, nx = bounds(x)
    return meets(x, up, down), meets(y, own_up, own_down), nx, ny


def _dealt_near(left: DataFrame, right: DataFrame | None, threshold: float) -> DataFrame:
    """As _dealt, without the rows that have no product of the threshold or more in a tile."""
    if max(left.count(), 0 if right is None else right.count()) <= (LEAST_BLOCKS - 1) * ROWS:
        return _dealt(left, right)
    return _dealt_by_cells(left, right, threshold, ROWS)


def _dealt_by_cells(left: DataFrame, right: DataFrame | None, threshold: float, each: int) -> DataFrame:
    spark = left.sparkSession
    columns = _columns(left)
    x, y, nx, ny = _cells(left, right, threshold, each)

    def blocks(sizes: list[int]) -> tuple[list[int], list[int]]:
        """Of each cell the first of its blocks and how many it has."""
        parts = [-(-n // ROWS) for n in sizes]
        return [sum(parts[:k]) for k in range(len(parts))], parts

    def block(first: list[int], parts: list[int]):
        at = F.col("cell") + 1
        several = F.pmod(F.xxhash64("chunk_id"), F.greatest(F.element_at(_list(parts), at), F.lit(1))).cast("long")
        return F.element_at(_list(first), at) + several

    def others(first: list[int], parts: list[int]):
        """All blocks of the cells that a row meets."""
        spans = F.transform("meets", lambda c: F.struct(F.element_at(_list(first), c + 1).alias("a"), F.element_at(_list(parts), c + 1).alias("n")))
        full = F.filter(spans, lambda z: z["n"] > 0)
        return F.explode(F.flatten(F.transform(full, lambda z: F.sequence(z["a"], z["a"] + z["n"] - 1))))

    (fx, px), (fy, py) = blocks(nx), blocks(ny)
    nr = max(1, sum(py))
    a = x.select(*columns, block(fx, px).alias("i"), others(fy, py).alias("j")).withColumn("side", F.lit(0))
    b = y.select(*columns, block(fy, py).alias("j"), others(fx, px).alias("i")).withColumn("side", F.lit(1))
    both = a.unionByName(b)
    if right is None:
        both = both.where("i <= j")
    both = both.withColumn("tile", F.col("i") * nr + F.col("j")).withColumn("same", (F.col("i") == F.col("j")) & F.lit(right is None))
    # a tile's partition is a hash of it: tiles that are opened lie anywhere among the possible ones
    tasks = min(_TASKS, max(4 * spark.sparkContext.defaultParallelism, -(-sum(nx) // ROWS) * -(-sum(ny) // ROWS)))
    spread = both.select("tile", "side", "same", *columns).repartitionById(tasks, F.pmod(F.xxhash64("tile"), F.lit(tasks)).cast("int"))
    return spread.sortWithinPartitions("tile", "side")


def _list(numbers: list[int]):
    return F.array(*[F.lit(k).cast("long") for k in numbers])


def opened_tiles(packed: DataFrame, threshold: float, each: int = 128) -> tuple[int, int]:
    """How many tiles there are with so many vectors to a cell, and how many have rows on both sides."""
    dealt = _dealt_by_cells(packed, None, threshold, each)
    n = sum(-(-r["count"] // ROWS) for r in _cells(packed, None, threshold, each)[0].groupBy("cell").count().collect())  # a row a cell
    opened = dealt.groupBy("tile").agg(F.min("side").alias("a"), F.max("side").alias("b")).where("a < b").count()
    return n * (n + 1) // 2, opened


def _piece(batch: pa.RecordBatch, k: int, side: str) -> Rows:
    kinds = {"ids": np.int64, "size": np.int64, "terms": np.int32, "weights": np.float64, "copies": np.int64, "n_copies": np.int64}
    return Rows([tuple(np.frombuffer(batch.column(f"{side}_{name}")[k].as_buffer(), kind) for name, kind in kinds.items())])


def _pieces(df: DataFrame, n: int, side: str) -> DataFrame:
    """Vectors in n blocks by a hash of their ids, up to PIECE of them a row; each block is a partition.  They are shuffled twice."""
    names = ["ids", "size", "terms", "weights", "copies", "n_copies"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            block = batch.column("block")[0].as_py()  # that of the partition
            end = batch.column("tw").offsets.to_numpy().astype(np.int64)
            lo = 0
            while lo < batch.num_rows:
                fits = int(np.searchsorted(end, end[lo] + PIECE_BYTES // 8, side="right")) - 1
                hi = min(batch.num_rows, lo + PIECE, max(lo + 1, fits))
                part = batch.slice(lo, hi - lo)
                arrays = _parts(pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in part.columns], schema=part.schema))
                kinds = (np.int64, np.int64, np.int32, np.float64, np.int64, np.int64)
                packed = [pa.array([a.astype(t, copy=False).tobytes()], pa.binary()) for a, t in zip(arrays, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([int(arrays[0][0])], pa.int64()), *packed], names=["block", "first", *names])
                lo = hi

    block = F.pmod(F.xxhash64("chunk_id"), F.lit(n)).cast("int")
    dealt = df.select(*_columns(df), block.alias("block")).repartitionById(n, F.col("block"))
    made = dealt.mapInArrow(run, f"block int, first bigint, {', '.join(f'{x} binary' for x in names)}").repartitionById(n, F.col("block"))
    return made.select(*[F.col(c).alias(f"{side}_{c}") for c in made.columns])


def _crossed(left: DataFrame, right: DataFrame | None) -> DataFrame:
    """Pairs of pieces: all of left with all of right, or, without right, each two of left once and each with itself.

    Blocks are read by all tasks that need them from where they were shuffled to, so what is on disk grows with the vectors and not with
    the tiles.
    """
    least = math.ceil(math.sqrt((12 if right is None else 6) * left.sparkSession.sparkContext.defaultParallelism))

    def blocks(df: DataFrame) -> int:
        n = df.count()
        return max(1, -(-n // ROWS), min(-(-n // 1024), least))

    nl = blocks(left)
    x = _pieces(left, nl, "l")
    if right is not None:
        return x.crossJoin(_pieces(right, blocks(right), "r").hint("shuffle_replicate_nl")).withColumn("same", F.lit(False))
    y = _pieces(left, nl, "r").hint("shuffle_replicate_nl")
    once = (F.col("l_block") < F.col("r_block")) | ((F.col("l_block") == F.col("r_block")) & (F.col("l_first") <= F.col("r_first")))
    return x.join(y, once).withColumn("same", F.col("l_first") == F.col("r_first"))


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Rows, Iterator[tuple[Rows, bool]]]]:
    """The left pieces of a partition, each with the right ones that it meets, and whether that is itself."""
    pairs = ((batch, k) for batch in batches for k in range(batch.num_rows))
    for _, group in itertools.groupby(pairs, lambda at: at[0].column("l_first")[at[1]].as_py()):
        head = next(group)

        def right(pairs: Iterator[tuple[pa.RecordBatch, int]]) -> Iterator[tuple[Rows, bool]]:
            for batch, k in pairs:
                yield _piece(batch, k, "r"), batch.column("same")[k].as_py()

        yield _piece(*head, "l"), right(itertools.chain([head], group))


def _over_pieces(df: DataFrame, kernel: Callable[[Iterator[tuple[Rows, Iterator[tuple[Rows, bool]]]]], Iterator[Hits]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in kernel(_met(batches)):
            for k in range(0, len(columns[0]), _EXACT):
                yield pa.RecordBatch.from_arrays([pa.array(c[k : k + _EXACT], t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["a", "b", "sim"])

    return df.mapInArrow(run, "a bigint, b bigint, sim double")


def _over(df: DataFrame, kernel: Callable[[Rows, Iterator[Rows], bool], Iterator[Hits]], schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    types = {"bigint": pa.int64(), "double": pa.float64()}
    kinds = [types[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for left, right, same in _tiles(batches):
            for columns in kernel(left, right, same):
                for k in range(0, len(columns[0]), _EXACT):
                    yield pa.RecordBatch.from_arrays([pa.array(c[k : k + _EXACT], t) for c, t in zip(columns, kinds, strict=True)], names=names)
            del left, right  # before the next tile is read

    return df.mapInArrow(run, schema)


def _copied(left: Rows, i: np.ndarray, strip: _Strip, j: np.ndarray, sim: np.ndarray) -> Iterator[Hits]:
    """All copies of the left rows with all of the right rows."""
    right, j = strip.rows, strip.lo + j
    n, m = left.n_copies[i], right.n_copies[j]
    total = np.cumsum(n * m)
    lo = 0
    while lo < len(i):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + 10 * _EXACT, side="right")))
        each = n[lo:hi] * m[lo:hi]
        at = np.repeat(np.arange(lo, hi), each)
        k = np.arange(len(at)) - np.repeat(np.cumsum(each) - each, each)
        yield left.copies[left.first_copy[i[at]] + k // m[at]], right.copies[right.first_copy[j[at]] + k % m[at]], sim[at]
        lo = hi


def tile_pairs(packed: DataFrame, threshold: float) -> DataFrame:
    """(a, b, sim) with a < b and sim >= threshold, each once, of (chunk_id, ti, tw).  Where there is a column of copies
    (array<bigint>) a row stands for the ids in it, and pairs are those of its copies with those of other rows."""

    def kernel(met: Iterator[tuple[Rows, Iterator[tuple[Rows, bool]]]]) -> Iterator[Hits]:
        for left, right in met:
            side = _Left(left)
            for rows, same in right:
                for strip, (i, j, sim) in _hits(side, iter([rows]), threshold, same):
                    for a, b, s in _copied(left, i, strip, j, sim):
                        yield np.minimum(a, b), np.maximum(a, b), s

    return _over_pieces(_crossed(packed, None), kernel)


def _best(a: np.ndarray, b: np.ndarray, sim: np.ndarray, limit: int) -> Hits:
    """Of each a the `limit` nearest, equal ones by b."""
    order = np.lexsort((b, -sim, a))
    a, b, sim = a[order], b[order], sim[order]
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
    place = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))
    keep = place < limit
    return a[keep], b[keep], sim[keep]


class _Nearest:
    """The `limit` nearest of rows 0, 1, 2, ..., of hits as they come."""

    def __init__(self, n: int, limit: int):
        self.limit = limit
        self.held: Hits = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.new: list[Hits] = []
        self.waiting = 0
        #: what a hit must reach to be among a row's nearest
        self.floor = np.full(n, -np.inf)

    def add(self, place: np.ndarray, other: np.ndarray, sim: np.ndarray) -> None:
        near = sim >= self.floor[place]
        self.new.append((place[near], other[near], sim[near]))
        self.waiting += len(self.new[-1][0])
        if self.waiting > max(_WAITING, len(self.held[0]) // 2):
            self.settle()

    def settle(self) -> Hits:
        if self.new:
            self.held = place, _, sim = _best(*(np.concatenate(x) for x in zip(self.held, *self.new, strict=True)), self.limit)
            self.new, self.waiting = [], 0
            full = np.flatnonzero(place[self.limit - 1 :] == place[: max(0, len(place) - self.limit + 1)])
            self.floor[place[full]] = sim[full + self.limit - 1]
        return self.held


def tile_nearest(packed: DataFrame, threshold: float, limit: int, others: DataFrame | None = None, digits: int = 9) -> DataFrame:
    """(a, b, sim): at least the `limit` nearest b of each a, itself left out, with sim >= threshold.

    Products are rounded, so that equal ones are equal; ties go by id.  Each tile gives its own best, so there are
    up to limit rows for each a, block and piece met.  others: where b is looked for, else packed itself.
    """
    both_ways = others is None

    def kernel(met: Iterator[tuple[Rows, Iterator[tuple[Rows, bool]]]]) -> Iterator[Hits]:
        nearest: dict[int, tuple[np.ndarray, _Nearest]] = {}  # of the right pieces of this tile
        for left, right in met:
            side, mine = _Left(left), _Nearest(len(left.ids), limit)
            for rows, same in right:
                theirs = None
                if both_ways and not same:
                    _, theirs = nearest.setdefault(int(rows.ids[0]), (rows.ids, _Nearest(len(rows.ids), limit)))
                for strip in side.strips(iter([rows])):
                    for k in range(len(side.blocks)):

                        def reach(s: np.ndarray, lo: int, hi: int, at: int = strip.lo, theirs: _Nearest | None = theirs, mine: _Nearest = mine) -> np.ndarray:
                            found = s >= (np.maximum(mine.floor[lo:hi, None], threshold) - MARGIN).astype(np.float32)
                            if theirs is not None:
                                found |= s >= (np.maximum(theirs.floor[None, at : at + s.shape[1]], threshold) - MARGIN).astype(np.float32)
                            return found

                        for i, j, sim in side.hits(k, strip, reach, np.not_equal):
                            keep = sim >= threshold
                            i, j, sim = i[keep], j[keep], np.round(sim[keep], digits)
                            mine.add(i, strip.ids[j], sim)
                            if theirs is not None:
                                theirs.add(strip.lo + j, left.ids[i], sim)
            i, b, sim = mine.settle()
            yield left.ids[i], b, sim
        for ids, theirs in nearest.values():
            j, b, sim = theirs.settle()
            yield ids[j], b, sim

    return _over_pieces(_crossed(packed, others), kernel)


def tile_top(packed: DataFrame, limit: int, others: DataFrame | None = None, digits: int = 12, least: int = 1) -> DataFrame:
    """As tile_nearest without a threshold.  Of a strip those are taken up that can be among the best of their row, or,
    where both sides are asked for, of their column, by a product in single precision and its margin."""
    both_ways = others is None

    def floor(s: np.ndarray, axis: int) -> np.ndarray:
        k = min(limit, s.shape[axis])
        return np.partition(s, s.shape[axis] - k, axis=axis).take(s.shape[axis] - k, axis=axis)

    def kernel(left: Rows, right: Iterator[Rows], same: bool) -> Iterator[Hits]:
        side, mine = _Left(left), _Nearest(len(left.ids), limit)
        best = np.full(len(left.ids), -np.inf, np.float32)
        for strip in side.strips(right):
            theirs = _Nearest(len(strip.ids), limit) if both_ways and not same else None
            for k, (lo, hi) in enumerate(side.blocks):
                s = side.product(k, strip)
                s[left.ids[lo:hi, None] == strip.ids[None, :]] = -np.inf
                best[lo:hi] = np.maximum(best[lo:hi], floor(s, 1))
                found = s >= best[lo:hi, None] - MARGIN
                if theirs is not None:
                    found |= s >= np.maximum(floor(s, 0), theirs.floor)[None, :] - MARGIN
                i, j = np.nonzero(found & (s > -np.inf))
                if not len(i):
                    continue
                i += lo
                sim = np.round(_exact(left, i, strip.dense, j), digits)
                mine.add(i, strip.ids[j], sim)
                if theirs is not None:
                    theirs.add(j, left.ids[i], sim)
            if theirs is not None:
                j, b, sim = theirs.settle()
                yield strip.ids[j], b, sim
        i, b, sim = mine.settle()
        yield left.ids[i], b, sim

    return _over(_dealt(packed, others, least), kernel, "a bigint, b bigint, sim double")


def tile_members(packed: DataFrame, listed: DataFrame, threshold: float) -> DataFrame:
    """(id): the chunks of packed with a cosine of the threshold or more to one of listed; may repeat.

    A list of up to LISTED vectors goes to all tasks, and packed is not shuffled.
    """

    def kernel(left: Rows, right: Iterator[Rows], same: bool) -> Iterator[tuple[np.ndarray]]:
        for strip, (_, j, _) in _hits(left, right, threshold, False):
            yield (np.unique(strip.ids[j]),)

    few = listed.select("chunk_id", "ti", "tw").limit(LISTED + 1).toArrow()
    if few.num_rows > LISTED:
        return _over(_dealt_near(listed, packed, threshold), kernel, "id bigint")
    parts = [_parts(b) for b in few.to_batches() if b.num_rows]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if parts:
            for (ids,) in kernel(Rows(parts), (Rows([_parts(b)]) for b in batches if b.num_rows), False):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64())], names=["id"])

    return packed.select("chunk_id", "ti", "tw").mapInArrow(run, "id bigint")
