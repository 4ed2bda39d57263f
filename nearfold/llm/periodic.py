"""Periodic runs of words: stretches that repeat a period over and over, found in time near linear in the text.

A text's words are numbered by hash.  Prefix doubling sorts its suffixes; the ranks of every round stay, so how far
two places agree, forwards or backwards, takes a look at each round.  Suffix array and longest common prefixes give
the longest previous factor at each word, and those cut the text into Lempel-Ziv blocks.  A run either touches a
border of blocks or lies inside one.  Those at a border follow from how far the words around it agree with the words
a period away (Main); no period there is as long as the two blocks beside it.  A block that has been before has the
same runs inside as at its earlier place, so those are copied, by buckets of their starts.

All texts of a batch go through the numeric steps together; two texts never share a rank.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import WORD, Texts, U, Words, find_words, hash_words, mix, text_slices

EXPONENT, LEAST = 4, 6
RUN = T.ArrayType(T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")]))
_RUN = pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])


def suffix_ranks(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array, and for windows of 1, 2, 4, ... words the rank of the window at each place.

    first: numbers that tell words of one text from each other and from those of other texts.  end: where the text of a
    place ends.  Windows that reach over it equal no other; two places have the same rank if their windows are
    equal.  The last round has none that are.  Rank arrays have one more item, that equals none.
    """
    n = len(first)
    sa = np.argsort(first, kind="stable")
    step = np.ones(n, bool)
    step[1:] = first[sa][1:] != first[sa][:-1]
    head = np.maximum.accumulate(np.where(step, np.arange(n), 0))
    rank = np.full(n + 1, -1, np.int64)
    rank[sa] = head
    levels, k = [rank], 1
    alone = step & np.append(step[1:], True)
    todo = sa[~alone]
    while len(todo):
        after = todo + k
        second = np.where(after < end[todo], rank[np.minimum(after, n)] + 1, 0)
        key = rank[todo] * (n + 1) + second
        order = np.argsort(key, kind="stable")
        todo, key = todo[order], key[order]
        old = rank[todo]
        at = np.arange(len(todo))
        group = np.ones(len(todo), bool)
        group[1:] = old[1:] != old[:-1]
        begin = np.maximum.accumulate(np.where(group, at, 0))
        step = np.ones(len(todo), bool)
        step[1:] = key[1:] != key[:-1]
        rank = rank.copy()
        rank[todo] = old + np.maximum.accumulate(np.where(step, at, 0)) - begin
        sa[old + at - begin] = todo
        levels.append(rank)
        k *= 2
        todo = todo[~(step & np.append(step[1:], True))]
    return sa, levels


def _agree(levels: list[np.ndarray], x: np.ndarray, y: np.ndarray, back: bool = False) -> np.ndarray:
    """How many words from x on equal those from y on; back: how many before x equal those before y."""
    top = np.full(len(x), -1)
    some = np.arange(len(x))
    for j, rank in enumerate(levels):
        a, b = x[some], y[some]
        if back:
            fits = np.minimum(a, b) >= 1 << j
            some, a, b = some[fits], a[fits] - (1 << j), b[fits] - (1 << j)
        some = some[rank[a] == rank[b]]
        if not len(some):
            break
        top[some] = j
    order = np.argsort(-top, kind="stable")
    long = np.searchsorted(-top[order], 0, side="right")
    order = order[:long]
    high, out = top[order], np.zeros(len(x), np.int64)
    for j in range(int(high.max(initial=-1)), -1, -1):
        some = order[: np.searchsorted(-high, -j, side="right")]
        n = out[some]
        if back:
            a, b = x[some] - n - (1 << j), y[some] - n - (1 << j)
            fits = np.minimum(a, b) >= 0
            some, a, b, n = some[fits], a[fits], b[fits], n[fits]
        else:
            a, b = x[some] + n, y[some] + n
        out[some] = n + ((levels[j][a] == levels[j][b]).astype(np.int64) << j)
    return out


def previous_factors(sa: np.ndarray, levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each place the length of its longest factor that also starts at an earlier place, and one such place.

    A scan of the suffix array with its longest common prefixes; a suffix leaves the stack when the nearest ones of
    earlier places on both sides are known.
    """
    n = len(sa)
    longest, source = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    first = levels[0]
    near = np.flatnonzero(first[sa[1:]] == first[sa[:-1]]) + 1  # neighbours that share a word
    lcp = np.zeros(n + 1, np.int64)
    lcp[near] = _agree(levels, sa[near - 1], sa[near])
    # only groups of suffixes that share their first word matter; a 0 divides them
    member = lcp[:-1] > 0
    member[:-1] |= lcp[1:-1] > 0
    place = sa[member].tolist()
    common = [*lcp[:-1][member].tolist(), 0]
    place.append(-1)
    stack: list[int] = []
    places: list[int] = []
    found: list[int] = []
    origin: list[int] = []
    for r, at in enumerate(place):
        low = common[r]
        while stack:
            top = stack[-1]
            was, high = place[top], common[top]
            if at < was:
                below = place[stack[-2]] if len(stack) > 1 else -1
                places.append(was)
                if high > low:
                    found.append(high)
                    origin.append(below)
                else:
                    found.append(low)
                    origin.append(at)
                    high, low = low, high
                low = min(low, high)
            elif low <= high:
                places.append(was)
                found.append(high)
                origin.append(place[stack[-2]] if len(stack) > 1 else -1)
            else:
                break
            stack.pop()
        common[r] = low
        stack.append(r)
    at = np.array(places, np.int64)
    known = at >= 0
    longest[at[known]] = np.array(found, np.int64)[known]
    source[at[known]] = np.array(origin, np.int64)[known]
    return longest, source


def blocks(longest: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Starts of the Lempel-Ziv blocks of all texts, ascending."""
    step = np.maximum(longest, 1).tolist()
    out: list[int] = []
    for lo, hi in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True):
        while lo < hi:
            out.append(lo)
            lo += step[lo]
    return np.array(out, np.int64)


def _at_borders(levels: list[np.ndarray], starts: np.ndarray, bound: np.ndarray, doc: np.ndarray, exponent: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of the runs that hold or touch a border between blocks or the end of a text; end is the
    place after the last word.  The period is the smallest."""
    stop = np.append(starts[1:], bound[-1])
    of = doc[starts]
    last = np.append(of[1:] != of[:-1], True)
    stop = np.where(last, bound[of + 1], stop)
    left = stop - starts
    right = np.where(last, 0, np.append(left[1:], 0))
    # with L words of a run before the border and R after it, L < left + period and R <= right
    most = (left + right - 1) // (exponent - 1)
    border, lo, hi = np.repeat(stop, most), np.repeat(bound[of], most), np.repeat(bound[of + 1], most)
    period = np.arange(len(border)) - np.repeat(np.cumsum(most) - most, most) + 1
    x = np.concatenate([border, border - period])
    y = np.concatenate([border + period, border])
    lo, hi, period = np.tile(lo, 2), np.tile(hi, 2), np.tile(period, 2)
    inside = (x >= lo) & (y <= hi)
    x, y, period = x[inside], y[inside], period[inside]
    first = levels[0]
    some = (first[x] == first[y]) | ((x > 0) & (first[x - 1] == first[y - 1]))
    x, y, period = x[some], y[some], period[some]
    start = x - _agree(levels, x, y, back=True)
    end = y + _agree(levels, x, y)
    keep = (end - start >= exponent * period) & (end - start >= least)
    start, end, period = start[keep], end[keep], period[keep]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return start[new], end[new], period[new]


def find_runs(h: np.ndarray, w: Words, exponent: int = EXPONENT, least: int = LEAST) -> dict[int, list[tuple[int, int, int]]]:
    """By text (its number in the batch) the runs (start, length, period) in order of start and period.

    A run has at least `exponent` periods and `least` words, its period is the smallest it has, and no word next to it
    continues it.
    """
    if exponent < 2:
        raise ValueError("a run has at least two periods")
    if not len(h):
        return {}
    end = w.bound[1:][w.doc]
    # numbers of words: their hashes, told apart by text
    sa, levels = suffix_ranks(mix(h + w.doc.astype(U) * U(0x9E3779B97F4A7C15)), end)
    longest, source = previous_factors(sa, levels)
    starts = blocks(longest, w.bound)
    begin, stop, period = _at_borders(levels, starts, w.bound, w.doc, exponent, least)
    out: dict[int, list[tuple[int, int, int]]] = {}
    edges = np.searchsorted(begin, w.bound)
    for k in np.unique(w.doc[begin]).tolist():
        lo, hi = int(w.bound[k]), int(w.bound[k + 1])
        a, b = edges[k], edges[k + 1]
        bucket: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for s, e, q in zip(begin[a:b].tolist(), stop[a:b].tolist(), period[a:b].tolist(), strict=True):
            bucket[s].append((e, q))
        mine = starts[np.searchsorted(starts, lo) : np.searchsorted(starts, hi)]
        size = longest[mine]
        for at, n in zip(mine[size > least].tolist(), size[size > least].tolist(), strict=True):
            back = at - int(source[at])
            for s in range(at + 1, at + n - least):
                for e, q in bucket.get(s - back, ()):  # what lies inside at the earlier place
                    if e + back < at + n:
                        bucket[s].append((e + back, q))
        out[k] = [(s - lo, e - s, q) for s in sorted(bucket) for q, e in sorted((q, e) for e, q in bucket[s])]
    return out


def _kept_texts(t: Texts, w: Words, keep: np.ndarray) -> pa.Array:
    """The words that stay of each text, joined by one space."""
    start, end, doc = w.start[keep], w.end[keep], w.doc[keep]
    mark = np.zeros(len(t.buf) + 1, np.int8)
    mark[start] += 1
    mark[end] -= 1
    letters = t.buf[np.cumsum(mark[:-1], dtype=np.int8).astype(bool)]
    later = np.zeros(len(start), bool)
    later[1:] = doc[1:] == doc[:-1]
    size = end - start + later
    at = np.cumsum(size) - size
    text = np.ones(int(size.sum()), bool)
    text[at[later]] = False
    data = np.full(len(text), 32, np.uint8)
    data[text] = letters
    offs = np.zeros(len(t) + 1, np.int64)
    np.cumsum(np.bincount(doc, size, len(t)).astype(np.int64), out=offs[1:])
    return pa.LargeStringArray.from_buffers(len(t), pa.py_buffer(offs), pa.py_buffer(data)).cast(pa.string())


def _collapse(width: int, text: int, exponent: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in text_slices(batch.column(text)):
                w = find_words(t)
                runs = find_runs(hash_words(t, w), w, exponent, least)
                keep = np.ones(len(w.start), bool)
                for k, found in runs.items():
                    for start, length, period in found:
                        a = int(w.bound[k]) + start
                        keep[a + period : a + length] = False
                listed = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in runs.get(k, ())] for k in range(len(t))], pa.list_(_RUN))
                rest = [batch.column(j).slice(t.first, len(t)) for j in range(width)]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(np.diff(w.bound)), listed, _kept_texts(t, w, keep)], names=[f"c{j}" for j in range(width + 3)])

    return run


def collapse_runs(docs: DataFrame, exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """docs with n_words, runs (start, length, period of each, in words from 0) and kept: the text whose runs are cut
    to their first period, words joined by one space.

    Defined results: a null or empty text has no words, no runs and an empty `kept`; other columns, whatever their
    names, pass on, but for n_words, runs and kept, which give way; repeated rows are treated alike, and doc_id isn't
    read; an empty table gives no rows.  A text is taken whole: it needs about 250 bytes a word of a worker's memory
    while its runs are sought, and 8 more for each doubling of its longest repeat.
    """
    docs = docs.drop("n_words", "runs", "kept")
    names = docs.columns
    more = (T.LongType(), RUN, T.StringType())
    schema = T.StructType([T.StructField(f"c{j}", f.dataType) for j, f in enumerate(docs.schema.fields)] + [T.StructField(f"c{len(names) + k}", t) for k, t in enumerate(more)])
    return docs.mapInArrow(_collapse(len(names), names.index("text"), exponent, least), schema).toDF(*names, "n_words", "runs", "kept")


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text, a tenth of the texts made periodic from a word on, as the query's contract fixes it.

    A null doc_id changes nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    x = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"))
    w = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    x = x.withColumn("w", F.when(F.col("h") % 10 == 0, w)).withColumn("n", F.size("w").cast("long"))
    x = x.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    x = x.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    place = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")))
    edited = F.array_join(F.transform(place, lambda i: F.get("w", i.cast("int"))), " ")
    return x.select("doc_id", F.when(F.col("n") > 0, edited).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    x = collapse_runs(with_planted_periods(docs))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    x = x.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"))
    length, period = F.col("best.n"), -F.col("best.p")
    return x.select("doc_id", "n_runs", (-F.col("best.s")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
