"""Substring deduplication by fixed-block anchors.

A window of 50 words holds a whole block of 25 wherever blocks begin, so blocks at every 25th word of each
document are enough of an index: two documents with a window in common both hold some block of the first.

1. Index the non-overlapping blocks and probe them with every rolling window of 25 words, by ranges of the
   hash: an anchor of a document is one of its blocks that another document holds anywhere.  A mapper settles
   what several of its documents hold, and names to the range only the least and the largest of them, for
   other mappers to see.
2. A document's hits are extended: every window of 50 words that contains an anchor is a candidate, and
   candidates are matched on the hash of all 50 words.  Windows that follow each other make up the maximal
   repeats.  Again a mapper settles what it can: of its documents that have a window only the least goes to
   the range, the others are later ones whatever the rest of the corpus holds.
3. Words covered by a window that also starts in a document with a smaller doc_id go.

Hashes travel in sorted blocks.  A passage that many documents share costs each of them its own hits and no
pairs, and the range that gets its hash a few entries for each mapper's block, not for each document.

Defined results: a null or empty text has no words; windows of one doc_id never count against that doc_id,
so repeated rows, and rows that share a doc_id, stay as they are against each other; a row with a null doc_id neither loses words nor
counts; an empty table gives an empty one; other columns pass through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blobs import HASH_BITS, MOST_DOCS, OWNED, OWNED_DDL, by_owner, cut_ranges, decode, encode, gathered, packed, range_bits, table, unpacked
from .scratch import Scratch
from .words import WORD, find_words, hash_words, long_grams, text_slices

WINDOW = 50
ANCHOR = WINDOW // 2
_INDEXED = 1 << 15
#: Windows that a mapper gathers before it writes a block.
_HELD = 3_000_000
_PROBES = pa.schema([("p", pa.int32()), ("owners", pa.binary()), ("steps", pa.binary()), ("places", pa.binary())])
_HITS = pa.schema([("doc_id", pa.int64()), ("hits", pa.binary())])
U = np.uint64


def _ends(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of ascending hashes, at least one: where each begins, and the least and the largest document of each."""
    start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return start, np.minimum.reduceat(doc, start), np.maximum.reduceat(doc, start)


def _direct(out: dict[str, list], rows: pa.RecordBatch, data: str) -> None:
    """Rows for the documents themselves, under -1 - bucket; they pass by the ranges."""
    for r in rows.to_pylist():
        for name in out:
            out[name].append(b"")
        for name, v in (("p", -1 - r["bucket"]), ("owners", r["owners"]), ("places", r["counts"]), (data, r["data"])):
            out[name][-1] = v


def _passed(p: int, group: pa.Table, data: str) -> pa.Table:
    n = group.num_rows
    extra = pa.array([bytes(2 * len(x)) for x in group["places"].to_pylist()], pa.binary())  # 8 bytes for 4 of counts
    return pa.Table.from_arrays([pa.array([-1 - p] * n, pa.int32()), group["owners"], extra, group["places"], group[data]], schema=OWNED)


def _probe(bits: int, anchor: int):
    """Every rolling window of `anchor` words by range; those that are index blocks are marked."""

    def block(keys: list[np.ndarray], marks: list[np.ndarray], ids: list[np.ndarray]) -> pa.RecordBatch:
        # of several windows alike in one document one is enough; it is marked if any is a block
        key = np.unique(np.concatenate(keys))
        indexed = np.zeros(len(key), bool)
        indexed[np.searchsorted(key, np.concatenate(marks))] = True
        h50, place = unpacked(key)
        owners = np.concatenate(ids).astype("<i8")
        out: dict[str, list] = {f.name: [] for f in _PROBES}
        if len(key):
            doc = owners[place]
            start, least, most = _ends(h50, doc)
            size = np.diff(np.append(start, len(key)))
            here = np.repeat(least < most, size)
            _direct(out, by_owner(doc[here & indexed], h50[here & indexed].astype("<u8"), max(0, bits - 1)), "steps")
            # where several hold a hash, one row of the least and one of the largest doc_id stand for all
            stays = ~here
            for end in (least, most):
                at = np.flatnonzero(here & (doc == np.repeat(end, size)))
                _, one = np.unique(h50[at], return_index=True)
                stays[at[one]] = True
            indexed &= ~here
            h50, place, indexed = h50[stays], place[stays], indexed[stays]
        edges = cut_ranges(h50, bits)
        for p in range(1 << bits):
            a, b = edges[p], edges[p + 1]
            if a < b:
                there, local = np.unique(place[a:b], return_inverse=True)
                steps, places, _ = encode(h50[a:b], local | np.where(indexed[a:b], _INDEXED, 0), bits, p)
                for name, v in zip(_PROBES.names, (p, owners[there].tobytes(), steps, places), strict=True):
                    out[name].append(v)
        return table(out, _PROBES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        marks: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        docs = held = 0
        for batch in batches:
            own = batch.column(0).to_numpy()
            for t in text_slices(batch.column(1), 2 << 20):
                for part in t.parts(MOST_DOCS):
                    if keys and (docs + len(part) > MOST_DOCS or held > _HELD):
                        yield block(keys, marks, ids)
                        keys, marks, ids, docs, held = [], [], [], 0, 0
                    w = find_words(part)
                    h, at = long_grams(hash_words(part, w), w, anchor)
                    doc = w.doc[at]
                    start = (at - w.bound[doc]) % anchor == 0
                    keys.append(packed(h, doc + docs))
                    marks.append(packed(h[start], doc[start] + docs))
                    ids.append(own[part.first : part.first + len(part)])
                    docs += len(part)
                    held += len(h)
        if keys:
            yield block(keys, marks, ids)

    return run


def _anchors(bits: int):
    """Of one range: the anchors of each document."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        p = key[0].as_py()
        if p < 0:
            return _passed(p, group, "steps")
        hs, docs, marks = [], [], []
        for r in group.to_pylist():
            h50, place = decode(r["steps"], r["places"], bits, p)
            hs.append(h50)
            marks.append(place >= _INDEXED)
            docs.append(np.frombuffer(r["owners"], "<i8")[place & (_INDEXED - 1)])
        h, doc, mark = np.concatenate(hs), np.concatenate(docs), np.concatenate(marks)
        del hs, docs, marks
        order = np.argsort(h, kind="stable")
        h, doc, mark = h[order], doc[order], mark[order]
        if len(h):
            start, least, most = _ends(h, doc)
            good = mark & np.repeat(least < most, np.diff(np.append(start, len(h))))
            h, doc = h[good], doc[good]
        return pa.Table.from_batches([by_owner(doc, h.astype("<u8"), max(0, bits - 1))])

    return run


def _to_docs(dtype: str):
    """A row for each document from the rows of its bucket."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        owner, _, edge, item = gathered(group, np.dtype(dtype))
        return pa.Table.from_batches([table({"doc_id": owner.tolist(), "hits": [item[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]}, _HITS)])

    return run


_WINDOWS = pa.schema([("p", pa.int32()), ("owners", pa.binary()), ("steps", pa.binary()), ("places", pa.binary()), ("checks", pa.binary()), ("at", pa.binary())])


#: Bits for the first word of a run of windows (a text has under 2^31 bytes, so at most 2^30 words) and for how many there
#: are; what is left marks the text, for rows may share a doc_id.
_PLACE, _COUNT = 30, 10


def _mark(text: bytes) -> int:
    return zlib.crc32(text) >> (_PLACE + _COUNT - 32)


def _item(mark: np.ndarray, count: np.ndarray | int, place: np.ndarray) -> np.ndarray:
    return mark << U(_PLACE + _COUNT) | (np.zeros(len(place), U) + U(1) * count) << U(_PLACE) | place.astype(U)


def _runs(doc: np.ndarray, place: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of documents as runs of windows that follow each other."""
    order = np.lexsort((place, doc))
    doc, place = doc[order], place[order]
    n = np.arange(len(doc))
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + 1)
    first = np.flatnonzero(new)
    new |= (n - np.repeat(first, np.diff(np.append(first, len(doc))))) % ((1 << _COUNT) - 1) == 0  # as many as fit a count
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(doc))).astype(U)
    return doc[first], _item(marks[doc[first]], count, place[first])


def _extend(bits: int, window: int, anchor: int):
    """Windows around the anchors of each document, by range of their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, MOST_DOCS):
                part = batch.slice(lo, MOST_DOCS)
                ids = part.column(0).to_numpy().astype("<i8")
                lists = part.column(2)
                for t in text_slices(part.column(1), 3 << 20):
                    w = find_words(t)
                    h = hash_words(t, w)
                    small, at = long_grams(h, w, anchor)
                    mine = [np.frombuffer(lists[t.first + i].as_py(), "<u8") for i in range(len(t))]
                    known = np.sort(np.concatenate([x << U(14) | U(i) for i, x in enumerate(mine)]))
                    key = packed(small, w.doc[at])
                    k = np.searchsorted(known, key)
                    hit = at[(k < len(known)) & (known[np.minimum(k, len(known) - 1)] == key)]
                    # windows that begin at most window - anchor words before an anchor
                    near = np.zeros(len(h) + 1, np.int64)
                    np.add.at(near, np.maximum(hit - (window - anchor), 0), 1)
                    np.add.at(near, hit + 1, -1)
                    near = np.cumsum(near)
                    big, start = long_grams(h, w, window)
                    keep = near[start] > 0
                    big, start = big[keep], start[keep]
                    order = np.argsort(big, kind="stable")
                    big, start = big[order], start[order]
                    doc = w.doc[start]
                    out: dict[str, list] = {f.name: [] for f in _WINDOWS}
                    text = np.array([_mark(t.text(i)) for i in range(len(t))], U)
                    if len(big):
                        own = ids[t.first + doc]
                        first, least, _ = _ends(big, own)
                        later = own > np.repeat(least, np.diff(np.append(first, len(big))))
                        who, items = _runs(doc[later], (start - w.bound[doc])[later], text)
                        _direct(out, by_owner(ids[t.first + who], items, max(0, bits - 1)), "at")
                        big, start, doc = big[~later], start[~later], doc[~later]
                    check = (big & U((1 << (64 - HASH_BITS)) - 1)).astype("<u2")  # what the 50 bits leave of the 64
                    h50 = big >> U(64 - HASH_BITS)
                    edges = cut_ranges(h50, bits)
                    for p in range(1 << bits):
                        a, b = edges[p], edges[p + 1]
                        if a < b:
                            there, local = np.unique(doc[a:b], return_inverse=True)
                            steps, places, _ = encode(h50[a:b], local, bits, p)
                            places_of = (start[a:b] - w.bound[doc[a:b]]).astype("<u4")
                            who = ids[t.first + there].tobytes() + text[there].astype("<u4").tobytes()
                            for name, v in zip(_WINDOWS.names, (p, who, steps, places, check[a:b].tobytes(), places_of.tobytes()), strict=True):
                                out[name].append(v)
                    yield table(out, _WINDOWS)

    return run


def _later(bits: int):
    """Of one range: where windows start in a document that also start in one with a smaller doc_id."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        p = key[0].as_py()
        if p < 0:
            return _passed(p, group, "at")
        hs, docs, ats = [], [], []
        for r in group.to_pylist():
            h50, place = decode(r["steps"], r["places"], bits, p)
            hs.append(h50 << U(64 - HASH_BITS) | np.frombuffer(r["checks"], "<u2").astype(U))
            n = len(r["owners"]) // 12  # 8 bytes of doc_id each, then 4 of the mark of the text
            docs.append(np.frombuffer(r["owners"], "<i8", n)[place])
            marks = np.frombuffer(r["owners"], "<u4", n, 8 * n).astype(U)
            ats.append(_item(marks[place], 1, np.frombuffer(r["at"], "<u4")))
        h, doc, at = np.concatenate(hs), np.concatenate(docs), np.concatenate(ats)
        del hs, docs, ats
        order = np.argsort(h, kind="stable")
        h, doc, at = h[order], doc[order], at[order]
        if len(h):
            start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            least = np.repeat(np.minimum.reduceat(doc, start), np.diff(np.append(start, len(h))))
            later = doc > least
            doc, at = doc[later], at[later]
        return pa.Table.from_batches([by_owner(doc, at.astype("<u8"), max(0, bits - 1))])

    return run


def _remove(width: int, text_at: int, window: int):
    """Texts without the words that the listed windows cover, the kept words joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_at)
            lists = batch.column(width)
            for t in text_slices(texts, 4 << 20):
                w = find_words(t)
                out: list[bytes] = []
                gone: list[int] = []
                for i in range(len(t)):
                    a, b = int(w.bound[i]), int(w.bound[i + 1])
                    x = lists[t.first + i]
                    keep = np.ones(b - a, bool)
                    if x.is_valid:
                        items = np.frombuffer(x.as_py(), "<u8")
                        items = items[items >> U(_PLACE + _COUNT) == _mark(t.text(i))]
                        at = (items & U((1 << _PLACE) - 1)).astype(np.int64)
                        n = (items >> U(_PLACE) & U((1 << _COUNT) - 1)).astype(np.int64)
                        cover = np.zeros(b - a + 1, np.int64)
                        np.add.at(cover, at, 1)
                        np.add.at(cover, at + n - 1 + window, -1)
                        keep = np.cumsum(cover[:-1]) <= 0
                    text = t.text(i)
                    base = int(t.offs[i])
                    if keep.all():
                        out.append(b" ".join(text.split()))  # bytes.split() cuts at these same six bytes
                    else:
                        s, e = w.start[a:b][keep] - base, w.end[a:b][keep] - base
                        out.append(b" ".join([text[x:y] for x, y in zip(s.tolist(), e.tolist(), strict=True)]))
                    gone.append(int((~keep).sum()))
                n = len(t)
                rest = [batch.column(j).slice(t.first, n) for j in range(width)]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(np.diff(w.bound)), pa.array(gone, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())], names=[f"c{j}" for j in range(width + 3)])

    return run


def repeated_windows(spark: SparkSession, docs: DataFrame, scratch: Scratch, window: int = WINDOW, per_range: int = 1_000_000) -> DataFrame:
    """(doc_id, hits): the first words of windows that also start in a document with a smaller doc_id, in
    runs, after a mark of the text that they are in."""
    anchor = window // 2
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = range_bits(size // 7, per_range)
    probes = docs.mapInArrow(_probe(bits, anchor), "p int, owners binary, steps binary, places binary")
    hits = probes.groupBy("p").applyInArrow(_anchors(bits), OWNED_DDL).groupBy("bucket").applyInArrow(_to_docs("<u8"), "doc_id long, hits binary")
    by_doc = scratch.save(hits, "hits", codec="none").withColumnRenamed("doc_id", "__id")
    del probes, hits
    scratch.settle()
    held = docs.join(by_doc, docs["doc_id"] == F.col("__id")).select("doc_id", "text", "hits")
    windows = held.mapInArrow(_extend(bits, window, anchor), "p int, owners binary, steps binary, places binary, checks binary, at binary")
    later = windows.groupBy("p").applyInArrow(_later(bits), OWNED_DDL).groupBy("bucket").applyInArrow(_to_docs("<u8"), "doc_id long, hits binary")
    later = scratch.save(later, "later", codec="none")
    del held, windows, by_doc
    scratch.drop("hits")
    scratch.settle()
    return later


def dedup_substrings(spark: SparkSession, docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with n_words, n_removed and kept (the words that stay, joined by one space)."""
    docs = docs.drop("n_words", "n_removed", "kept")
    found = repeated_windows(spark, docs.select("doc_id", "text"), Scratch(spark, "anchors"), window)
    by_doc = found.select(F.col("doc_id").alias("__id"), F.col("hits").alias("__hits"))
    joined = docs.join(by_doc, docs["doc_id"] == F.col("__id"), "left").drop("__id")
    names = docs.columns
    schema = T.StructType([T.StructField(f"c{j}", f.dataType) for j, f in enumerate(docs.schema.fields)] + [T.StructField(f"c{len(names) + k}", t) for k, t in enumerate((T.LongType(), T.LongType(), T.StringType()))])
    return joined.mapInArrow(_remove(len(names), names.index("text"), window), schema).toDF(*names, "n_words", "n_removed", "kept")


def op8_anchor_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = rf"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') as w from documents),
s as (select doc_id, w, unnest(case when len(w) < {WINDOW} then [] else generate_series(1, len(w) - {WINDOW - 1}) end) as b from w),
k as (select doc_id, b, md5(array_to_string(w[b:b + {WINDOW - 1}], ' ')) as key from s),
m as (select key, min(doc_id) as first from k group by 1),
hit as (select k.doc_id, k.b from k join m using (key) where k.doc_id > m.first),
gone as (select distinct doc_id, unnest(generate_series(b, b + {WINDOW - 1})) as pos from hit),
per as (select doc_id, list(pos) as poss, count(*)::bigint as n from gone group by 1)
select w.doc_id, len(w.w)::bigint as n_words, coalesce(per.n, 0)::bigint as n_removed,
       sha256(coalesce(array_to_string(case when per.n is null then w.w else list_filter(w.w, lambda x, i: not list_contains(per.poss, i)) end, ' '), '')) as kept_sha256
from w left join per using (doc_id)
"""
