"""Exact n-gram Jaccard join with a token-group matrix.

Documents are sets of 5-word shingles; two link when their Jaccard similarity is at least 0.75.

1. Equal sets are one set.  Every shingle is counted over all distinct sets, by ranges of its hash.  A set
   linked to another shares at least three quarters of its own shingles with some other set; a set whose
   shared shingles are fewer has no link and goes no further.  What is left carries its shared shingles and
   in how many sets each is.  A shingle that many documents of a mapper's block hold is sent as a count; the
   total comes back to the block, so the list of a frequent shingle grows with blocks and not with documents.
   (Copies in different blocks count anew in such totals.  They order shingles, alike for all sets, and tell
   which are shared; both hold.)
2. Sets are put into groups of similar ones: those whose common shingles (at least half as frequent as the
   set's most frequent) have the same least hash.  A frequent key is split, so a group has a bounded number
   of sets.  Each group stores the union of its shingles.
3. With shingles in ascending frequency, two linked sets share one among the first n - ceil(0.75 n) + 1 of
   each.  Groups that share such a shingle are paired, in two rounds: first each with the next in the
   shingle's list, then those pairs whose sets the links so far haven't all brought together.  So a family of
   near copies of any size costs a chain of pairs.  In a pair, the overlap of each query set with the other
   group's union bounds its overlap with any member; only sets and groups that qualify are opened, and there
   the links are counted exactly.
4. A spanning forest of each pair's links goes to connected components.

Nothing is dropped, capped or sampled: a group of copies of any size is one set, a group of near copies is
split among groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blobs import HASH_BITS, MOST_DOCS, OWNED, OWNED_DDL, by_owner, cut_ranges, decode, encode, gathered, packed, range_bits, table, unpacked
from .components import components
from .scratch import Scratch
from .skew import spread_join
from .words import Words, _short, find_words, grams, hash_words, mix, text_slices

K = 5
GROUP = 256
#: Shingles that a mapper gathers before it writes a block.
_HELD = 2_000_000
#: A shingle in so many sets of a block is sent as a count.
_FREQUENT = 64
#: Lists of groups are chained in so many parts, and the parts' first ones again.
_PARTS = 64
_BLOCK = pa.schema([("p", pa.int32()), ("name", pa.int64()), ("owners", pa.binary()), ("steps", pa.binary()), ("places", pa.binary())])
#: Rows of four kinds: a document (0), a bucket of sets with their shared shingles (1), a block's frequent shingles
#: (2), and in how many sets those are (3); the last two have the block's name as owner.
_SHARED = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("sig", pa.int64()), ("n", pa.int64()), ("owner", pa.int64()), *OWNED])
_SHARED_DDL = "kind int, doc_id long, sig long, n long, owner long, bucket int, owners binary, extra binary, counts binary, data binary"
_PAIR = np.dtype([("h", "<u8"), ("df", "<u4")])
U = np.uint64


def _shingles(h: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """All shingles and their texts, in order of the texts; a text of fewer words is one shingle."""
    s, at = grams(h, w, K)
    doc = w.doc[at]
    counts = np.diff(w.bound)
    short = np.flatnonzero((counts > 0) & (counts < K))
    if len(short):
        s = np.concatenate([s, np.array([_short(h[w.bound[i] : w.bound[i + 1]]) for i in short], U)])
        doc = np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        s, doc = s[order], doc[order]
    return s, doc


def _blocks(bits: int):
    """Blocks of shingles by range, and blocks of documents under range numbers past the last.

    A document is named by where it stands: task, block of the task, place in the block.  A range gets eight
    bytes for each document it meets: 48 bits of the hash of its set, by which copies are known, and the size
    of the set up to 65535.
    """

    def block(turn: int, keys: list[np.ndarray], sigs: list[np.ndarray], ids: list[pa.Array]) -> pa.RecordBatch:
        key = np.sort(np.concatenate(keys))
        if len(key):
            key = key[np.concatenate([[True], key[1:] != key[:-1]])]
        h50, place = unpacked(key)
        sig, own = np.concatenate(sigs), pa.concat_arrays(ids)
        n = np.bincount(place, minlength=len(sig))
        name = TaskContext.get().partitionId() << 38 | turn << 14
        out: dict[str, list] = {f.name: [] for f in _BLOCK}

        def add(p: int, *values: bytes, name: int = name) -> None:
            for c, v in zip(_BLOCK.names, (p, name, *values), strict=True):
                out[c].append(v)

        nulls = np.array(own.is_null().to_numpy(zero_copy_only=False), np.uint8).tobytes()
        add((1 << bits) + turn % (1 << bits), sig.tobytes() + n.astype("<i8").tobytes(), own.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(), nulls)
        # of equal sets in this run of texts one is enough
        _, one = np.unique(sig, return_index=True)
        first = np.zeros(len(sig), bool)
        first[one] = True
        keep = first[place]
        h50, place = h50[keep], place[keep]
        if len(h50):
            run = np.flatnonzero(np.concatenate([[True], h50[1:] != h50[:-1]]))
            size = np.diff(np.append(run, len(h50)))
            often = np.flatnonzero(size >= _FREQUENT)
            if len(often):
                held = np.repeat(size >= _FREQUENT, size)
                add((1 << bits) + turn % (1 << bits), place[held].astype("<u2").tobytes() + np.minimum(n, 0xFFFF).astype("<u2").tobytes(), h50[held].astype("<u8").tobytes(), len(sig).to_bytes(8, "little"), name=-1 - name)
                for p, at in _by_range(h50[run[often]], bits):
                    add(p, b"", h50[run[often[at]]].astype("<u8").tobytes(), size[often[at]].astype("<u4").tobytes(), name=-1 - name)
                h50, place = h50[~held], place[~held]
        known = sig.view(U) >> U(16) << U(16) | np.minimum(n, 0xFFFF).astype(U)
        edges = cut_ranges(h50, bits)
        for p in range(1 << bits):
            a, b = edges[p], edges[p + 1]
            if a < b:
                there, local = np.unique(place[a:b], return_inverse=True)
                steps, places, _ = encode(h50[a:b], local, bits, p)
                add(p, np.concatenate([known[there].view("<u2"), there.astype("<u2")]).tobytes(), steps, places)
        return table(out, _BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        sigs: list[np.ndarray] = []
        ids: list[pa.Array] = []
        docs = held = turn = 0
        for batch in batches:
            for t in text_slices(batch.column(1), 2 << 20):
                for part in t.parts(MOST_DOCS):
                    if keys and (docs + len(part) > MOST_DOCS or held > _HELD):
                        yield block(turn, keys, sigs, ids)
                        keys, sigs, ids, docs, held, turn = [], [], [], 0, 0, turn + 1
                    w = find_words(part)
                    s, doc = _shingles(hash_words(part, w), w)
                    bound = np.searchsorted(doc, np.arange(len(part) + 1))
                    total = np.concatenate([np.zeros(1, U), np.cumsum(mix(s ^ U(0x5851F42D4C957F2D)))])
                    sigs.append(mix(total[bound[1:]] - total[bound[:-1]] + np.diff(bound).astype(U)).view(np.int64))
                    keys.append(packed(s, doc + docs))
                    ids.append(batch.column(0).slice(part.first, len(part)))
                    docs += len(part)
                    held += len(s)
        if keys:
            yield block(turn, keys, sigs, ids)

    return run


def _by_range(h50: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """The ranges that ascending hashes lie in, and which of them lie in each."""
    edges = cut_ranges(h50, bits)
    for p in np.unique(h50 >> U(HASH_BITS - bits)).tolist():
        yield p, slice(int(edges[p]), int(edges[p + 1]))


def _share(bits: int):
    """Of one range: for each document the shingles that a different set has too, with their frequencies."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        p = key[0].as_py()
        if p >= 1 << bits:  # the list of documents passes through
            return _passed(group)
        hs, whose, knowns, owners = [], [], [], []
        frequent: list[tuple[int, np.ndarray, np.ndarray]] = []
        docs = 0
        for i in range(group.num_rows):
            name = group["name"][i].as_py()
            if name < 0:
                frequent.append((-1 - name, np.frombuffer(group["steps"][i].as_py(), "<u8"), np.frombuffer(group["places"][i].as_py(), "<u4")))
                continue
            h50, place = decode(group["steps"][i].as_py(), group["places"][i].as_py(), bits, p)
            raw = np.frombuffer(group["owners"][i].as_py(), "<u2")
            m = len(raw) // 5
            hs.append(h50)
            whose.append((place + docs).astype(np.int32))
            knowns.append(np.frombuffer(raw[: 4 * m].tobytes(), "<u8"))
            owners.append(name + raw[4 * m :].astype(np.int64))
            docs += m
        empty = np.zeros(0, U)
        h, who = np.concatenate([empty, *hs]), np.concatenate([np.zeros(0, np.int32), *whose])
        known, owner = np.concatenate([empty, *knowns]), np.concatenate([np.zeros(0, np.int64), *owners])
        del hs, whose, knowns, owners
        # in how many sets the frequent ones are, by the blocks that only count them
        often, at = np.unique(np.concatenate([empty, *(x for _, x, _ in frequent)]), return_inverse=True)
        counted = np.bincount(at, np.concatenate([np.zeros(0), *(c for _, _, c in frequent)]), len(often)).astype(np.int64)
        order = np.argsort(h, kind="stable")
        h, who = h[order], who[order]
        del order
        # only hashes met more than once can be shared
        same = h[1:] == h[:-1]
        again = (np.concatenate([same, [False]]) | np.concatenate([[False], same]))[: len(h)]
        if len(often):
            k = np.searchsorted(often, h)
            again |= often[np.minimum(k, len(often) - 1)] == h
        h, who = h[again], who[again]
        order = np.lexsort((known[who], h))
        h, who = h[order], who[order]
        k = known[who]
        if len(h):
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (k[1:] != k[:-1])])  # once for each set
            first = np.concatenate([[True], h[1:] != h[:-1]])
            which = np.cumsum(first) - 1
            each = np.bincount(which, new).astype(np.int64)
            if len(often):
                here = h[first]
                k = np.searchsorted(often, here)
                hit = (k < len(often)) & (often[np.minimum(k, len(often) - 1)] == here)
                each[hit] += counted[k[hit]]
                counted[k[hit]] = each[hit]
            df = each[which]
            keep = df > 1
            h, who, df = h[keep], who[keep], df[keep]
        else:
            df = np.zeros(0, np.int64)
        pairs = np.empty(len(h), _PAIR)
        pairs["h"], pairs["df"] = h, np.minimum(df, 0xFFFFFFFF)
        made = [_kind(1, by_owner(owner[who], pairs, max(0, bits - 1), (known[who] & U(0xFFFF)).astype(np.int64)))]
        for name, x, _ in frequent:
            made.append(_answer(name, x, np.minimum(counted[np.searchsorted(often, x)], 0xFFFFFFFF)))
        return pa.concat_tables(made)

    return run


def _rows(columns: dict[str, list]) -> pa.Table:
    """Rows of _SHARED; columns not named are null."""
    m = len(next(iter(columns.values())))
    return pa.Table.from_batches([table({f.name: columns.get(f.name, [None] * m) for f in _SHARED}, _SHARED)])


def _kind(kind: int, rows: pa.RecordBatch) -> pa.Table:
    m = rows.num_rows
    return pa.Table.from_arrays([pa.array([kind] * m, pa.int32()), *[pa.nulls(m, pa.int64())] * 4, *rows.columns], schema=_SHARED)


def _answer(name: int, h: np.ndarray, df: np.ndarray) -> pa.Table:
    pairs = np.empty(len(h), _PAIR)
    pairs["h"], pairs["df"] = h, df
    return _rows({"kind": [3], "owner": [name], "data": [pairs.tobytes()]})


def _passed(group: pa.Table) -> pa.Table:
    """The documents of blocks, and the frequent shingles of each."""
    doc_id: list[int | None] = []
    sig: list[int] = []
    n: list[int] = []
    owner: list[int] = []
    made = []
    for r in group.to_pylist():
        if r["name"] < 0:
            raw = np.frombuffer(r["owners"], "<u2")
            m = int.from_bytes(r["places"], "little")
            made.append(_rows({"kind": [2], "owner": [-1 - r["name"]], "owners": [raw[: len(raw) - m].tobytes()], "extra": [raw[len(raw) - m :].tobytes()], "data": [r["steps"]]}))
            continue
        nulls = np.frombuffer(r["places"], np.uint8).astype(bool)
        both = np.frombuffer(r["owners"], "<i8").reshape(2, -1)
        doc_id += [None if x else i for i, x in zip(np.frombuffer(r["steps"], "<i8").tolist(), nulls, strict=True)]
        sig += both[0].tolist()
        n += both[1].tolist()
        owner += (r["name"] + np.arange(len(nulls))).tolist()
    made.append(_rows({"kind": [0] * len(sig), "doc_id": doc_id, "sig": sig, "n": n, "owner": owner}))
    return pa.concat_tables(made)


def _returned(bits: int):
    """The frequent shingles of a block with their totals, by bucket of documents."""

    def run(key: tuple, held: pa.Table, totals: pa.Table) -> pa.Table:
        made = []
        pairs = [np.frombuffer(x.as_py(), _PAIR) for x in totals["data"]]
        known = np.concatenate(pairs) if pairs else np.zeros(0, _PAIR)
        known = known[np.argsort(known["h"], kind="stable")]
        for r in held.to_pylist():
            place = np.frombuffer(r["owners"], "<u2").astype(np.int64)
            h = np.frombuffer(r["data"], "<u8")
            items = np.empty(len(h), _PAIR)
            items["h"], items["df"] = h, known["df"][np.searchsorted(known["h"], h)]
            made.append(by_owner(r["owner"] + place, items, bits, np.frombuffer(r["extra"], "<u2")[place].astype(np.int64)))
        return pa.Table.from_batches(made, schema=OWNED)

    return run


_ACTIVE = pa.schema([("owner", pa.int64()), ("c", pa.int64()), ("key", pa.int64()), ("tokens", pa.binary())])


def _order(key: tuple, group: pa.Table) -> pa.Table:
    """The documents of a bucket that can have a link: their shared shingles in ascending frequency, and the
    group key."""
    out: dict[str, list] = {f.name: [] for f in _ACTIVE}
    owner, sizes, edge, items = gathered(group, _PAIR)
    for name, n, a, b in zip(owner.tolist(), sizes.tolist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if 4 * (b - a) < 3 * n:
            continue
        x = items[a:b]
        x = x[np.lexsort((x["h"], x["df"]))]
        common = x["h"][2 * x["df"].astype(np.int64) >= int(x["df"].max())]
        for c, v in zip(_ACTIVE.names, (name, b - a, int(mix(common.astype(U)).min().view(np.int64)), np.ascontiguousarray(x["h"]).tobytes()), strict=True):
            out[c].append(v)
    return pa.Table.from_batches([table(out, _ACTIVE)])


class Group:
    """Sets, as rows of a sparse matrix, and the union of their shingles."""

    def __init__(self, sigs: np.ndarray, sizes: np.ndarray, counts: np.ndarray, tokens: np.ndarray):
        self.sigs, self.sizes, self.counts, self.tokens = sigs, sizes, counts, tokens
        self.bound = np.concatenate([[0], np.cumsum(counts)])
        self.union, self.column = np.unique(tokens, return_inverse=True)
        self._postings: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    @classmethod
    def read(cls, image: bytes) -> Group:
        m = int(np.frombuffer(image[:8], "<i8")[0])
        head = np.frombuffer(image[8 : 8 + 24 * m], "<i8").reshape(3, m)
        return cls(head[0], head[1], head[2], np.frombuffer(image[8 + 24 * m :], "<u8"))

    def image(self) -> bytes:
        return np.array([len(self.sigs)], "<i8").tobytes() + np.stack([self.sigs, self.sizes, self.counts]).astype("<i8").tobytes() + self.tokens.astype("<u8").tobytes()

    def bounds(self, union: np.ndarray) -> np.ndarray:
        """The overlap of each set with another group's union."""
        if not len(self.tokens) or not len(union):
            return np.zeros(len(self.sigs), np.int64)
        k = np.searchsorted(union, self.union)
        there = (k < len(union)) & (union[np.minimum(k, len(union) - 1)] == self.union)
        total = np.concatenate([[0], np.cumsum(there[self.column])])
        return total[self.bound[1:]] - total[self.bound[:-1]]

    def postings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self._postings is None:
            owner = np.repeat(np.arange(len(self.sigs)), self.counts)
            order = np.argsort(self.column, kind="stable")
            size = np.bincount(self.column, minlength=len(self.union))
            self._postings = owner[order], np.cumsum(size) - size, size
        return self._postings

    def overlaps(self, query: np.ndarray) -> np.ndarray:
        """How many of the query's shingles each set has."""
        k = np.searchsorted(self.union, query)
        k = k[(k < len(self.union))]
        q = query[: len(k)] if len(k) == len(query) else query[np.searchsorted(self.union, query) < len(self.union)]
        k = k[self.union[k] == q]
        owner, start, size = self.postings()
        n = size[k]
        at = np.repeat(start[k] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.bincount(owner[at], minlength=len(self.sigs))


def linked(a: Group, b: Group, same: bool) -> list[tuple[int, int]]:
    """A spanning forest of the links between two groups (or inside one)."""
    parent = {int(s): int(s) for s in a.sigs} | {int(s): int(s) for s in b.sigs}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    edges: list[tuple[int, int]] = []
    if not same:
        if 4 * a.bounds(b.union).max(initial=0) < 3 * b.sizes.min(initial=1 << 60):
            return edges
        inside = b.bounds(a.union)
        if not (4 * inside >= 3 * b.sizes).any():
            return edges
    over = a.bounds(b.union)
    low = int(b.sizes.min())
    for i in np.flatnonzero((4 * over >= 3 * a.sizes) & (4 * over >= 3 * low)):
        both = b.overlaps(a.tokens[a.bound[i] : a.bound[i + 1]])
        hit = np.flatnonzero(100 * both >= 75 * (int(a.sizes[i]) + b.sizes - both))
        x = int(a.sigs[i])
        for j in hit:
            y = int(b.sigs[j])
            rx, ry = root(x), root(y)
            if rx != ry:
                parent[rx] = ry
                edges.append((x, y))
    return edges


_GROUPED = pa.schema([("g", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("image", pa.binary())])


def _group(key: tuple, rows: pa.Table) -> pa.Table:
    """One group: its image and the links inside it."""
    raw = rows.column("tokens").to_pylist()
    group = Group(rows.column("sig").to_numpy(), rows.column("n").to_numpy(), np.array([len(x) // 8 for x in raw], np.int64), np.frombuffer(b"".join(raw), "<u8"))
    edges = linked(group, group, True) if len(raw) > 1 else []
    g = key[0].as_py()
    m = len(edges)
    return pa.Table.from_batches([table({"g": [g] * (m + 1), "a": [None, *(x for x, _ in edges)], "b": [None, *(y for _, y in edges)], "image": [group.image()] + [None] * m}, _GROUPED)])


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens, groups = [], []
        for g, prefix, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            x = np.frombuffer(raw, "<i8")[:prefix]
            tokens.append(x)
            groups.append(np.full(len(x), g, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens) if tokens else [], pa.int64()), pa.array(np.concatenate(groups) if groups else [], pa.int64())], names=["token", "g"])


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = [], []
        for x, y in zip(batch.column(0), batch.column(1), strict=True):
            for i, j in linked(Group.read(x.as_py()), Group.read(y.as_py()), False):
                a.append(i)
                b.append(j)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def jaccard_components(spark: SparkSession, docs: DataFrame, per_range: int = 2_000_000) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    Defined results: a null or empty text, or one without words, has no shingles and is its own component;
    repeated rows are linked as equal sets; a null doc_id links like any other and is least only among
    nulls; an empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(spark, "jaccard")
    # the set is that of the text with A-Z in lower case
    docs = docs.select(F.col("doc_id").cast("long"), F.translate("text", _UPPER, _LOWER).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = range_bits(size // 7, per_range)
    blocks = docs.mapInArrow(_blocks(bits), "p int, name long, owners binary, steps binary, places binary")
    shared = blocks.groupBy("p").applyInArrow(_share(bits), _SHARED_DDL)
    shared = scratch.save(shared, "shared", codec="none", by="kind")
    sets = shared.where("kind = 0").select("doc_id", "sig", "n", "owner")
    scratch.settle()
    held = shared.where("kind = 2").select("owner", "owners", "extra", "data").groupBy("owner")
    totals = shared.where("kind = 3").select(F.col("owner").alias("name"), "data").groupBy("name")
    frequent = held.cogroup(totals).applyInArrow(_returned(max(0, bits - 1)), OWNED_DDL)
    listed = shared.where("kind = 1").select(*OWNED.names).unionByName(frequent)
    active = listed.groupBy("bucket").applyInArrow(_order, "owner long, c long, key long, tokens binary")
    active = active.join(sets.select("owner", "sig", "n"), "owner").where("4 * c >= 3 * n").dropDuplicates(["sig"])
    # a set's other shingles are in no other set and come before these
    prefix = F.greatest(F.lit(0), F.col("n") - F.ceil(F.col("n") * 3 / 4) + 1 - (F.col("n") - F.col("c"))).cast("long")
    active = scratch.save(active.select("sig", "n", "key", prefix.alias("prefix"), "tokens"), "active", codec="none")
    for kind in (1, 2, 3):
        scratch.drop(f"shared/kind={kind}")
    scratch.settle()
    parts = active.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(GROUP)).alias("parts"))
    grouped = active.join(parts, "key").withColumn("g", F.xxhash64("key", F.pmod(F.xxhash64("sig"), F.col("parts")))).select("g", "sig", "n", "prefix", "tokens")
    grouped = scratch.save(grouped, "grouped", codec="none")
    scratch.drop("active")
    inside = scratch.save(grouped.groupBy("g").applyInArrow(_group, "g long, a long, b long, image binary"), "groups", codec="none")
    scratch.settle()
    images = inside.where("image is not null").select("g", "image")
    # (shingle, group) once each; how many groups hold a shingle, not how many documents, makes pairs
    listed = scratch.save(grouped.select("g", "prefix", "tokens").mapInArrow(_prefixes, "token long, g long").distinct(), "listed", codec="none")
    edges = inside.where("a is not null").select("a", "b")
    chain = scratch.save(_chain(listed), "chain", codec="none")
    chained = scratch.save(_opened(chain, images), "chained")
    edges = scratch.save(edges.unionByName(chained), "round1")
    ends = components(edges, scratch, label="sets")
    # a group whose sets are all in one component, or else a name of its own
    whole = grouped.select("g", "sig").join(ends.withColumnRenamed("v", "sig"), "sig", "left").select("g", F.coalesce("component", "sig").alias("c"))
    whole = whole.groupBy("g").agg(F.min("c").alias("low"), F.max("c").alias("high"))
    whole = whole.select("g", F.struct((F.col("low") == F.col("high")).alias("one"), F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("g")).alias("name")).alias("c"))
    placed = listed.join(whole, "g")
    several = placed.groupBy("token").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("token")
    lists = placed.join(several, "token").groupBy("token", "c").agg(F.sort_array(F.collect_set("g")).alias("gs"))
    lists = lists.groupBy("token").agg(F.sort_array(F.collect_list(F.struct("c", "gs"))).alias("cs")).select("cs").distinct()
    left = lists.select(F.posexplode("cs").alias("i", "x"), "cs").select("x.gs", F.expr("slice(cs, i + 2, size(cs))").alias("later"))
    pairs = left.select("gs", F.explode("later").alias("y")).select(F.explode("gs").alias("x"), F.col("y.gs").alias("ys")).select("x", F.explode("ys").alias("y"))
    pairs = pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct().join(chain, ["x", "y"], "left_anti")
    edges = edges.unionByName(_opened(pairs, images))
    first = sets.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("times"))
    first = scratch.save(first, "first")
    ends = scratch.save(edges, "links").join(first.select(F.col("sig").alias("a"), F.col("first").alias("fa")), "a").join(first.select(F.col("sig").alias("b"), F.col("first").alias("fb")), "b")
    label = components(ends.select(F.col("fa").alias("a"), F.col("fb").alias("b")), scratch)
    named = first.join(label, first["first"] == label["v"], "left").select("sig", F.coalesce("component", "first").alias("component_id"), "times")
    named = scratch.save(named, "named")
    total = named.agg(F.sum("times")).first()[0] or 0
    out = spread_join(sets.where("n > 0").select("doc_id", "sig", "n"), named, ["sig"], "times", total)
    bare = sets.where("n = 0").select("doc_id", "n", F.lit(None).cast("long").alias("component_id"))
    out = out.select("doc_id", "n", "component_id").unionByName(bare)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _chain(listed: DataFrame) -> DataFrame:
    """Pairs (x, y), x < y, of groups that follow each other in the list of a shingle.

    A list is cut into parts that are chained each, and so are the parts' first ones.
    """
    part = listed.withColumn("part", F.pmod(F.xxhash64("g"), F.lit(_PARTS))).groupBy("token", "part").agg(F.sort_array(F.collect_set("g")).alias("gs"))
    tops = part.groupBy("token").agg(F.sort_array(F.collect_set(F.element_at("gs", 1))).alias("gs"))
    lists = part.select("gs").unionByName(tops.select("gs")).where("size(gs) > 1").distinct()
    return lists.select(F.explode(F.expr("transform(slice(gs, 2, size(gs)), (y, i) -> struct(gs[i] as x, y as y))")).alias("xy")).select("xy.x", "xy.y").distinct()


def _opened(pairs: DataFrame, images: DataFrame) -> DataFrame:
    """Links between the sets of paired groups."""
    return (
        pairs.join(images.select(F.col("g").alias("x"), F.col("image").alias("ix")), "x")
        .join(images.select(F.col("g").alias("y"), F.col("image").alias("iy")), "y")
        .select("ix", "iy")
        .mapInArrow(_open, "a long, b long")
    )


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is the least of its component, with the columns of docs.

    Defined results: a row with a null doc_id stays, for nothing names it among its group; rows that share the
    least doc_id of a group all stay; a text without words is linked with nothing and stays; an empty table gives
    an empty one.  At every size the texts are dealt by doc_id to where the ids to keep are hashed.
    """
    scratch = Scratch(spark, "kept")
    found = jaccard_components(spark, docs).where("doc_id = component_id").select(F.col("doc_id").alias("__id")).distinct()
    found = scratch.save(found, "kept")
    scratch.settle()
    known = docs.where("doc_id is not null").join(found.hint("shuffle_hash"), docs["doc_id"] == found["__id"], "left_semi")
    return known.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Takes a relation "docs" (doc_id, text); makes "components" (doc_id, n_shingles, component_id).
JACCARD_SQL = rf"""
worded as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') as w from docs),
shingled as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
               else list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from worded),
sizes as (select doc_id, len(s)::bigint as n from shingled),
tokens as (select doc_id, unnest(s) as t from shingled),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from tokens a join tokens b on a.t = b.t and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
both_ways as (select a, b from links union all select b, a from links),
reach as (select doc_id as v, doc_id as r from docs union select e.b, r.r from reach r join both_ways e on e.a = r.v),
components as (select s.doc_id, s.n as n_shingles, m.component_id from sizes s join (select v, min(r) as component_id from reach group by 1) m on m.v = s.doc_id)
"""

ORACLE = f"with recursive docs as (select doc_id, text from documents), {JACCARD_SQL} select doc_id, n_shingles, component_id from components"
