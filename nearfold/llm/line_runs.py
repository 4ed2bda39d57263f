"""Line deduplication over levelled sorted runs of line hashes.

A line's key is the line without white space at both ends, A-Z in lower case.  A run is a table of
(hi, lo, n_docs, keep): the 128-bit hash of a key, in how many documents it was found, and the largest
doc_id that holds it, in buckets of the hash, sorted in each.  Runs live in levels, in a folder that can
outlive the call.  Each batch of documents is sorted into buckets and merged against the runs, bucket by
bucket: an anti-join leaves the keys never seen, which join level 0 as a run of their own; what the batch
adds to keys of earlier runs is a run beside them.  When a level holds `fanout` runs, they are merged into
one run of the next level, so a key is rewritten once per level and a batch meets few runs.  Runs are never
shuffled again: joins and merges read them by bucket.

Keys of at least `min_chars` code points found in at least `min_docs` documents lose all their lines except
in the largest doc_id that holds them.

Defined results: a null or empty text has one empty line and stays as it is; a row is a document, so
repeated rows count each, and rows sharing the largest doc_id all keep the line; a row with a null doc_id
neither counts nor changes; an empty table gives an empty one; other columns pass through.  With a folder
of runs of earlier calls, their documents count and may hold the line that stays; they aren't rewritten.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import Manifest, hadoop
from .scratch import Scratch
from .skew import spread_join
from .words import SPACES

MIN_CHARS = 20
MIN_DOCS = 3
#: Documents come in batches of about so many lines, in so many batches at least and at most.
BATCH_LINES = 20_000_000
LEAST_BATCHES, MOST_BATCHES = 4, 64
FANOUT = 3


def line_key(line: bytes) -> bytes:
    return line.strip(SPACES).lower()  # bytes.lower() is A-Z only


def _counts(key: bytes, least: int) -> bool:
    """Whether a key has at least so many code points."""
    n = len(key)
    return n >= least and (n >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def _texts(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()


def _keys(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                at: list[int] = []
                digests: list[bytes] = []
                for i, text in enumerate(_texts(part.column(1))):
                    if not text:
                        continue
                    own = {xxhash.xxh3_128_digest(key) for line in text.split(b"\n") if _counts(key := line_key(line), least)}
                    digests += own
                    at += [i] * len(own)
                pair = np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())], names=["doc_id", "hi", "lo"])

    return run


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, hi, lo) of the distinct keys of each row."""
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(_keys(min_chars), "doc_id long, hi long, lo long")


_KEY = ["hi", "lo"]
_RUN = "hi bigint, lo bigint, n_docs bigint, keep bigint"


class LineRuns:
    """Runs in the levels of a folder.  A key is in one run of `levels` only; what later batches add to it is in
    `again`, levelled alike.

    The folder's manifest names what is valid; a newer one takes its place when a batch is through, so a batch that
    failed has left nothing but files that no manifest names.
    """

    def __init__(self, spark: SparkSession, folder: str, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.folder, self.fanout = spark, folder.rstrip("/"), fanout
        self.manifest = Manifest(spark, self.folder)
        self.version, known = self.manifest.read()
        # as many as a shuffle makes, so that a batch is dealt out as the runs are
        self.buckets: int = known.get("buckets") or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = known.get("levels", [])
        self.again: list[list[str]] = known.get("again", [])
        self.batches: list[str] = known.get("batches", [])
        self._open: dict[str, DataFrame] = {}

    def _commit(self, gone: list[str]) -> None:
        """Name what is valid now; then remove what no longer is."""
        self.version += 1
        self.manifest.write(self.version, {"buckets": self.buckets, "levels": self.levels, "again": self.again, "batches": self.batches})
        for name in gone:
            self._open.pop(name, None)
            path, fs = hadoop(self.spark, f"{self.folder}/{name}")
            fs.delete(path, True)

    def run(self, name: str) -> DataFrame:
        """A run, read by bucket."""
        if name not in self._open:
            table = f"nearfold_run_{uuid.uuid4().hex}"
            self.spark.sql(f"create table {table} ({_RUN}) using parquet clustered by (hi, lo) sorted by (hi, lo) into {self.buckets} buckets location '{self.folder}/{name}'")
            self._open[name] = self.spark.table(table)
            self.spark.sql(f"drop table {table}")  # the files stay, and the plan knows their buckets
        return self._open[name]

    def _save(self, df: DataFrame) -> str:
        name = f"run-{uuid.uuid4().hex}"
        table = f"nearfold_{name.replace('-', '_')}"
        writer = df.select("hi", "lo", "n_docs", "keep").write.bucketBy(self.buckets, *_KEY).sortBy(*_KEY).option("compression", "none")
        writer.option("path", f"{self.folder}/{name}").saveAsTable(table)
        self.spark.sql(f"drop table {table}")
        return name

    def runs(self) -> list[str]:
        return [x for level in self.levels for x in level]

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows of keys whose (hi, lo) no run holds."""
        return reduce(lambda df, name: df.join(self.run(name).select(*_KEY).hint("merge"), _KEY, "left_anti"), self.runs(), keys)

    def add(self, lines: DataFrame, label: str | None = None) -> None:
        """Merge one batch of (doc_id, hi, lo) into the levels; a label that came before is not merged again."""
        if label is not None and label in self.batches:
            return
        batch = self._save(lines.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keep")))
        gone: list[str] = []
        if self.runs():
            fresh = self._save(self.unseen(self.run(batch)))
            gone.append(batch)
            more = self._save(self.run(batch).join(self.run(fresh).select(*_KEY).hint("merge"), _KEY, "left_anti"))
            self.again = [[*(self.again[0] if self.again else []), more], *self.again[1:]]
        else:
            fresh = batch
        self.levels = [[*(self.levels[0] if self.levels else []), fresh], *self.levels[1:]]
        for levels in (self.levels, self.again):
            k = 0
            while k < len(levels):
                if len(levels[k]) >= self.fanout:
                    full, levels[k] = levels[k], []
                    if k + 1 == len(levels):
                        levels.append([])
                    one = full[0]
                    for other in full[1:]:
                        gone += one, other
                        one = self._save(self.merged(one, other))
                    levels[k + 1].append(one)
                k += 1
        if label is not None:
            self.batches.append(label)
        self._commit(gone)

    def merged(self, one: str, other: str) -> DataFrame:
        """The keys of two runs, bucket by bucket."""
        a, b = self.run(one), self.run(other).toDF(*_KEY, "n_more", "keep_more")
        n = F.coalesce("n_docs", F.lit(0)) + F.coalesce("n_more", F.lit(0))
        return a.join(b.hint("merge"), _KEY, "full").select(*_KEY, n.alias("n_docs"), F.greatest("keep", "keep_more").alias("keep"))

    def table(self) -> DataFrame:
        """All keys, each once, with all that was counted."""
        found = []
        for name in self.runs():  # their keys differ
            df = self.run(name)
            for more in (x for level in self.again for x in level):
                also = self.run(more).toDF(*_KEY, "n_more", "keep_more").hint("merge")
                n = F.col("n_docs") + F.coalesce("n_more", F.lit(0))
                df = df.join(also, _KEY, "left").select(*_KEY, n.alias("n_docs"), F.greatest("keep", "keep_more").alias("keep"))
            found.append(df)
        return reduce(DataFrame.unionByName, found) if found else self.spark.createDataFrame([], _RUN)


def _rewrite(width: int, text_at: int, count_at: int):
    """Drop lines whose hashes are listed in the last column; append n_lines, n_dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                texts = _texts(part.column(text_at))
                lists = part.column(width)
                out: list[bytes | None] = []
                total: list[int] = []
                dropped: list[int] = []
                for i, text in enumerate(texts):
                    drop = lists[i].as_py() if lists[i].is_valid else None
                    total.append(1 + (text or b"").count(b"\n"))
                    if not drop or text is None:
                        out.append(text)
                        dropped.append(0)
                        continue
                    raw = np.array([(d["hi"], d["lo"]) for d in drop], ">i8").tobytes()
                    gone = {raw[j : j + 16] for j in range(0, len(raw), 16)}
                    kept = [line for line in text.split(b"\n") if xxhash.xxh3_128_digest(line_key(line)) not in gone]
                    dropped.append(total[-1] - len(kept))
                    out.append(b"\n".join(kept))
                columns = [part.column(j) for j in range(width)]
                columns[text_at] = pa.array(out, pa.binary()).cast(pa.string())
                if count_at >= 0:
                    columns[count_at] = pc.if_else(pc.is_null(columns[text_at]), columns[count_at].cast(pa.int64()), pc.utf8_length(columns[text_at]).cast(pa.int64()))
                yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(dropped, pa.int64())], names=[f"c{j}" for j in range(width + 2)])

    return run


def dedup_lines(spark: SparkSession, docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int | None = None, store: str | None = None, label: str | None = None) -> DataFrame:
    """docs with the repeated lines gone and n_chars, where there is one, counted anew; adds n_lines and n_dropped.

    Columns of docs of those two names give way to the new ones.  store: a folder of runs that stays, for documents
    that come later; label names this call there, so that a repeated call doesn't count its documents twice.
    """
    scratch = Scratch(spark, "lines")
    docs = docs.drop("n_lines", "n_dropped")
    lines = scratch.save(line_hashes(docs, min_chars), "lines", codec="none")
    runs = LineRuns(spark, store or f"{scratch.path}/runs")
    if batches is None:
        batches = min(MOST_BATCHES, max(LEAST_BATCHES, lines.count() // BATCH_LINES))
    # later documents first, in batches of about as many rows
    cuts = lines.select(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000)).first()[0] or [] if batches > 1 else []
    edges = [None, *sorted(set(cuts)), None]
    for k, (low, high) in enumerate(reversed(list(zip(edges[:-1], edges[1:], strict=True)))):
        batch = lines
        if low is not None:
            batch = batch.where(F.col("doc_id") > low)
        if high is not None:
            batch = batch.where(F.col("doc_id") <= high)
        runs.add(batch, None if label is None else f"{label}/{k}")
    hot = scratch.save(runs.table().where(F.col("n_docs") >= min_docs), "hot", codec="none")
    total = hot.agg(F.sum("n_docs")).first()[0] or 0
    drops = spread_join(lines, hot, _KEY, "n_docs", total, "inner").where("doc_id < keep")
    drops = drops.groupBy("doc_id").agg(F.collect_set(F.struct("hi", "lo")).alias("__drop")).withColumnRenamed("doc_id", "__id")
    drops = scratch.save(drops, "drops", codec="none")
    joined = docs.join(drops, docs["doc_id"] == drops["__id"], "left").drop("__id")
    names = docs.columns
    schema = T.StructType([
        *(T.StructField(f"c{j}", T.LongType() if f.name == "n_chars" else f.dataType) for j, f in enumerate(docs.schema.fields)),
        T.StructField(f"c{len(names)}", T.LongType()),
        T.StructField(f"c{len(names) + 1}", T.LongType()),
    ])
    count_at = names.index("n_chars") if "n_chars" in names else -1
    return joined.mapInArrow(_rewrite(len(names), names.index("text"), count_at), schema).toDF(*names, "n_lines", "n_dropped")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(spark, docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Takes a relation "docs" (doc_id, text); makes "deduped" (doc_id, n_lines, n_dropped, kept).
LINES_SQL = f"""
lined as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from docs),
keyed as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') as key from lined),
held as (select key, max(doc_id) as keep from keyed where length(key) >= {MIN_CHARS} group by 1 having count(distinct doc_id) >= {MIN_DOCS}),
marked as (select k.doc_id, k.pos, k.line, h.keep is not null and k.doc_id <> h.keep as gone from keyed k left join held h using (key)),
deduped as (select doc_id, count(*)::bigint as n_lines, coalesce(sum(gone::int), 0)::bigint as n_dropped,
                   coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '') as kept from marked group by 1)
"""

ORACLE = f"with docs as (select doc_id, text from documents), {LINES_SQL} select doc_id, n_lines, n_dropped, sha256(kept) as kept_sha256 from deduped"
