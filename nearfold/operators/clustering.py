"""Incremental clustering, statistics and scores.

The assignment takes chunks in order of their ids: a chunk joins the cluster of its nearest neighbour, or starts one with
its neighbours up to the first that has a cluster.  What a chunk does depends on earlier chunks only where they
touch what it touches: itself, and its neighbours up to the first that has a cluster.  So in a round all chunks decide at
once that are the least undecided chunk at everything they touch, as in a greedy matching by priority.  A few rounds
settle most of a graph, however large its components are: copies and stars at once, for they ask for the one member that
they all have nearest.  What is left falls apart into small components, which are folded one after the other in the
partitions that they are dealt to.  A component that is still large goes through further rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import stage
from .graph import connected_components

#: Rounds before what is left is looked at, and the edges of a component that a task may fold.
ROUNDS, FOLD_EDGES = 2, 1_000_000


def fold(rows: list[tuple[int, list[tuple[int, float]]]], member: dict[int, int]) -> list[tuple[int, int, float]]:
    """(cluster, chunk, similarity) that new chunks bring; a new cluster has the id of its canonical chunk.

    rows: new chunks in order of insertion, each with its neighbours, nearest first.  member: cluster of the
    chunks that have one, kept up to date.
    """
    out: list[tuple[int, int, float]] = []

    def put(cluster: int, chunk: int, sim: float) -> None:
        member[chunk] = cluster
        out.append((cluster, chunk, sim))

    for chunk, near in rows:
        if chunk in member:
            continue
        for other, sim in near:
            if other in member:
                if chunk not in member:
                    put(member[other], chunk, sim)
                break
            if chunk not in member:
                put(chunk, chunk, 1.0)
            put(member[chunk], other, sim)
    return out


def assign(near: DataFrame, new_ids: DataFrame, skipped: DataFrame, existing: DataFrame) -> DataFrame:
    """Memberships after the new chunks: existing (cluster_id, chunk_id, similarity) and what is added."""
    return existing.select("cluster_id", "chunk_id", "similarity").unionByName(assign_new(near, new_ids, skipped, existing))


def assign_new(near: DataFrame, new_ids: DataFrame, skipped: DataFrame, existing: DataFrame, rounds: int = ROUNDS, most: int = FOLD_EDGES) -> DataFrame:
    """The memberships (cluster_id, chunk_id, similarity) that new chunks bring.

    near: (a, b, sim) of sim >= threshold without related ranges.  Skip-listed chunks neither start nor join.  rounds, most:
    how often all decide at once before components are looked at, and the edges of a component that is folded in a task.
    """
    gone = skipped.select("id")
    edges = near.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti")
    edges = edges.join(new_ids.select(F.col("id").alias("a")), "a", "left_semi")
    order = W.partitionBy("a").orderBy(F.col("sim").desc(), "b")  # a chunk has few neighbours
    left = edges.select("a", "b", "sim", F.row_number().over(order).alias("pos"), F.lit(None).cast("bigint").alias("cluster"))
    fresh = existing.select("cluster_id", "chunk_id")
    out = existing.select("cluster_id", "chunk_id", F.col("similarity").cast("double").alias("similarity")).limit(0)
    while True:
        for _ in range(rounds):
            seen = stage(_resolved(left, fresh), "seen")
            late = stage(_blocked(seen), "late")
            added = stage(_decided(seen.join(late, "a", "left_anti")), "added")
            out = out.unionByName(added)
            if late.limit(1).count() == 0:
                return out
            left, fresh = seen.join(late, "a", "left_semi"), added.select("cluster_id", "chunk_id")
        seen = stage(_resolved(left, fresh), "seen")
        if seen.limit(1).count() == 0:
            return out
        component = stage(connected_components(seen.where("cluster is null").select("a", "b")), "component")
        placed = seen.join(component, F.col("a") == F.col("v"), "left").select(F.coalesce("component", "a").alias("component"), *seen.columns)
        large = stage(placed.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("component"), "large")
        out = out.unionByName(stage(_folded(placed.join(large, "component", "left_anti")), "added"))
        if large.limit(1).count() == 0:
            return out
        left = placed.join(large, "component", "left_semi").select(*seen.columns)
        fresh, rounds = fresh.limit(0), max(rounds, 1)


def _resolved(edges: DataFrame, fresh: DataFrame) -> DataFrame:
    """Edges (a, b, sim, pos, cluster) of undecided chunks once chunks of `fresh` are members: theirs go, neighbours among
    them get their cluster, and what follows the first neighbour with a cluster goes, for it is never looked at."""
    e = edges.join(fresh.select(F.col("chunk_id").alias("a")), "a", "left_anti")
    e = e.join(fresh.select(F.col("chunk_id").alias("b"), F.col("cluster_id").alias("found")), "b", "left")
    e = e.select("a", "b", "sim", "pos", F.coalesce("cluster", "found").alias("cluster"))
    stop = F.min(F.when(F.col("cluster").isNotNull(), F.col("pos"))).over(W.partitionBy("a"))
    return e.withColumn("stop", stop).where("stop is null or pos <= stop").drop("stop")


def _blocked(seen: DataFrame) -> DataFrame:
    """Chunks (a) that must wait for an earlier one that touches what they touch."""
    touch = seen.where("cluster is null").select(F.col("b").alias("x"), "a").unionByName(seen.where("pos = 1").select(F.col("a").alias("x"), "a"))
    low = touch.groupBy("x").agg(F.min("a").alias("low"))
    return touch.join(low, "x").where("low < a").select("a").distinct()


def _decided(ready: DataFrame) -> DataFrame:
    """Memberships that chunks bring which need not wait."""
    joined = ready.where("pos = 1 and cluster is not null").select(F.col("cluster").alias("cluster_id"), F.col("a").alias("chunk_id"), F.col("sim").alias("similarity"))
    begun = ready.where("pos = 1 and cluster is null").select(F.col("a").alias("cluster_id"), F.col("a").alias("chunk_id"), F.lit(1.0).alias("similarity"))
    taken = ready.where("cluster is null").select(F.col("a").alias("cluster_id"), F.col("b").alias("chunk_id"), F.col("sim").alias("similarity"))
    return joined.unionByName(begun).unionByName(taken)


def _folded(placed: DataFrame) -> DataFrame:
    """Memberships of whole components, dealt to partitions and folded in order there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        member: dict[int, int] = {}
        now, chunk, near, out = None, None, [], []
        for batch in batches:
            for component, a, b, sim, cluster in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if a != chunk:
                    if near:
                        out += fold([(chunk, near)], member)
                    chunk, near = a, []
                if component != now:
                    now, member = component, {}
                if cluster is not None:
                    member[b] = cluster
                near.append((b, sim))
            if len(out) > 50_000:
                yield _memberships(out)
                out = []
        if near:
            out += fold([(chunk, near)], member)
        yield _memberships(out)

    dealt = placed.repartition("component").sortWithinPartitions("component", "a", "pos")
    return dealt.select("component", "a", "b", "sim", "cluster").mapInArrow(run, "cluster_id bigint, chunk_id bigint, similarity double")


def _memberships(rows: list[tuple[int, int, float]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["cluster_id", "chunk_id", "similarity"])


def statistics(members: DataFrame) -> DataFrame:
    """(cluster_id, size, avg_similarity, max_similarity)."""
    return members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"), F.avg("similarity").alias("avg_similarity"), F.max("similarity").alias("max_similarity"))


def small_clusters(clusters: DataFrame, members: DataFrame, least: int = 2) -> DataFrame:
    """Ids of clusters with fewer than `least` members, none counted as 0."""
    x = clusters.select("cluster_id").join(members.select("cluster_id", "chunk_id"), "cluster_id", "left")
    return x.groupBy("cluster_id").agg(F.count("chunk_id").alias("n")).where(F.col("n") < least).select("cluster_id")


def drop_small(clusters: DataFrame, members: DataFrame, least: int = 2) -> tuple[DataFrame, DataFrame]:
    gone = small_clusters(clusters, members, least)
    return clusters.join(gone, "cluster_id", "left_anti"), members.join(gone, "cluster_id", "left_anti")


def cascade_delete(clusters: DataFrame, members: DataFrame, chunk_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clusters and memberships once chunks are gone: a cluster goes with its canonical chunk."""
    gone = chunk_ids.select("id").distinct()
    left = clusters.join(gone, clusters["canonical_chunk_id"] == gone["id"], "left_anti")
    kept = members.join(gone, members["chunk_id"] == gone["id"], "left_anti").join(left.select("cluster_id"), "cluster_id", "left_semi")
    return left, kept


def cascade_drops(clusters: DataFrame, members: DataFrame, chunk_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What goes with chunks: (cluster_id) of clusters whose canonical chunk goes, (chunk_id) of memberships."""
    gone = chunk_ids.select("id").distinct()
    heads = clusters.join(gone, clusters["canonical_chunk_id"] == gone["id"], "left_semi").select("cluster_id")
    own = members.join(gone, members["chunk_id"] == gone["id"], "left_semi").select("chunk_id")
    return heads, own.unionByName(members.join(heads, "cluster_id", "left_semi").select("chunk_id")).distinct()


def total_lines(start, end):
    return end - start + 1


def score(strategy: str, code_bytes, lines, size, avg_similarity):
    """old: bytes of the canonical code; impact: lines of all members; anything else: weighed lines."""
    if strategy == "old":
        return code_bytes.cast("double")
    if strategy == "impact":
        return lines.cast("double")
    return lines * avg_similarity * (1 + F.when(size > 1, F.log2(size)).otherwise(F.lit(0.0)))


def by_size(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """Clusters with their statistics, largest first, then by id."""
    return clusters.join(statistics(members), "cluster_id").orderBy(F.col("size").desc(), "cluster_id")


def places(sized: DataFrame) -> DataFrame:
    """(cluster_id, size, place) of (cluster_id, size), largest first, then by id.

    Clusters of a size are numbered by ranges of their ids, and the counts of sizes and ranges, which are few, say what
    comes before; no task sees all clusters.
    """
    dealt = stage(sized.repartitionByRange(F.col("size").desc(), F.col("cluster_id")).sortWithinPartitions(F.col("size").desc(), F.col("cluster_id")).withColumn("at", F.monotonically_increasing_id()), "places")
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = dealt.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # a row a partition
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("part", before.alias("before"))
    return dealt.withColumn("part", part).join(F.broadcast(starts), "part").select("cluster_id", "size", (row + F.col("before") + 1).alias("place"))


def summaries(clusters: DataFrame, members: DataFrame, chunks: DataFrame, strategy: str = "default") -> DataFrame:
    """Clusters with canonical chunk, statistics and score.  No code but the canonical chunk's is moved."""
    place = members.join(chunks.select(F.col("id").alias("chunk_id"), "start_line", "end_line"), "chunk_id")
    stats = place.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("size"),
        F.avg("similarity").alias("avg_similarity"),
        F.max("similarity").alias("max_similarity"),
        F.sum(total_lines(F.col("start_line"), F.col("end_line"))).alias("total_lines"),
    )
    canon = chunks.select(F.col("id").alias("canonical_chunk_id"), F.struct(F.col("id").alias("chunk_id"), "path", "language", "start_line", "end_line", "code", "sha").alias("canonical"))
    x = clusters.select("cluster_id", "canonical_chunk_id").join(stats, "cluster_id").join(canon, "canonical_chunk_id")
    s = score(strategy, F.octet_length("canonical.code"), F.col("total_lines"), F.col("size"), F.col("avg_similarity"))
    return x.withColumn("score", s).withColumn("sha", F.col("canonical.sha")).select("cluster_id", "sha", "canonical", "size", "avg_similarity", "max_similarity", "total_lines", "score")


def with_members(summed: DataFrame, members: DataFrame, chunks: DataFrame) -> DataFrame:
    """The given clusters with their member chunks, nearest first, then by id.

    A cluster's members with their code make one row, which is what a report shows of it.
    """
    own = members.join(summed.select("cluster_id"), "cluster_id", "left_semi")
    place = chunks.select(F.col("id").alias("chunk_id"), "path", "language", "start_line", "end_line", "code", "sha")
    item = F.struct((-F.col("similarity")).alias("o"), "chunk_id", "path", "language", "start_line", "end_line", "code", "sha", "similarity")
    lists = own.join(place, "chunk_id").groupBy("cluster_id").agg(F.sort_array(F.collect_list(item)).alias("chunks"))
    return summed.join(lists, "cluster_id").select("cluster_id", "sha", "canonical", "chunks", "size", "avg_similarity", "max_similarity", "total_lines", "score")


def load_clusters(clusters: DataFrame, members: DataFrame, chunks: DataFrame, strategy: str = "default") -> DataFrame:
    """All clusters with canonical chunk, members, statistics and score."""
    return with_members(summaries(clusters, members, chunks, strategy), members, chunks)


def ranked(loaded: DataFrame, limit: int = 10) -> DataFrame:
    """Best score first, then by id; 0 is no limit."""
    x = loaded.orderBy(F.col("score").desc(), "cluster_id")
    return x.limit(limit) if limit > 0 else x
