"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Every document of a source expects target / source_size copies.  The documents of a source are put in
order of size; the prefix sum of expected copies plus one offset per source is cut at the integers, and
a document is emitted once for each integer that its interval crosses.  Order by size keeps the taken
words of a source within about one document of its target.

The prefix sum is taken in blocks of (source, size, salt), so that a source with a third of all rows is
spread over as many tasks as it has sizes and salts: no window holds a whole source's rows.

Defined results: a null text has size 0; a null source is a source of its own, last in order; an empty
table gives no rows; a source whose texts hold no words has target 0 and taken 0; repeated rows count
each for itself; other columns are ignored.  A null doc_id is kept and salted as 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import WORD

WEIGHTS = (3, 1, 2)
SALTS = 64
SEED = "mix-1"


def _unit(*cols):
    """A number in [0, 1) from the md5 of its arguments; other engines can follow it."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, share=(3, 2), cap: int = 2) -> DataFrame:
    """A row per source: source_key, source_size, target.

    share is the fraction of all words to take.  Targets follow the weights; one that would pass cap
    times its source's size stops there, and the rest is shared again by weight.  With sources in order of
    size / weight the capped ones are a prefix, so one prefix sum gives the final level.
    """
    totals = sized.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    # rows from here on are sources, each once
    ranked = totals.withColumn("rank", F.row_number().over(W.orderBy("source_key")) - 1)
    wt = F.element_at(F.array(*[F.lit(int(x)).cast("long") for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", wt)
    order = W.orderBy(F.col("source_size") / F.col("weight"), "source_key")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(F.lit(1))
    num, den = share
    x = (
        ranked.withColumn("k", F.row_number().over(order))
        .withColumn("capped", F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0)))
        .withColumn("open_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("rest", F.sum("source_size").over(everything) * num - F.col("capped") * den)
        # the level if all before this one are capped fits if this one's share isn't above its cap
        .withColumn("fits", F.col("rest") * F.col("weight") <= F.col("source_size") * (cap * den) * F.col("open_weight"))
        .withColumn("at", F.min(F.when(F.col("fits"), F.col("k"))).over(everything))
        .withColumn("rest_at", F.max(F.when(F.col("k") == F.col("at"), F.col("rest"))).over(everything))
        .withColumn("weight_at", F.max(F.when(F.col("k") == F.col("at"), F.col("open_weight"))).over(everything))
    )
    level = (F.col("rest_at") * F.col("weight")).cast("double") / (F.col("weight_at") * den).cast("double")
    target = F.when(F.col("at").isNull() | (F.col("k") < F.col("at")), (F.col("source_size") * cap).cast("double")).otherwise(level)
    return x.select("source_key", "source_size", target.alias("target"))


def systematic_copies(sized: DataFrame, targets: DataFrame, cap: int = 2, seed: str = SEED, salts: int = SALTS) -> DataFrame:
    """Adds source_size, target, copies to rows of (doc_id, source_key, size)."""
    salt = F.coalesce(F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 4), 16, 10).cast("long"), F.lit(0)) % salts
    salted = sized.withColumn("salt", salt)
    blocks = salted.groupBy("source_key", "size", "salt").agg(F.count(F.lit(1)).alias("n"))
    sizes = blocks.groupBy("source_key", "size").agg(F.sum("n").alias("n_size"))
    by_size = W.partitionBy("source_key").orderBy("size").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("before_size", F.coalesce(F.sum("n_size").over(by_size), F.lit(0))).drop("n_size").join(targets, "source_key")
    by_salt = W.partitionBy("source_key", "size").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    starts = blocks.withColumn("before_salt", F.coalesce(F.sum("n").over(by_salt), F.lit(0))).drop("n").join(sizes, ["source_key", "size"])
    rows = salted.withColumn("place", F.row_number().over(W.partitionBy("source_key", "size", "salt").orderBy("doc_id")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    k = F.col("before_size") + F.col("before_salt") + F.col("place")
    u = _unit(F.lit(seed), F.col("source_key"))
    crossed = F.floor(k * rate + u) - F.floor((k - 1) * rate + u)
    # rounding of a long prefix can cross one integer too many; the rate itself bounds what a document expects
    return rows.join(starts, ["source_key", "size", "salt"]).withColumn("copies", F.least(crossed, F.lit(cap)).cast("long"))


def sized_rows(docs: DataFrame) -> DataFrame:
    """doc_id, source_key (null sorts last), size in words."""
    key = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))
    return docs.select("doc_id", key.alias("source_key"), word_count(F.col("text")).alias("size"))


def mix_sources(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken for every document."""
    sized = Scratch(spark, "mix").save(sized_rows(docs), "sized")
    out = systematic_copies(sized, source_targets(sized))
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def emit_copies(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The mix itself: each row of docs as many times as it was drawn, with the columns of docs.

    Rows that share a doc_id are drawn together under one count, the largest of theirs, so a doc_id should name one
    row; rows with a null doc_id are drawn so too.  Other columns pass through; an empty table gives an empty one.
    At every size the texts are dealt by doc_id to where the counts are hashed.
    """
    drawn = mix_sources(spark, docs).groupBy("doc_id").agg(F.max("copies").alias("__copies"))
    drawn = drawn.select(F.col("doc_id").alias("__id"), "__copies").where("__copies > 0")
    drawn = Scratch(spark, "drawn").save(drawn, "drawn")
    times = docs.join(drawn.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(drawn["__id"]), "inner")
    return times.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__copy")).select(*docs.columns)


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_sources(spark, docs).select("doc_id", "size", "source_size", "target", "taken")


#: Takes a relation "docs" (doc_id, text, source).
MIX_SQL = r"""
sized as (select doc_id, case when source is null then '1' else '0' || source end as source_key,
                 coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from docs),
totals as (select source_key, sum(size)::bigint as source_size from sized group by 1),
ranked as (select *, [3, 1, 2][((row_number() over (order by source_key) - 1) % 3 + 1)::int]::bigint as weight from totals),
stepped as (select *, row_number() over w as k,
                   coalesce(sum(source_size * 2) over (w rows between unbounded preceding and 1 preceding), 0)::bigint as capped,
                   sum(weight) over () - coalesce(sum(weight) over (w rows between unbounded preceding and 1 preceding), 0) as open_weight
            from ranked window w as (order by source_size::double / weight, source_key)),
rest as (select *, (sum(source_size) over () * 3 - capped * 2)::bigint as rest from stepped),
fit as (select *, min(case when rest * weight <= source_size * 4 * open_weight then k end) over () as stop from rest),
lev as (select *, max(case when k = stop then rest end) over () as rest_at, max(case when k = stop then open_weight end) over () as weight_at from fit),
targets as (select source_key, source_size,
                   case when stop is null or k < stop then (source_size * 2)::double
                        else (rest_at * weight)::double / (weight_at * 2)::double end as target from lev),
placed as (select s.doc_id, s.source_key, s.size, t.source_size, t.target,
                  row_number() over (partition by s.source_key order by s.size,
                      coalesce(('0x' || substr(md5(s.doc_id::varchar), 1, 4))::bigint, 0) % 64, s.doc_id) as k,
                  case when t.source_size > 0 then t.target / t.source_size else 0 end as rate,
                  ('0x' || substr(md5('mix-1|' || s.source_key), 1, 8))::bigint::double / 4294967296.0::double as u
           from sized s join targets t using (source_key)),
mixed as (select doc_id, size, source_size, target,
                 least(floor(k * rate + u) - floor((k - 1) * rate + u), 2)::bigint as copies from placed)
"""

ORACLE = f"with docs as (select doc_id, text, source from documents), {MIX_SQL} select doc_id, size, source_size, target, copies * size as taken from mixed"
