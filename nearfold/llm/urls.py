"""URL filters: rules of hosts and paths, and for the rest gradient-boosted trees on lexical features.

Features are lengths, depth, shares of digits and signs, entropy, counts of parameters, and statistics of the host's
suffixes.  The trees are Spark's; features, rules and scores are column functions, so no URL leaves the JVM.  The
trees are fitted on a sample of labelled URLs whose size is a parameter; everything else covers all rows.

Where no labelled URLs are given, `seed_labels` makes them of the table itself: a host in which one of SEEDS stands as a
word of its own is to be blocked, other hosts are not.  The trees never see the words, so what they learn is how such
hosts look, and hosts of names that the seeds don't know are judged by that.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch

#: Words of hosts that sell, bet, advertise or show what a training corpus has no use for.
SEEDS = "adult ads advert bet bets betting casino cheap escort loan loans lottery pills poker porn sex slots spam viagra xxx".split()

#: Labelled URLs that the trees are fitted on: at most so many of each label, those of least hash.
MOST_LABELLED = 10_000
MOST_RULES = 1000
TREES, DEPTH, BINS, STEP, RANDOM = 20, 4, 32, 0.2, 13
FOLDS = 5
#: Rows that the prior counts as in a suffix's share of blocked URLs.
PRIOR_ROWS = 20
CUT = 0.5

Rule = tuple[str, str]  # allow or block; the host with the path, as com/ or example.com/en/

#: The rules of the query.
RULES: list[Rule] = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# ---------------------------------------------------------------- parts


def host_of(url: Column) -> Column:
    """What stands after the first :// up to /, ?, # or the end, A-Z in lower case; "" where there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and all that is left of it as labels go from the left: a.b.c, b.c, c."""
    labels = F.split(host, r"\.", -1)
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(labels, k, n - k + 1), "."))


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """(rule, verdict) of the longest rule that fits; null if none does.

    A rule fits its host and all hosts below it if the path begins with the rule's.  Of rules of one length the one of
    the longer host counts; a rule that is there twice counts as its last.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    by_host: dict[str, dict[str, tuple[str, str]]] = {}
    for verdict, text in rules:
        name, slash, rest = text.partition("/")
        if verdict not in ("allow", "block") or not name:
            raise ValueError(f"no rule: {verdict} {text}")
        by_host.setdefault(name, {})[slash + rest] = (text, verdict)
    if not by_host:
        return F.lit(None).cast("struct<rule:string,verdict:string>")

    def listed(paths: dict[str, tuple[str, str]]) -> Column:
        return F.array(*[F.struct(F.lit(len(t)).alias("size"), F.lit(len(t) - len(p)).alias("host"), F.lit(p).alias("path"), F.lit(t).alias("rule"), F.lit(v).alias("verdict")) for p, (t, v) in paths.items()])

    table = F.create_map(*[x for name, paths in by_host.items() for x in (F.lit(name), listed(paths))])
    found = F.flatten(F.filter(F.transform(suffixes(host), lambda s: F.try_element_at(table, s)), lambda x: x.isNotNull()))
    best = F.array_max(F.filter(found, lambda x: F.startswith(path, x["path"])))
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


# ---------------------------------------------------------------- features


def entropy(text: Column) -> Column:
    """Bits a character of a text, from the runs of its characters in order; 0 for an empty one."""
    chars = F.array_sort(F.filter(F.split(text, "", -1), lambda c: c != ""))
    n = F.size(chars).cast("double")

    def add(total: Column, count: Column) -> Column:
        return F.when(count > 0, total + count * F.log2(count)).otherwise(total)

    def step(s: Column, c: Column) -> Column:
        same = s["last"] == c
        return F.struct(
            c.alias("last"),
            F.when(same, s["count"] + 1).otherwise(F.lit(1.0)).alias("count"),
            F.when(same, s["total"]).otherwise(add(s["total"], s["count"])).alias("total"),
        )

    begin = F.struct(F.lit("").alias("last"), F.lit(0.0).alias("count"), F.lit(0.0).alias("total"))
    bits = F.aggregate(chars, begin, step, lambda s: add(s["total"], s["count"]))
    return F.when(n > 0, F.log2(n) - bits / n).otherwise(0.0)


def _share(text: Column, others: str) -> Column:
    """The share of a text's characters that aren't of the class `others`."""
    n = F.length(text)
    return F.when(n > 0, F.length(F.regexp_replace(text, others, "")) / n).otherwise(0.0)


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Features of a URL by name, none of them a word of it."""
    url = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(url, r"^(?s:[^?#]*)\?([^#]*)", 1)
    labels = F.split(host, r"\.", -1)
    segments = F.filter(F.split(path, "/", -1), lambda s: s != "")
    return {
        "url_length": F.length(url),
        "host_length": F.length(host),
        "path_length": F.length(path),
        "query_length": F.length(query),
        "depth": F.size(segments),
        "host_labels": F.size(labels),
        "longest_label": F.array_max(F.transform(labels, F.length)),
        "longest_segment": F.coalesce(F.array_max(F.transform(segments, F.length)), F.lit(0)),
        "parameters": F.size(F.filter(F.split(query, "&", -1), lambda s: s != "")),
        "digits": _share(url, "[^0-9]"),
        "host_digits": _share(host, "[^0-9]"),
        "host_signs": _share(host, "[a-z0-9.]"),
        "host_vowels": _share(host, "[^aeiou]"),
        "escapes": F.length(F.regexp_replace(url, r"[^%]", "")),
        "host_entropy": entropy(host),
        "path_entropy": entropy(path),
        "secure": F.startswith(url, F.lit("https:")).cast("int"),
        "fragment": F.contains(url, F.lit("#")).cast("int"),
    }


#: Statistics of suffixes of one and two labels: rows of the sample that have it, and how many of them are blocked.
_STATISTICS = ("rows_1", "share_1", "rows_2", "share_2")


def _suffix(host: Column, k: int) -> Column:
    return F.substring_index(host, ".", -k)


def _share_of(bad: Column, rows: Column, prior: float) -> Column:
    return (bad + F.lit(PRIOR_ROWS * prior)) / (rows + F.lit(float(PRIOR_ROWS)))


class UrlFilter:
    """Trees, the suffix statistics that belong to them, and the rules that go before."""

    def __init__(self, model: GBTClassificationModel, suffix_rows: DataFrame, prior: float, rules: Sequence[Rule], names: list[str]):
        self.model, self.suffix_rows, self.prior, self.rules, self.names = model, suffix_rows, prior, list(rules), names

    def judge(self, pages: DataFrame) -> DataFrame:
        """pages with host, path, rule, score (of blocking) and verdict.

        Defined results: a null url, and one without ://, has an empty host and path, and no rule fits it; with an empty
        host there is nothing to judge, so it is allowed, with score 0.  Columns of pages with one of the new names give way;
        repeated rows are judged alike; an empty table gives no rows; a URL is judged whole, whatever its length.
        """
        made = ("host", "path", "rule", "score", "verdict")
        pages = pages.drop(*made)
        x = pages.select(F.struct(*pages.columns).alias("row"), F.col("url").alias("u"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
        x = x.withColumn("fits", rule_for(F.col("host"), F.col("path"), self.rules))
        x = x.select("*", *[c.cast("double").alias(f"f_{k}") for k, c in lexical(F.col("u"), F.col("host"), F.col("path")).items()])
        for k in (1, 2):  # at most two rows a labelled URL, so MOST_LABELLED bounds the broadcast
            known = self.suffix_rows.where(F.col("labels") == k).select(F.col("suffix").alias(f"s{k}"), F.col("rows").alias(f"r{k}"), F.col("bad").alias(f"b{k}"))
            x = x.withColumn(f"s{k}", _suffix(F.col("host"), k)).join(F.broadcast(known), f"s{k}", "left")
            rows, bad = F.coalesce(f"r{k}", F.lit(0)), F.coalesce(f"b{k}", F.lit(0))
            x = x.withColumn(f"f_rows_{k}", F.log1p(rows)).withColumn(f"f_share_{k}", _share_of(bad, rows, self.prior))
        x = self.model.transform(_assembled(x.select("row", "host", "path", "fits", *[f"f_{n}" for n in self.names]), self.names))
        score = F.when(F.col("host") == "", 0.0).otherwise(vector_to_array("probability")[1])
        x = x.select("row.*", "host", "path", F.col("fits.rule").alias("rule"), score.alias("score"), F.col("fits.verdict").alias("v"))
        return x.withColumn("verdict", F.coalesce("v", F.when(F.col("score") >= CUT, "block").otherwise("allow"))).drop("v")


def _assembled(x: DataFrame, names: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=[f"f_{n}" for n in names], outputCol="features").transform(x)


def seed_labels(pages: DataFrame, seeds: Sequence[str] = SEEDS) -> DataFrame:
    """(url, label): 1 where a word of the host, parted by signs, is a seed, else 0; rows without a host have no label."""
    host = host_of(F.col("url"))
    words = F.split(host, r"[^a-z0-9]+", -1)
    return pages.select("url", host.alias("host"), F.arrays_overlap(words, F.array(*[F.lit(s) for s in seeds])).cast("int").alias("label")).where("host <> ''").select("url", "label")


def train(labelled: DataFrame, rules: Sequence[Rule] = (), most: int = MOST_LABELLED) -> UrlFilter:
    """A filter fitted on labelled URLs (url, label 0 or 1; 1 is to be blocked).

    Of each label at most `most` URLs take part, those of least hash, so that reruns agree.  A URL's own suffix statistics
    come from the hosts of other folds, as those of a new host will.  With labels of one kind alone, or none, the trees
    give that kind (allow, for none).
    """
    spark = labelled.sparkSession
    url = labelled.where("url is not null and label is not null").select("url", F.col("label").cast("int").alias("label")).distinct()
    order = (F.xxhash64("url"), "url")
    parts = [url.where(F.col("label") == k).orderBy(*order).limit(most) for k in (0, 1)]
    host = host_of(F.col("url"))
    sample = reduce(DataFrame.unionByName, parts).withColumn("host", host).withColumn("path", path_of(F.col("url"))).withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(FOLDS)))
    scratch = Scratch(spark, "urls")
    sample = scratch.save(sample.coalesce(1), "sample")  # 2 * most rows
    count = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    prior = count.get(1, 0) / max(1, sum(count.values()))
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("labels"), _suffix(F.col("host"), k).alias("suffix")) for k in (1, 2)]))
    per_fold = scratch.save(sample.select("fold", "label", pairs.alias("p")).groupBy("p.labels", "p.suffix", "fold").agg(F.count(F.lit(1)).alias("rows"), F.sum("label").alias("bad")).coalesce(1), "folds")
    suffix_rows = scratch.save(per_fold.groupBy("labels", "suffix").agg(F.sum("rows").alias("rows"), F.sum("bad").alias("bad")).coalesce(1), "suffixes")
    x = sample.select("*", *[c.cast("double").alias(f"f_{k}") for k, c in lexical(F.col("url"), F.col("host"), F.col("path")).items()])
    for k in (1, 2):
        total = suffix_rows.where(F.col("labels") == k).select(F.col("suffix").alias(f"s{k}"), F.col("rows").alias("r"), F.col("bad").alias("b"))
        own = per_fold.where(F.col("labels") == k).select(F.col("suffix").alias(f"s{k}"), "fold", F.col("rows").alias("ro"), F.col("bad").alias("bo"))
        x = x.withColumn(f"s{k}", _suffix(F.col("host"), k)).join(total, f"s{k}").join(own, [f"s{k}", "fold"])
        rows, bad = F.col("r") - F.col("ro"), F.col("b") - F.col("bo")
        x = x.withColumn(f"f_rows_{k}", F.log1p(rows)).withColumn(f"f_share_{k}", _share_of(bad, rows, prior)).drop("r", "b", "ro", "bo")
    names = [*lexical(F.col("url"), F.col("host"), F.col("path")), *_STATISTICS]
    train_rows = scratch.save(x.select("url", F.col("label").cast("double").alias("label"), *[f"f_{n}" for n in names]).orderBy("url").coalesce(1), "rows")
    if len(count) < 2:  # trees need both kinds; two rows that nothing tells apart stand for the one there is
        one = float(max(count, default=0))
        train_rows = spark.createDataFrame([("", one, *[0.0] * len(names))] * 2, train_rows.schema)
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=BINS, stepSize=STEP, seed=RANDOM)
    return UrlFilter(trees.fit(_assembled(train_rows, names)), suffix_rows, prior, rules, names)


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return train(seed_labels(pages), RULES).judge(pages).select("page_id", "host", "path", "rule", "verdict", "score")
