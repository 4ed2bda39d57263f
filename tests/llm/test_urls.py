"""URL filter: rules and features against plain versions, the trees by held-out accuracy."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from nearfold.llm import urls

SF = "/root/testdata/sf0.01"
ODD = [
    None, "", "no scheme", "http://", "http:///path", "HTTPS://WWW.Example.COM/en/1?x#y", "https://example.com/en", "https://example.com/en/", "ftp://a.example.com/en/x://y/z", "http://net/es/1",
    "http://x.net/fr/", "http://xnet/fr/", "http://a.net?q=/es/", "http://a.net#/es/", "http://com", "http://com/", "http://.com/", "http://a.com./", "//x.com/a", "http://ÄB.com/ß?ä=1&&b=%20",
    "http://h\nx.com/a\nb?c", "http://" + "a." * 3000 + "com/" + "d/" * 3000 + "?" + "k=v&" * 3000, "http://user@host.net:80/fr/x",
]


def split(url):
    m = re.match(r"[\s\S]*?://([^/?#]*)([^?#]*)", url or "")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return (m[1].translate(low), m[2]) if m else ("", "")


def ruled(host, path, rules):
    fits = []
    for verdict, text in rules:
        name, slash, rest = text.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith(slash + rest):
            fits.append((len(text), len(name), text, verdict))
    return max(fits)[2:] if fits else (None, None)


def frame(spark, rows):
    full = [(k, u, "mine", "mine", 5.0) for k, u in rows]
    return spark.createDataFrame(full, "page_id bigint, url string, host string, verdict string, other double")


def test_rules_and_parts(spark):
    rows = list(enumerate(ODD)) + [(7, ODD[5]), (None, ODD[5]), (None, None)]
    more = [*urls.RULES, ("block", "example.com/en/x:/"), ("allow", "host.net:80/fr"), ("block", "a.com"), ("allow", "b")]
    for rules in (urls.RULES, more, []):
        u = F.col("url")
        x = frame(spark, rows).select("url", urls.host_of(u).alias("h"), urls.path_of(u).alias("p"), urls.rule_for(urls.host_of(u), urls.path_of(u), rules).alias("r"))
        got = [(r.url, r.h, r.p, *(r.r or (None, None))) for r in x.collect()]
        assert got == [(t, *split(t), *ruled(*split(t), rules)) for _, t in rows]
    for bad in ([("maybe", "com/")], [("block", "/x")], [("block", f"h{k}/") for k in range(1001)]):
        with pytest.raises(ValueError):
            urls.rule_for(F.col("h"), F.col("p"), bad)


def test_features(spark):
    rng = random.Random(9)
    texts = [t for t in ODD if t] + ["".join(rng.choice("abc.-/?&=1%#:") for _ in range(rng.randrange(40))) for _ in range(100)]
    df = spark.createDataFrame([(t, *split(t)) for t in texts], "url string, host string, path string")
    for r in df.select("*", F.struct(*[c.alias(k) for k, c in urls.lexical(F.col("url"), F.col("host"), F.col("path")).items()]).alias("f")).collect():
        f, (host, path) = r.f, split(r.url)
        bits = lambda t: -sum(v / len(t) * math.log2(v / len(t)) for v in Counter(t).values()) if t else 0.0
        query = (re.match(r"[^?#]*\?([^#]*)", r.url) or ["", ""])[1]
        assert f.host_entropy == pytest.approx(bits(host), abs=1e-9) and f.path_entropy == pytest.approx(bits(path), abs=1e-9)
        assert (f.url_length, f.host_length, f.path_length, f.query_length) == (len(r.url), len(host), len(path), len(query))
        assert f.depth == len([s for s in path.split("/") if s]) and f.parameters == len([s for s in query.split("&") if s])
        assert f.digits == pytest.approx(sum(c in "0123456789" for c in r.url) / len(r.url)) if r.url else f.digits == 0
        assert f.host_signs == pytest.approx(len(re.findall(r"[^a-z0-9.]", host)) / len(host) if host else 0) and f.escapes == r.url.count("%")
        assert f.host_labels == len(host.split(".")) and f.longest_label == max(map(len, host.split(".")))


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")


def test_held_out(spark, pages):
    """Fitted on one half of the hosts, the trees know the other half."""
    labelled = urls.seed_labels(pages).withColumn("half", F.pmod(F.xxhash64(urls.host_of(F.col("url"))), F.lit(2)))
    assert labelled.where("label = 1").count() >= 10
    kept = urls.train(labelled.where("half = 0"))
    out = kept.judge(labelled.where("half = 1")).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == F.when(F.col("label") == 1, "block").otherwise("allow")).alias("right"))
    right = {r.label: r.right / r.n for r in out.collect()}
    assert right[0] >= 0.98 and right[1] >= 0.6


def test_filter(spark, pages):
    f = urls.train(urls.seed_labels(pages), urls.RULES)
    rows = list(enumerate(ODD)) + [(3, ODD[5]), (3, ODD[5]), (None, None)]
    df = frame(spark, rows)
    out = f.judge(df)
    assert out.columns == ["page_id", "url", "other", "host", "path", "rule", "score", "verdict"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        rule, verdict = ruled(*split(r.url), urls.RULES)
        assert (r.host, r.path, r.rule) == (*split(r.url), rule) and r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow"))
        assert r.host or (r.score == 0 and r.verdict == "allow")
    assert f.judge(df.limit(0)).count() == 0
    again = urls.train(urls.seed_labels(pages.repartition(7)), urls.RULES)
    score = lambda g: sorted((r.page_id, r.score) for r in g.judge(pages).collect())
    assert score(f) == score(again)


def test_few_labels(spark):
    """One kind of label, or none."""
    for rows, verdict in (([("http://a.com/", 1), ("http://b.com/", 1)], "block"), ([("http://a.com/", 0)], "allow"), ([], "allow"), ([(None, 1), ("http://a.com/", None)], "allow")):
        f = urls.train(spark.createDataFrame(rows, "url string, label int"))
        assert [r.verdict for r in f.judge(spark.createDataFrame([("http://q.org/x",)], "url string")).collect()] == [verdict]


def test_query(spark, pages):
    got = urls.op13_url_filter(spark, SF).collect()
    assert len(got) == pages.count()
    known = {r.page_id: r for r in got}
    for r in pages.collect():
        host, path = split(r.url)
        rule, verdict = ruled(host, path, urls.RULES)
        x = known[r.page_id]
        spam = any(w in urls.SEEDS for w in re.split("[^a-z0-9]+", host))
        assert (x.host, x.path, x.rule) == (host, path, rule) and x.verdict == (verdict or ("block" if spam else "allow"))
