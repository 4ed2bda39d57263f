"""Fill-in-the-middle against its contract, and exact round trips."""

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from nearfold.llm import fim

from .test_operators import ROWS, none, table

MORE = [(600, "a\n\n\nb\n", "s"), (601, "\n", "s"), (602, "no end", "s"), (603, "has <S> in it\nx", "s"), (604, "\U0001f600\nß\r\n\U0001f600", "s"), (605, "<P\n>\n<<M\nM>", "s"), (606, "line\n" * 30_000, "s"), (606, "line\n" * 30_000, "s")]


def digest(t):
    return hashlib.sha256(t.encode()).hexdigest()


def contract(doc_id, text):
    text = text or ""
    u = re.findall(r"[^\n]*\n|[^\n]+", text)
    x = digest("7:" + ("" if doc_id is None else str(doc_id)))
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(k in text for k in ("<P>", "<S>", "<M>")):
        return doc_id, len(u), "plain", None, None, digest(text), digest(text)
    spm = h[3] % 100 < 50
    out = f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, len(u), "spm" if spm else "psm", len(p), len(m), digest(out), digest(text)


def test_query(spark, tmp_path):
    rows = [*ROWS, *MORE]
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = fim.op12_fill_in_middle(spark, str(tmp_path)).collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(repr(contract(d, t)) for d, t, _ in rows)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(repr, con.execute(fim.ORACLE).fetchall())) == sorted(repr(tuple(r)) for r in got)


CUT = {
    "line": r"[^\n]*\n|[^\n]+",
    "word": r"[^\x20\x09-\x0D]*[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+",
    "char": r"[\s\S]",
}


def test_units(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab \n\n.!\U0001f600é\t") for _ in range(rng.randrange(40))) for _ in range(200)] + ["", "a", "\n", "x. y! z?\nb"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    names = [*fim.GRAMMARS, "char"]
    for r in df.select("text", *[fim.units(F.col("text"), k).alias(k) for k in names]).collect():
        for k in names:
            assert "".join(r[k]) == r.text and all(r[k]) and (r.text or not r[k])
            if k in CUT:
                assert r[k] == re.findall(CUT[k], r.text), (k, r.text)


def test_transform(spark):
    docs = table(spark, [*ROWS, *MORE]).withColumn("form", F.lit("mine")).withColumn("n", F.lit(9))
    for unit, rate, spm in (("word", 70, 20), ("sentence", 100, 100), ("char", 50, 0), ("paragraph", 0, 50)):
        x = fim.transform(docs, unit=unit, seed=3, rate=rate, spm=spm)
        rows = x.withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
        assert len(rows) == len(ROWS) + len(MORE) and all(r.back == (r.text or "") for r in rows)
        assert {r.form for r in rows} <= {"plain", *(["spm"] if spm else []), *(["psm"] if spm < 100 else [])}
        assert all((r.prefix or "") + (r.middle or "") + (r.suffix or "") == (r.text if r.form != "plain" else "") for r in rows)
        if 0 < rate < 100:
            share = sum(r.form != "plain" for r in rows) / len(rows)
            assert abs(share - rate / 100) < 0.25
        if rate == 0:
            assert all(r.form == "plain" for r in rows)
    assert fim.transform(none(spark)).count() == 0
    again = [sorted(map(repr, fim.transform(docs.repartition(k), unit="word").collect())) for k in (1, 5)]
    assert again[0] == again[1]
    own = fim.Marks("<pre>", "<suf>", "<mid>")
    back = fim.transform(docs, marks=own).withColumn("back", fim.restore(F.col("output"), F.col("form"), own))
    assert all(r.back == (r.text or "") for r in back.collect())
    for bad in (("P", "<S>", "<M>"), ("<P>", "<P>", "<M>"), ("<a<b>", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fim.Marks(*bad)
