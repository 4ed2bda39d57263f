"""Bands of the quality rules on labelled rows and on made texts."""

import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from nearfold.llm import fertility as ft
from nearfold.llm.words import text_slices

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def vocabularies():
    return ft.Fertility(ft.FIRST, ft.SECOND)


def judged(vocabularies, texts, langs):
    out = []
    for t in text_slices(pa.array(texts, pa.string()), 2 << 20):
        found = ft.verdicts(vocabularies, t, pa.array(langs[t.first : t.first + len(t)], pa.string()), ft.BANDS)
        out += pa.RecordBatch.from_arrays(found, names=ft._NAMES).to_pylist()
    return out


@pytest.fixture(scope="module")
def labelled():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    quality = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    rows = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    return [(r["text"], r["lang"], quality[r["doc_id"]]) for r in rows if r["doc_id"] in quality]


@pytest.mark.parametrize("with_lang", [True, False])
def test_long_junk(vocabularies, labelled, with_lang):
    found = judged(vocabularies, [t for t, _, _ in labelled], [x if with_lang else None for _, x, _ in labelled])
    long = [(r["kept"], q) for r, (_, _, q) in zip(found, labelled, strict=True) if not r["base_failed"] and r["n_tokens"] >= 100]
    junk, clean = [k for k, q in long if q == 0], [k for k, q in long if q == 1]
    assert len(junk) > 20 and sum(junk) <= 0.1 * len(junk)
    assert len(clean) > 200 and sum(clean) >= 0.99 * len(clean)


def test_entropy_has_two_sides(vocabularies):
    ids = random.Random(3).sample(range(1000, vocabularies.size), 6000)
    pieces = [x[1:] for x in map(vocabularies.first.id_to_piece, ids) if x[0] == "▁" and x[1:].isascii() and x[1:].isalpha() and len(x) > 4]
    (r,) = judged(vocabularies, [" ".join(pieces[:2000])], ["en"])
    assert not r["base_failed"] and r["token_entropy"] > ft.usual_entropy(r["n_tokens"]) + 1 and not r["kept"]


SHORT_JUNK = [
    "For&&& thstrend&&& ouedst$$$ eres*** than.\nThndating.$$$\nThe and attion to thanedble the, anea. Eriner thanea.",
    "Les, Les, la la ouque ouque éoué éoué eaument eaument lepavi lepavi les, les, leeau leeau",
    " ".join(chr(0x10400 + 3 * i) * 2 for i in range(10)),  # the vocabulary has bytes only for these
    " ".join("xq" + c + "jzkv" + c for c in "abcdefghij"),
]
SHORT_CLEAN = [
    "The children walked along the river and talked about the long summer that lay behind them.",
    "Please send the report to the office before the end of the week, and call if anything is missing.",
    "The children walked along the river and talked about the long summer 😀 that lay behind them.",
]


@pytest.mark.parametrize("lang", ["en", None])
def test_short_texts(vocabularies, lang):
    junk = judged(vocabularies, SHORT_JUNK, [lang] * len(SHORT_JUNK))
    assert [(r["base_failed"], r["kept"], r["n_tokens"] < 100) for r in junk] == [(False, False, True)] * len(junk)
    clean = judged(vocabularies, SHORT_CLEAN, [lang] * len(SHORT_CLEAN))
    assert all(r["n_tokens"] < 100 and r["kept"] for r in clean)


FIT = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(FIT), reason="no test tables")
def test_bands_are_fitted(spark):
    """BANDS come from rows of even doc_id; the others are held out."""
    docs, labels = spark.read.parquet(f"{FIT}/documents.parquet"), spark.read.parquet(f"{FIT}/labels.parquet")
    assert ft.fit_bands(docs.where("doc_id % 2 = 0"), labels) == ft.BANDS
    held = ft.judge(docs.where("doc_id % 2 = 1").join(labels, "doc_id"), ["quality"]).where("not base_failed and n_tokens >= 100")
    n = {(r.quality, r.kept): r["count"] for r in held.groupBy("quality", "kept").count().collect()}
    assert n.get((0, True), 0) <= 0.02 * n[0, False] and n.get((1, False), 0) <= 0.005 * n[1, True]


def test_fit_of_odd_rows(spark):
    """A new language gets a band of its own; nulls, repeated rows, clashing columns and empty tables do no harm."""
    words = [a + b for a in "maa meri taivas ilta aamu koti joki pelto kivi tuuli sade lumi".split() for b in "ssa lla ksi".split()]
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(words) for _ in range(200)), "fi") for i in range(30)] + [(None, "x", None), (77, None, "fi"), (78, "", "fi")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("kept", F.lit(1)).withColumn("quality", F.lit(0))
    labels = spark.createDataFrame([(i, 1) for i in range(30)] + [(i, 1) for i in range(3)] + [(None, 1), (77, 1), (78, None)], "doc_id long, quality int")
    made = ft.fit_bands(docs, labels, least=20)
    kept = {r.doc_id: r.kept for r in ft.judge(docs, ["doc_id"], bands=made).collect()}
    assert set(made) == {*ft.BANDS, "fi"} and all(kept[i] for i in range(30)) and not kept[77] and not kept[78]
    assert {k: v for k, v in made.items() if k not in ("fi", "latin")} == {k: v for k, v in ft.BANDS.items() if k != "latin"}
    assert ft.fit_bands(docs, labels.limit(0)) == ft.BANDS == ft.fit_bands(docs.limit(0), labels, least=1)
    assert ft.fit_bands(docs, labels, most=10, least=20) == ft.BANDS
