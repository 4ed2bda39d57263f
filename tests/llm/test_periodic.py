"""Periodic runs against their definition."""

import hashlib
import random
import re
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nearfold.llm import periodic
from nearfold.llm.words import find_words, hash_words, text_slices

from .test_operators import ROWS, none, table, words_of

SF = "/root/testdata/sf0.001"


def plain_runs(w, exponent, least):
    """Every period tried at every place."""
    n, found = len(w), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, exponent * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def random_words(rng):
    w = [rng.choice("abcde"[: rng.choice([1, 2, 3, 5])]) for _ in range(rng.randrange(60))]
    if rng.random() < 0.5 and w:
        w += w[: rng.randrange(1, 12)] * rng.randrange(2, 9) + w[: rng.randrange(5)]
    return w * 2 if rng.random() < 0.3 else w


@pytest.mark.parametrize("exponent,least", [(2, 2), (3, 2), (4, 6), (2, 10)])
def test_runs_by_definition(exponent, least):
    rng = random.Random(exponent * 100 + least)
    for _ in range(120):
        texts = [random_words(rng) for _ in range(rng.randrange(1, 9))]
        texts += [texts[0], [], ["x"] * rng.randrange(40)]
        for t in text_slices(pa.array([" ".join(w) for w in texts])):
            w = find_words(t)
            got = periodic.find_runs(hash_words(t, w), w, exponent, least)
        assert [got.get(i, []) for i in range(len(texts))] == [plain_runs(w, exponent, least) for w in texts]


def test_blocks_and_factors():
    """Blocks join to the text; each is a letter not seen before or the longest factor that began earlier."""
    rng = random.Random(3)
    for _ in range(60):
        text = random_words(rng) or ["a"]
        for t in text_slices(pa.array([" ".join(text)])):
            w = find_words(t)
            h = hash_words(t, w)
        sa, levels = periodic.suffix_ranks(h, w.bound[1:][w.doc])
        longest, source = periodic.previous_factors(sa, levels)
        for i in range(len(text)):
            best = max((next((k for k in range(len(text) - i) if text[j + k] != text[i + k]), len(text) - i) for j in range(i)), default=0)
            assert longest[i] == best and (best == 0 or (source[i] < i and text[source[i] : source[i] + best] == text[i : i + best]))
        starts = periodic.blocks(longest, w.bound).tolist()
        assert starts[0] == 0 and all(b - a == max(1, longest[a]) for a, b in zip(starts, [*starts[1:], len(text)], strict=True))


def test_collapse(spark):
    long = " ".join(f"u{i % 7}" for i in range(40_000))
    rows = [*ROWS, (500, "a  b\na b\ta b a b a b c", "s"), (501, long, "s"), (501, long, "s")]
    docs = table(spark, rows).withColumn("runs", F.lit("mine"))
    out = periodic.collapse_runs(docs)
    assert out.columns == [c for c in docs.columns if c not in ("runs", "kept")] + ["n_words", "runs", "kept"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        w = words_of(r.text)
        want = plain_runs(w, 4, 6) if len(w) < 2000 else [(0, 40_000, 7)] if r.doc_id == 501 else []
        gone = {i for s, n, q in want for i in range(s + q, s + n)}
        assert [tuple(x) for x in r.runs] == want and r.n_words == len(w) and r.kept == " ".join(x for i, x in enumerate(w) if i not in gone)
    assert periodic.collapse_runs(none(spark)).count() == 0
    with pytest.raises(ValueError):
        periodic.find_runs(hash_words(*_one("a b")), _one("a b")[1], exponent=1)


def _one(text):
    t = next(text_slices(pa.array([text])))
    return t, find_words(t)


def contract(doc_id, text):
    w = words_of(text)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(w, 4, 6)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (doc_id, len(runs), *best, None if best[1] is None else 1000 * best[1] // best[2], digest(lines), digest(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = [tuple(r) for r in rows if len(words_of(r.text)) < 1500] + [(10_000 + k, t) for k, t in enumerate([None, "", " \n", "one", "x y " * 30, "é " * 9])] + [(None, "a " * 8), (None, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = periodic.op11_periodic_runs(spark, str(tmp_path)).collect()
    key = lambda r: repr(tuple(r))
    assert sorted(map(key, got)) == sorted(map(key, (contract(*r) for r in rows)))
    assert sum(zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows) > 10 and re.match("[0-9a-f]{64}", got[0].runs_sha256)
