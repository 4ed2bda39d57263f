"""Operators of this subpackage against plain versions, on small tables with odd rows."""

import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from nearfold.llm import anchors, components, digest, fertility, jaccard, line_runs, mixing, packing, pfor, pieces, scratch, skew, warc

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_lines string, kept string, hits int"


def table(spark, rows, parts=3):
    """Documents with further columns whose names the operators use themselves."""
    full = [(d, t, "en", s, None if t is None else len(t), "mine", "mine", 7) for d, t, s in rows]
    return spark.createDataFrame(full, DOCS).repartition(parts)


def odd_rows():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)] + ["ÉA", "b.", "c,"]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    line = "A line that many of the documents hold  "
    rows = []
    for i in range(60):
        body = " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5, 160)))
        if i % 3 == 0:
            body = body + " " + passage + " " + body[:40]
        if i % 4 == 0:
            body = body + "\n" + (line if i % 8 else "\t" + line.upper())
        rows.append((i * 2 + 1, body, f"s{i % 3}" if i % 5 else "s0"))
    base = rows[0][1].split()
    for k in range(12):  # near copies
        x = list(base)
        for _ in range(k // 3):
            x[rng.randrange(len(x))] = f"changed{k}"
        rows.append((200 + k, " ".join(x), None))
    rows += [(300 + k, rows[5][1], "s1") for k in range(6)]
    rows += [(400, None, "s2"), (401, "", "s2"), (402, " \n\t\n", None), (403, "one", "s2"), (404, "one", "s2"), (405, "One two\nthree", "s2"), (406, rows[2][1], "s0"), (406, rows[2][1], "s0")]
    rows += [(407, " ".join(rng.choice(vocabulary) for _ in range(30_000)) + "\n" + line, "s0"), (None, rows[3][1], "s1"), (None, None, None)]
    return rows


ROWS = odd_rows()


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def none(spark):
    return table(spark, ROWS).limit(0)


# ---------------------------------------------------------------- 1


def test_fertility(spark):
    got = fertility.judge(table(spark, ROWS), ["doc_id", "text"]).collect()
    assert len(got) == len(ROWS)
    for r in got:
        t = r.text or ""
        w = words_of(t)
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        count, cover = Counter(windows), set()
        for i, x in enumerate(windows):
            if count[x] > 1:
                cover.update(range(i, i + 5))
        lines = [x for x in t.split("\n") if words_of(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 10 or 100 * len(cover) > 20 * len(w)) and not (r.base_failed and r.kept)
    assert fertility.judge(none(spark), ["doc_id"]).count() == 0
    assert fertility.keep_good(table(spark, ROWS)).columns == table(spark, ROWS).columns


def test_fertility_measures(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.vocabulary("piece_bpe_32k.model"))
    texts = ["The quick brown fox jumps over the lazy dog and runs away.", "слово и дело", "中文字符 測試 \U0001f600\U0001f600", "zzz " * 200]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    for r in fertility.judge(df, ["doc_id", "text"]).collect():
        ids = [i for w in words_of(r.text) for i in sp.encode(w)]
        n, c = len(ids), Counter(ids)
        assert r.n_tokens == n and r.chars_per_token == pytest.approx(sum(map(len, words_of(r.text))) / n)
        assert r.byte_share == pytest.approx(sum(v for k, v in c.items() if sp.is_byte(k)) / n)
        assert r.token_entropy == pytest.approx(-sum(v / n * math.log2(v / n) for v in c.values()), abs=1e-9)
    bands = {r.doc_id: r.band for r in fertility.judge(df, ["doc_id"]).collect()}
    assert bands == {0: "latin", 1: "cyrillic", 2: "east_asian", 3: "latin"}
    rejected = fertility.judge(df, ["doc_id"]).where("doc_id = 3").first()
    assert not rejected.kept


# ---------------------------------------------------------------- 2


def test_token_files(spark):
    got = pfor.token_files(spark, table(spark, ROWS))
    e = pieces.TextEncoder("word_bpe_49k.json", False)
    rows = sorted(((d is not None, d or 0), t or "") for d, t, _ in ROWS)
    want, start = [], 0
    for (known, d), t in rows:
        ids = np.array([*e.tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4")
        want.append((d if known else None, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    have = sorted((tuple(r) for r in got.collect()), key=lambda r: r[1])
    # rows that share a doc_id go in order of their ids, which is not that of their texts
    assert Counter((r[0], r[2], r[3]) for r in have) == Counter((r[0], r[2], r[3]) for r in want)
    assert [r[0] for r in have] == [r[0] for r in want] and [r[1] for r in have] == np.cumsum([0] + [r[2] for r in have[:-1]]).tolist()
    small = pfor.write_files(spark, table(spark, ROWS), scratch.Scratch(spark, "t"), rows=7, most=500)
    assert small.count() > 5
    assert sorted(map(tuple, pfor.read_files(small).collect()), key=lambda r: r[1]) == have
    assert pfor.token_files(spark, none(spark)).count() == 0


# ---------------------------------------------------------------- 3


def components_of(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for d, t, _ in rows:
        w = words_of((t or "").translate(low))
        sets.append((d, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, s) in enumerate(sets):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return Counter((d, len(s), least.get(root(i)) if s else d) for i, (d, s) in enumerate(sets))


@pytest.mark.parametrize(("per_range", "group"), [(1_000_000, 256), (300, 3), (2000, 1)])
def test_jaccard(spark, monkeypatch, per_range, group):
    monkeypatch.setattr(jaccard, "GROUP", group)
    got = jaccard.jaccard_components(spark, table(spark, ROWS), per_range)
    assert Counter(map(tuple, got.collect())) == components_of(ROWS)


@pytest.mark.parametrize("parts", [1, 3])
def test_jaccard_families(spark, monkeypatch, parts):
    """A sentence in every document, families of near copies over many groups, and copies in hot keys."""
    monkeypatch.setattr(jaccard, "GROUP", 4)
    monkeypatch.setattr(jaccard, "_PARTS", 2)
    monkeypatch.setattr(skew, "LEAST", 10)
    monkeypatch.setattr(skew, "MOST", 5)
    rng = random.Random(4)
    common = " every text of this table has this sentence in it and no other one"
    rows = []
    for f in range(4):
        base = [f"f{f}w{rng.randrange(500)}" for _ in range(80)]
        for k in range(40):
            x = list(base)
            for _ in range(rng.choice([0, 1, 2, 9])):
                x[rng.randrange(len(x))] = f"n{rng.randrange(10_000)}"
            rows.append((len(rows), " ".join(x) + common, None))
    rows += [(len(rows) + k, common, None) for k in range(60)]
    rows += [(len(rows) + k, a, None) for k, a in enumerate(["".join("ab"[bin(i).count("1") % 2] for i in range(1024)), "".join("ba"[bin(i).count("1") % 2] for i in range(1024))])]
    rng.shuffle(rows)
    got = jaccard.jaccard_components(spark, table(spark, rows, parts), 2000)
    assert Counter(map(tuple, got.collect())) == components_of(rows)


def test_keep_one_without_ids(spark):
    rows = [(None, "a b c d e f", "s"), (None, "a b c d e f", "s"), (3, "a b c d e f", "s"), (3, "a b c d e f", "s"), (4, "a b c d e f", "s"), (5, None, "s"), (6, "", "s")]
    got = jaccard.keep_one(spark, table(spark, rows)).collect()
    assert sorted(repr(r.doc_id) for r in got) == sorted(map(repr, [None, None, 3, 3, 5, 6]))
    assert jaccard.keep_one(spark, none(spark)).count() == 0


def test_jaccard_random(spark):
    rng = random.Random(8)
    rows = []
    for f in range(6):
        base = [f"f{f}w{rng.randrange(60)}" for _ in range(rng.randrange(10, 60))]
        for k in range(12):
            x = list(base)
            for _ in range(rng.randrange(0, 5)):
                x[rng.randrange(len(x))] = f"n{rng.randrange(1000)}"
            rows.append((len(rows), " ".join(x), None))
    got = jaccard.jaccard_components(spark, table(spark, rows), 500)
    assert Counter(map(tuple, got.collect())) == components_of(rows)
    kept = jaccard.keep_one(spark, table(spark, rows))
    assert {r.doc_id for r in kept.collect()} == {c for _, _, c in components_of(rows)} and kept.columns == table(spark, rows).columns
    assert jaccard.jaccard_components(spark, none(spark)).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40) if i % 10 != 9] + [(50, 50)], "a bigint, b bigint")
    got = {r.v: r.component for r in components.components(edges, scratch.Scratch(spark, "c")).collect()}
    assert all(got.get(i, i) == i // 10 * 10 for i in range(41))


# ---------------------------------------------------------------- 4


def plain_lines(rows):
    upper = re.compile(r"[A-Z]")

    def key(x):
        return upper.sub(lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))

    held = {}
    for i, (d, t, _) in enumerate(rows):
        if d is not None:
            for k in {key(x) for x in (t or "").split("\n")}:
                if len(k) >= 20:
                    held.setdefault(k, []).append(d)
    out = []
    for d, t, _ in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if d is None or len(held.get(key(x), [])) < 3 or max(held[key(x)]) == d]
        out.append((d, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return out


@pytest.mark.parametrize("batches", [1, 4, 7])
def test_lines(spark, batches):
    got = line_runs.dedup_lines(spark, table(spark, ROWS), batches=batches)
    assert got.columns == [c for c in table(spark, ROWS).columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    rows = got.collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in rows) == Counter(plain_lines(ROWS))
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
    assert line_runs.dedup_lines(spark, none(spark)).count() == 0


def test_runs(spark, tmp_path):
    folder = f"file://{tmp_path}/runs"
    want = {}
    for b in range(9):
        store = line_runs.LineRuns(spark, folder, fanout=2)  # opened anew for each batch
        batch = [(100 * b + i, (b * i) % 7, i % 3) for i in range(12)]
        for d, hi, lo in batch:
            n, keep = want.get((hi, lo), (0, -1))
            want[hi, lo] = (n + 1, max(keep, d))
        lines = spark.createDataFrame(batch, "doc_id bigint, hi bigint, lo bigint")
        store.add(lines, f"batch{b}")
        store.add(lines, f"batch{b}")  # it has been counted
    store = line_runs.LineRuns(spark, folder, fanout=2)
    assert {(r.hi, r.lo): (r.n_docs, r.keep) for r in store.table().collect()} == want
    assert all(len(x) < 2 for x in [*store.levels, *store.again]) and any(store.again)
    keys = [tuple(r) for name in store.runs() for r in store.run(name).select("hi", "lo").collect()]
    assert len(keys) == len(set(keys))  # a key is in one run
    probe = spark.createDataFrame([(1, 0, 0), (1, 99, 99)], "doc_id bigint, hi bigint, lo bigint")
    assert [r.hi for r in store.unseen(probe).collect()] == [99]
    held = {x for level in [*store.levels, *store.again] for x in level}
    assert {p.name for p in (tmp_path / "runs").iterdir() if p.name.startswith("run-")} == held
    for name in held:  # sorted in each file
        for file in (tmp_path / "runs" / name).glob("*.parquet"):
            rows = [(r.hi, r.lo) for r in spark.read.parquet(f"file://{file}").collect()]
            assert rows == sorted(rows)


def test_runs_are_not_shuffled(spark, tmp_path):
    """The merge-anti-join and the merges of runs have no exchange but the one that sorts the batch into buckets."""
    store = line_runs.LineRuns(spark, f"file://{tmp_path}/runs", fanout=5)
    for b in range(3):
        store.add(spark.range(500).select((F.col("id") + 300 * b).alias("doc_id"), (F.col("id") + 300 * b).alias("hi"), F.col("id").alias("lo")))
    for df in (store.unseen(store.run(store.runs()[-1])), store.merged(*store.runs()[:2]), store.table()):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan, plan
    assert "SortMergeJoin" in store.unseen(store.run(store.runs()[-1]))._jdf.queryExecution().executedPlan().toString()


def test_runs_of_earlier_calls(spark, tmp_path):
    """Documents of a second call lose lines that the first one has brought; a failed batch leaves nothing."""
    folder = f"file://{tmp_path}/runs"
    first = [(d, t, s) for d, t, s in ROWS if d is not None and d % 2]
    second = [(d, t, s) for d, t, s in ROWS if d is not None and d % 2 == 0]
    line_runs.dedup_lines(spark, table(spark, first), store=folder, label="first", batches=2).count()
    for _ in range(2):
        got = line_runs.dedup_lines(spark, table(spark, second), store=folder, label="second", batches=3)
    want = Counter(plain_lines(first + second)) - Counter(x for x in plain_lines(first + second) if x[0] % 2)
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got.collect()) == want
    store = line_runs.LineRuns(spark, folder)
    before = sorted(map(tuple, store.table().collect()))
    broken = spark.createDataFrame([(1, 2, 3)], "doc_id bigint, hi bigint, lo bigint").withColumn("doc_id", F.raise_error(F.lit("lost")).cast("bigint"))
    with pytest.raises(Exception, match="lost"):
        store.add(broken)
    assert sorted(map(tuple, line_runs.LineRuns(spark, folder).table().collect())) == before


# ---------------------------------------------------------------- 6


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 50)), rng.choice(["a", "b", "b", "b", "c", "", None])) for i in range(600)] + [(None, "x y", "a"), (5, "again", "b"), (700, None, "c"), (701, "z", "ü")]
    got = mixing.mix_sources(spark, table(spark, rows))
    one = got.collect()
    assert Counter((r.doc_id, r.size) for r in one) == Counter((d, len(words_of(t))) for d, t, _ in rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(words_of(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, rest, left = {}, 1.5 * sum(sizes.values()), set(order)
    while True:
        total = sum(weight[s] for s in left)
        over = [s for s in left if rest * weight[s] / total > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
        rest -= sum(target[s] for s in over)
        left -= set(over)
    target |= {s: rest * weight[s] / total for s in left}
    assert sorted({(r.source_size, round(r.target, 6)) for r in one}) == sorted({(sizes[s], round(target[s], 6)) for s in order})
    for s in order:
        taken = sum(r.taken for r in one if round(r.target, 6) == round(target[s], 6) and r.source_size == sizes[s])
        assert abs(taken - target[s]) <= 50
    assert all(0 <= r.taken <= 2 * r.size for r in one)
    assert sorted(map(repr, mixing.mix_sources(spark, table(spark, rows, 7)).collect())) == sorted(map(repr, one))
    copies = mixing.emit_copies(spark, table(spark, [r for r in rows if r[0] != 5]))
    drawn = Counter()
    for r in mixing.mix_sources(spark, table(spark, [r for r in rows if r[0] != 5])).collect():
        drawn[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in copies.collect()) == +drawn and copies.columns == table(spark, rows).columns
    assert mixing.mix_sources(spark, none(spark)).count() == 0


# ---------------------------------------------------------------- 7


@pytest.mark.parametrize("rows_each", [2048, 5])
def test_digest(spark, rows_each):
    got = digest.compare_neighbours(table(spark, ROWS), rows=rows_each).collect()
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    texts = [t or "" for _, t, _ in order]
    ranks = digest.ranks_of(digest.count_entropies([t.encode() for t in texts]))
    assert {r.ranks for r in got} == {digest.version_of(ranks)}
    want = []
    for i, (d, _, _) in enumerate(order):
        t, nxt = texts[i], texts[(i + 1) % len(texts)]
        n = len(t)
        edited = t[: n - n // 4] + nxt[: n // 4]
        a, b, c = digest.digests([t.encode(), edited.encode(), nxt.encode()], ranks)
        want.append((d, n, sha(edited), digest.to_text(a), digest.to_text(b), round(digest.likeness(a, b), 9), round(digest.likeness(a, c), 9)))
    assert Counter((*r[:5], round(r[5], 9), round(r[6], 9)) for r in got) == Counter(want)
    assert digest.compare_neighbours(none(spark)).count() == 0
    one = digest.compare_neighbours(table(spark, [(1, "alone and short", "s")])).first()
    assert one.near_next == 1.0
    assert digest.fingerprints(table(spark, ROWS)).count() == len(ROWS)


# ---------------------------------------------------------------- 8


def plain_substrings(rows, window):
    first = {}
    for d, t, _ in rows:
        if d is not None:
            w = words_of(t)
            for i in range(len(w) - window + 1):
                k = tuple(w[i : i + window])
                first[k] = min(d, first.get(k, d))
    out = []
    for d, t, _ in rows:
        w = words_of(t)
        gone = set()
        if d is not None:
            for i in range(len(w) - window + 1):
                if first[tuple(w[i : i + window])] < d:
                    gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize(("window", "per_range"), [(50, 1_000_000), (50, 400), (10, 900), (3, 5000)])
def test_substrings(spark, window, per_range, monkeypatch):
    monkeypatch.setattr(anchors, "range_bits", lambda items, _: max(0, int(np.ceil(np.log2(max(1, items / per_range))))))
    got = anchors.dedup_substrings(spark, table(spark, ROWS), window)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()) == Counter(plain_substrings(ROWS, window))
    assert got.columns == [c for c in table(spark, ROWS).columns if c != "kept"] + ["n_words", "n_removed", "kept"]


@pytest.mark.parametrize("parts", [1, 7])
def test_substrings_random(spark, parts):
    """Passages at any place of many documents, copies, and repeats inside one document."""
    rng = random.Random(parts)
    passages = [[f"p{k}x{j}" for j in range(rng.randrange(20, 70))] for k in range(6)]
    rows = []
    for i in range(90):
        x = [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 40))]
        for p in rng.sample(passages, rng.randrange(0, 4)):
            x += p + [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 9))]
        rows.append((rng.randrange(60), " ".join(x * rng.choice([1, 1, 1, 2])), "s"))
    rows += [(100 + k, rows[3][1], "s") for k in range(80)]
    rng.shuffle(rows)
    got = anchors.dedup_substrings(spark, table(spark, rows, parts), 20)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()) == Counter(plain_substrings(rows, 20))


def test_substrings_empty(spark):
    assert anchors.dedup_substrings(spark, none(spark)).count() == 0


# ---------------------------------------------------------------- 9


def test_warc(spark):
    body = "<p>" + "x" * 120 + "é</p>"
    rows = [(i, f"http://e/{i}", body if i % 2 else f"page {i}") for i in range(10)] + [(20, None, None), (21, "http://e/\r\nbad", ""), (None, "http://e/n", body), (22, "u", "page 0"), (23, "u", body), (23, "u", body)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id bigint, url string, html string, image string")
    got = warc.round_trip(spark, pages)
    assert got.where("reason is not null").count() == 0
    want = Counter()
    for p, _, h in rows:
        raw = (h or "").encode()
        again = p is not None and h == body and p > 1
        want[p, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", 1 if again else None] += 1
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert Counter(tuple(r[c] for c in cols) for r in got.collect()) == want
    assert {bytes(r.payload).decode() for r in got.where("record_type = 'response'").collect()} == {h or "" for _, _, h in rows}
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_warc_files(spark, tmp_path):
    """Archives as files: any gzip reader opens them, reruns write the same ones, and damage costs what it hits."""
    pages = spark.createDataFrame([(i, f"http://e/{i}", f"page {i} " + "y" * 200) for i in range(40)], "page_id bigint, url string, html string")
    made = warc.write_archives(warc.classify(pages), most=4000)
    made.unionByName(spark.createDataFrame([(None,)], "image binary")).write.parquet(str(tmp_path / "images"))
    images, folder = spark.read.parquet(str(tmp_path / "images")), tmp_path / "out"
    paths = sorted(r.path for r in warc.export_archives(images, str(folder)).collect())
    assert sorted(r.path for r in warc.export_archives(images, folder.as_uri()).collect()) == paths
    assert sorted(str(p) for p in folder.iterdir()) == paths and len(paths) > 1
    assert all(gzip.open(p).read().startswith(b"WARC/1.1\r\n") for p in paths)
    opened = warc.open_archives(spark, str(folder))
    assert {r.page_id for r in warc.read_archives(opened).collect()} == set(range(40))
    whole = open(paths[0], "rb").read()
    with open(paths[0], "wb") as f:
        f.write(b"\0" * 30 + whole[30:])
    got = warc.read_archives(warc.open_archives(spark, str(folder))).collect()
    assert [r.gap_start for r in got if r.reason] == [0] and len({r.page_id for r in got if not r.reason}) == 39
    assert warc.export_archives(images.limit(0), str(folder)).count() == 0


# ---------------------------------------------------------------- 10


def check_packing(rows, got):
    """Pieces (doc_id, piece, start, length, ids_crc32, sequence_id, offset) of rows (doc_id, text): the library's ids, all of them
    once, in sequences without gaps that are nearly as few as can be; how many there are."""
    e = pieces.TextEncoder("byte_bpe_50k.json", True)
    want = Counter()
    total = 0
    for d, t in rows:
        ids = np.array([*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        for k, (s, n) in enumerate(packing.cut(len(ids), 2048)):
            want[d, k, s, n, zlib.crc32(ids[s : s + n].tobytes())] += 1
    assert Counter(tuple(r[:5]) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in by.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 2048
    assert len(by) <= -(-total // 2048) + 3
    return len(by)


def test_packing(spark):
    rng = random.Random(6)
    rows = ROWS + [(500 + i, " ".join(["tok"] * rng.randrange(1, 900)), None) for i in range(40)]
    got = packing.pack_documents(spark, table(spark, rows)).collect()
    sequences = check_packing([r[:2] for r in rows], got)
    assert packing.pack_documents(spark, none(spark)).count() == 0
    parted = packing.pack(spark, packing.token_pieces(table(spark, rows)).cache(), part=3).collect()
    assert len({(r.sequence_id, r.offset) for r in parted}) == len(parted) == len(got) and len({r.sequence_id for r in parted}) == sequences


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as cp

    table(spark, [(900, None, "src0"), (901, "", None), (902, "only one line of it", "src1")]).select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    kept = [tuple(r) for r in cp.quality_rules(spark, docs, str(tmp_path)).collect()]
    judged = {(r.doc_id, r.text) for r in fertility.judge(docs, ["doc_id", "text"]).where("kept").collect()}
    assert {r[:2] for r in kept} == judged
    cut = {(d, t): n for (d, t, *_), (_, _, _, n) in zip(kept, plain_lines([(r[0], r[1], None) for r in kept]), strict=True)}
    lined = [tuple(r) for r in cp.line_dedup(spark, spark.createDataFrame(kept, docs.schema), str(tmp_path)).collect()]
    assert Counter(r[:2] for r in lined) == Counter((k[0], v) for k, v in ((r[:2], cut[r[:2]]) for r in kept))
    left = [tuple(r) for r in cp.near_duplicates(spark, spark.createDataFrame(lined, docs.schema), str(tmp_path)).collect()]
    want = {(d, c) for d, _, c in components_of([(r[0], r[1], None) for r in lined])}
    assert {r[0] for r in left} == {d for d, c in want if d == c or d is None}
    # copies by the SQL of the mix in another engine; the tables have no doc_id twice
    con = duckdb.connect()
    con.register("docs", pd.DataFrame([(r[0], r[1], r[3]) for r in left], columns=["doc_id", "text", "source"]))
    copies = dict(con.execute(f"with {mixing.MIX_SQL} select doc_id, copies from mixed").fetchall())
    mixed = [tuple(r) for r in cp.mix_sources(spark, spark.createDataFrame(left, docs.schema), str(tmp_path)).collect()]
    assert Counter(mixed) == +Counter({r: copies[r[0]] for r in left}) and any(n == 0 for n in copies.values()) and any(n > 1 for n in copies.values())
    check_packing([r[:2] for r in mixed], cp.run(spark, str(tmp_path)).collect())
    for name, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == columns, name


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline as cp

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in cp.STAGES:
        assert stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).count() == 0, name
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_spread_join(spark, monkeypatch):
    monkeypatch.setattr(skew, "LEAST", 5)
    monkeypatch.setattr(skew, "MOST", 4)
    rows = spark.createDataFrame([(k % 7 if k % 3 else 1, k) for k in range(100)] + [(None, 500), (99, 501)], "key long, v long").cache()
    named = rows.where("key < 90").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top")).cache()
    want = Counter(map(tuple, rows.join(named.drop("n"), "key", "left").select("key", "v", "top").collect()))
    got = skew.spread_join(rows, named, ["key"], "n", 100)
    assert got.columns == ["key", "v", "top"] and Counter(map(tuple, got.collect())) == want
    inner = skew.spread_join(rows, named, ["key"], "n", 100, "inner")
    assert Counter(map(tuple, inner.collect())) == Counter({k: v for k, v in want.items() if k[2] is not None})
