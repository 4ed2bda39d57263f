"""What only shows on larger tables or odder rows than the smallest test tables hold."""

import ast
import weakref

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nearfold import queries
from nearfold.operators import braces, chunking, similarity, tiles


def compared(spark, folder, name, **tables):
    """The rows of a query and of its SQL over tables of Parquet files."""
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    df = queries.QUERIES[name](spark, str(folder))
    want = con.execute(f"select {', '.join(df.columns)} from ({queries.ORACLE[name]})").fetchall()
    return sorted(map(tuple, df.collect())), sorted(want)


@pytest.fixture
def long_pages(spark, tmp_path):
    ends = ["5", "15", "1235", "12345", "123455", "12345678905", "98765432109876543215/", "x12345", "12345.html", "123457", "/5", "555555//"]
    rows = [(k, f"https://a.example.com/{f}/{e}") for k, (f, e) in enumerate((f, e) for f in ("en", "de", "fr", "es") for e in ends)]
    rows += [(1000, None), (1001, "https://a.example.com/"), (1002, "https://a.example.com/1234565")]
    spark.createDataFrame(rows, "page_id bigint, url string").where("url is not null").write.parquet(f"{tmp_path}/pages.parquet")
    return tmp_path


@pytest.mark.parametrize("name", ["ignore_tree", "ignore_two_stages"])
def test_names_of_many_digits(spark, long_pages, name):
    got, want = compared(spark, long_pages, name, pages=None)
    assert got == want


def test_vectors_go_to_few_tiles(spark):
    """100,000 vectors are sent to as many tiles as keep the cores busy, and to no more."""
    from nearfold.operators import tiles

    packed = spark.range(100_000).selectExpr("id as chunk_id", "array(1) as ti", "array(1.0d) as tw")
    blocks = 5 if spark.sparkContext.defaultParallelism == 4 else 13
    assert tiles._dealt(packed, None).count() <= 100_000 * (blocks + 1)
    assert tiles._dealt_near(packed.limit(300), packed, 0.9).count() <= 300 * 4 + 100_000 * 2


def test_folded_bounds(monkeypatch):
    """Bounds are never under the products, and hits are the same whether few or many pairs pass them."""
    from nearfold.operators import tiles

    rng = np.random.default_rng(3)
    n, width, each = 300, 900, 40
    base = rng.integers(width, size=(30, each))
    m = np.zeros((n, width))
    for i in range(n):
        m[i, base[i % 30]] = rng.random(each) + 0.3
        m[i, rng.integers(width, size=8)] = -rng.random(8)
    m /= np.linalg.norm(m, axis=1, keepdims=True)

    def rows(a, b):
        where = np.nonzero(m[a:b])
        ids = np.arange(a, b)
        return tiles.Rows([(ids, np.bincount(where[0], minlength=b - a), where[1].astype(np.int32), m[a:b][where], ids, np.ones(b - a, np.int64))])

    assert (rows(0, 200).folded(0, 200) @ rows(200, 300).folded(0, 100).T >= m[:200] @ m[200:].T - 1e-5).all()
    monkeypatch.setattr(tiles, "DENSE", 64)
    monkeypatch.setattr(tiles, "STRIP", 17)
    want = {(int(i), int(j) + 200) for i, j in zip(*np.nonzero(m[:200] @ m[200:].T >= 0.7), strict=True)}
    assert want
    for few in (1, 10**9):
        monkeypatch.setattr(tiles, "FEW", few)
        got = [(int(a), int(b)) for strip, (i, j, _) in tiles._hits(rows(0, 200), iter([rows(200, 250), rows(250, 300)]), 0.7, False) for a, b in zip(i, strip.ids[j], strict=True)]
        assert len(got) == len(want) and set(got) == want


def test_pairs_of_copies(spark, monkeypatch):
    """Pairs of copies, in groups of one vector and of several, are written out where they are found: nothing is joined."""
    monkeypatch.setattr(similarity, "MOST_COPIES", 3)
    unit = {0: [1.0, 0.0], 1: [0.6, 0.8], 2: [0.8, 0.6]}
    kind = [0] * 8 + [1] + [2] * 2
    packed = spark.createDataFrame([(k, [0, 1], unit[v]) for k, v in enumerate(kind)], "chunk_id bigint, ti array<int>, tw array<double>")
    found = similarity.near_pairs(packed, 0.75)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    dot = {(a, b): sum(x * y for x, y in zip(unit[a], unit[b], strict=True)) for a in unit for b in unit}
    want = {(a, b): dot[kind[a], kind[b]] for a in range(11) for b in range(a + 1, 11) if dot[kind[a], kind[b]] >= 0.75}
    rows = found.collect()
    assert len(rows) == len(want) and {(r.a, r.b): round(r.sim, 9) for r in rows} == {k: round(v, 9) for k, v in want.items()}


def test_neighbouring_events(spark, tmp_path):
    """Events with gaps, over the borders of blocks, meet by one shuffle of events on either side."""
    rows = [(k, k % 3 if k % 11 else None) for k in [*range(0, 45), *range(370, 450), 799, 800, 840, 841, 2000]]
    spark.createDataFrame([*rows, (None, 1)], "event_id bigint, user_id bigint").write.parquet(f"{tmp_path}/events.parquet")
    got, want = compared(spark, tmp_path, "neighbours_unrelated", events=None)
    assert got == want and got
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = queries.QUERIES["neighbours_unrelated"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 2


def test_skips_shuffle_no_vectors(spark, monkeypatch):
    """A list that fits into a task goes to the vectors where they lie; a longer one has the same hits by tiles."""
    from nearfold.operators import skiplist, tiles

    packed = spark.createDataFrame([(k, [k % 7, 7 + k % 3], [0.8, 0.6]) for k in range(200)], "chunk_id bigint, ti array<int>, tw array<double>")
    listed = packed.where("chunk_id in (0, 9)")
    want = {k for k in range(200) for x in (0, 9) if 0.64 * (k % 7 == x % 7) + 0.36 * (k % 3 == x % 3) >= 0.6}
    found = tiles.tile_members(packed, listed, 0.6)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.id for r in found.collect()} == want
    assert tiles.tile_members(packed, listed.limit(0), 0.6).count() == 0
    monkeypatch.setattr(tiles, "LISTED", 1)
    assert {r.id for r in skiplist.skipped_similar(packed, listed, 0.6).collect()} == want


def test_tokens_of_few_bytes_at_once():
    """Texts are cut into tokens about a megabyte at a time, so what a task holds doesn't follow its batches."""
    from nearfold.functions.tokens import token_slices

    texts = pa.array(["ab cd " * 50_000] * 20)
    slices = list(token_slices(texts))
    assert sum(n for _, n, _, _ in slices) == 20 and max(n for _, n, _, _ in slices) <= 4


def test_chunks_are_staged_once(spark, tmp_path, monkeypatch):
    """The text of new chunks is written once before it is committed."""
    from nearfold.config import EngineConfig
    from nearfold.plans import engine
    from nearfold.sources.files import files_from_table

    labels = []
    real = engine.stage
    monkeypatch.setattr(engine, "stage", lambda df, label: labels.append((label, df.columns)) or real(df, label))
    docs = spark.createDataFrame([(f"d/{k}", "\n".join(f"alpha{j} beta{k} gamma" for j in range(9))) for k in range(4)], "path string, text string")
    e = engine.Engine(spark, EngineConfig(state=f"{tmp_path}/state"))
    e.ingest(files_from_table(docs, F.col("path"), F.col("text"), F.lit(1)))
    assert not [x for x in labels if "code" in x[1]]
    rows = e.state.read("chunks").orderBy("id").collect()
    assert [r.id for r in rows] == list(range(1, len(rows) + 1))
    assert [(r.path, r.start_line, r.end_line) for r in rows] == sorted((r.path, r.start_line, r.end_line) for r in rows)


def test_syntax_chunks_stay_in_their_task(spark):
    """a file for each order, so places are told apart in the file: no chunk is shuffled or sorted."""
    for name in ("syntax_chunks_json", "syntax_chunks_functions"):
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and plan.count("Exchange") == 1, name


def test_longest_of_a_file(spark):
    """Chunks of one place in a file, told apart there or by a window: the longest in bytes, then the least."""
    found = [(1, 2, "b"), (1, 2, "abc"), (1, 2, "éé"), (1, 2, "zzzz"), (3, 3, "x"), (4, 4, "y"), (4, 4, "y")]
    rows = spark.createDataFrame([("p", *x) for x in found], "path string, start_line int, end_line int, code string")
    want = sorted(tuple(r)[1:] for r in chunking.longest_by_location(rows).collect())
    assert sorted(chunking._longest(found)) == want == [(1, 2, "zzzz"), (3, 3, "x"), (4, 4, "y")]
    twice = spark.createDataFrame([("a.json", 0, c, False) for c in ("[1,\n2]", "[1,\n22]")], "path string, modified_at bigint, content string, explicit_file boolean")
    assert [r.code for r in chunking.chunk_by_syntax(twice).collect()] == ["[1,\n22]"]


def test_scans_look_at_told_tokens(monkeypatch):
    """a scan takes up the tokens that a node may begin at, and a walk of Python's tree enters no expression."""
    seen = []
    go = braces.Scan.go
    monkeypatch.setattr(braces.Scan, "go", lambda self, i, t: (seen.append(t), go(self, i, t))[1])
    source = "func f(a int) int {\n\tb = 1 + 2 + 3\n\treturn b\n}\n"
    assert len(braces.parse_braces(source * 20, "go")) == 20 and seen == ["func"] * 20
    fields = []
    iter_fields = ast.iter_fields
    monkeypatch.setattr(ast, "iter_fields", lambda node: (fields.append(node), iter_fields(node))[1])
    assert [n[:4] for n in chunking.parse_python("def f(a):\n    b = " + "a + " * 50 + "a\n    return b\n")] == [("function_definition", 3, 1, 3)]
    assert len(fields) == 1


def test_a_tile_is_held_once(monkeypatch):
    """while a tile is multiplied, nothing of what its left side was read from is held beside it."""
    seen, parts = [], tiles._parts
    monkeypatch.setattr(tiles, "_parts", lambda batch: (found := parts(batch), seen.extend(map(weakref.ref, found)))[0])
    batch = pa.RecordBatch.from_pydict({"tile": [0, 0, 0], "side": [0, 0, 1], "same": [False] * 3, "chunk_id": [1, 2, 3], "ti": pa.array([[]] * 3, pa.list_(pa.int32())), "tw": [[0.6, 0.8]] * 3})
    ((left, right, _),) = ((a, list(b), c) for a, b, c in tiles._tiles(iter([batch])))
    assert left.ids.tolist() == [1, 2] and right[0].ids.tolist() == [3]
    out = tiles._tiles(iter([batch.slice(0, 2)]))
    seen.clear()
    left, _, _ = next(out)
    assert left.weights.tolist() == [0.6, 0.8] * 2 and seen and not any(r() is not None for r in seen)


def test_products_of_near_copies_are_computed_together(monkeypatch):
    """Hits among changed copies come from products of whole groups, not pair by pair, and are those of all pairs."""
    rng = np.random.default_rng(5)
    n, width = 900, 1000
    base = rng.random((6, width)) * (rng.random((6, width)) < 0.08)
    m = base[rng.integers(6, size=n)] * (1 + 0.1 * rng.normal(size=(n, width)))
    m[::9] = rng.random((n // 9, width)) * (rng.random((n // 9, width)) < 0.05)
    m /= np.linalg.norm(m, axis=1, keepdims=True)

    def rows(a, b):
        where = np.nonzero(m[a:b])
        ids = np.arange(a, b)
        return tiles.Rows([(ids, np.bincount(where[0], minlength=b - a), where[1].astype(np.int32), m[a:b][where], ids, np.ones(b - a, np.int64))])

    singly = []
    monkeypatch.setattr(tiles, "_exact", lambda *x, f=tiles._exact: singly.append(len(x[1])) or f(*x))
    sims = m @ m.T
    for left, right, same in ((rows(0, 500), [rows(500, 700), rows(700, n)], False), (rows(0, n), [rows(0, 400), rows(400, n)], True)):
        singly.clear()
        got = {(int(left.ids[a]), int(b)): s for strip, (i, j, sim) in tiles._hits(left, iter(right), 0.85, same) for a, b, s in zip(i, strip.ids[j], sim, strict=True)}
        want = {(int(a), int(b)) for a, b in zip(*np.nonzero(sims >= 0.85), strict=True) if a < b and (same or a < 500 <= b)}
        assert set(got) == want and len(want) > 10_000
        assert max(abs(s - sims[k]) for k, s in got.items()) < 1e-12
        assert sum(singly) < len(want) / 10


def test_vectors_are_shuffled_once_for_all_tiles(spark, monkeypatch):
    """F3 to F5: blocks meet where they lie, so no vector is shuffled for each tile, and each two pieces meet once."""
    monkeypatch.setattr(tiles, "ROWS", 150)
    monkeypatch.setattr(tiles, "PIECE", 40)
    packed = spark.range(600).selectExpr("id as chunk_id", "array(cast(id % 50 as int), 50) as ti", "array(0.8d, 0.6d) as tw")
    pieces = tiles._pieces(packed, 4, "l").selectExpr("l_block", "l_first", "length(l_ids) div 8 as n").collect()
    assert sum(r.n for r in pieces) == 600 and max(r.n for r in pieces) <= 40 and len({r.l_block for r in pieces}) == 4
    met = [(r[0], r[1]) for r in tiles._crossed(packed, None).select("l_first", "r_first").collect()]
    assert len(met) == len({frozenset(x) for x in met}) == len(pieces) * (len(pieces) + 1) // 2
    for found in (tiles.tile_nearest(packed, 0.9, 5), tiles.tile_pairs(packed, 0.9), tiles.tile_nearest(packed.where("chunk_id < 90"), 0.9, 5, packed)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Explode" not in plan and "Generate" not in plan
    assert tiles.tile_pairs(packed, 0.9).count() == 50 * 12 * 11 // 2
