import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfold.config import EngineConfig
from nearfold.operators import chunking, clustering, similarity, skiplist, tfidf, tiles
from nearfold.operators.graph import connected_components
from nearfold.plans.state import should_refreeze, with_ids
from nearfold.schemas import FILES


def files(spark, rows):
    return spark.createDataFrame([(p, 0, c, False) for p, c in rows], FILES)


def windows(lines, least, most, step):
    out, w = [], least
    while w <= most and w <= len(lines):
        out += [(s + 1, s + w, "\n".join(lines[s : s + w])) for s in range(0, len(lines) - w + 1, step)]
        w += step
    return out


@pytest.mark.parametrize("args", [(3, 5, 2), (2, 3, 1), (5, 8, 1), (3, 30, 3)])
def test_lines(spark, args):
    lines = [f"line{i}" for i in range(1, 11)]
    got = chunking.chunk_by_lines(files(spark, [("f.txt", "\n".join(lines) + "\n")]), *args)
    assert sorted(tuple(r) for r in got.select("start_line", "end_line", "code").collect()) == sorted(windows(lines, *args))
    assert {r[0] for r in got.select("language").collect()} == {"text"}


def test_lines_edges(spark):
    f = files(spark, [("empty.go", ""), ("short.go", "a\nb"), ("blank.go", " \n\t\n \n"), ("long.go", "x" * 70_000 + "\na\nb"), ("ok.go", "a\r\nb\r\nc")])
    rows = chunking.chunk_by_lines(f, 3, 5, 2).select("path", "language", "code").collect()
    assert [tuple(r) for r in rows] == [("ok.go", "go", "a\nb\nc")]


def test_syntax(spark):
    body = "".join(f"def f{i}(a, b):\n    x = a\n    y = b\n    return x + y\n\n" for i in range(6))
    got = chunking.chunk_files(files(spark, [("m.py", body), ("bad.py", "def ("), ("n.txt2", "a\nb\nc\n")]), EngineConfig())
    rows = got.select("path", "start_line", "end_line", "language", "sha").collect()
    assert sorted((r[0], r[1], r[2], r[3]) for r in rows) == [("m.py", 1 + 5 * i, 4 + 5 * i, "python") for i in range(6)] + [("n.txt2", 1, 3, "text")]
    few = chunking.chunk_by_syntax(files(spark, [("a.json", '{"a": [1, 2],\n "b": {}}')])).select("code").collect()
    assert sorted(r[0] for r in few) == sorted(['{"a": [1, 2],\n "b": {}}']) or len(few) >= 1


def test_tfidf(spark):
    snippets = {1: "def foo(a):\n return a + alpha", 2: "def bar(a):\n return a + alpha", 3: "select x from table where thing"}
    c = spark.createDataFrame(list(snippets.items()), "id bigint, code string")
    v = tfidf.build_vocabulary(c)
    w = tfidf.weights(c, v).collect()
    norm = {}
    vec = {}
    for r in w:
        norm[r.chunk_id] = norm.get(r.chunk_id, 0) + r.w**2
        vec.setdefault(r.chunk_id, {})[r.term_index] = r.w
    assert all(n == pytest.approx(1) for n in norm.values())
    dot = lambda a, b: sum(x * vec[b].get(k, 0) for k, x in vec[a].items())
    assert dot(1, 2) > dot(1, 3)
    one = spark.createDataFrame([(1, "only this chunk")], "id bigint, code string")
    assert tfidf.weights(one, tfidf.build_vocabulary(one)).count() == 0
    assert tfidf.all_vectors(one, tfidf.weights(one, tfidf.build_vocabulary(one))).count() == 1
    assert [r.term_index for r in v.orderBy("term_index").collect()] == list(range(v.count()))
    df = [(-r.df, r.term) for r in v.orderBy("term_index").collect()]
    assert df == sorted(df)


def test_pairs_and_neighbours(spark):
    rng = np.random.default_rng(3)
    base = rng.random((6, 30)) * (rng.random((6, 30)) < 0.4)
    rows = [base[rng.integers(6)] + (rng.random(30) < 0.1) * 0.3 for _ in range(40)] + [base[0]] * 15
    m = np.array(rows)
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    sparse = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(len(m)) for j in range(30) if m[i, j] > 0], "chunk_id bigint, term_index int, w double")
    packed = tfidf.vectors(sparse)
    s = m @ m.T
    got = {(r.a, r.b): r.sim for r in similarity.near_pairs(packed, 0.85).collect()}
    want = {(i, j) for i in range(len(m)) for j in range(i + 1, len(m)) if s[i, j] >= 0.85}
    assert set(got) == want and all(got[k] == pytest.approx(s[k]) for k in want)
    near = {}
    for r in similarity.neighbours(packed, 0.85, 10).collect():
        near.setdefault(r.a, []).append((r.rank, r.b, r.sim))
    for i in range(len(m)):
        best = sorted((x for x in s[i] if x >= 0.85 - 1e-12), reverse=True)[:10]
        assert [x for _, _, x in sorted(near[i])] == pytest.approx(best)
        assert len({b for _, b, _ in near[i]}) == len(near[i]) <= 10


def test_dense(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(60, 8))
    v = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "chunk_id bigint, embedding array<float>")
    got = similarity.dense_neighbours(v, 5, blocks=3).collect()
    u = m.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    for i in range(60):
        mine = [r.b for r in sorted((r for r in got if r.a == i), key=lambda r: r.rank)]
        assert mine == list(np.argsort(-s[i])[:5]) and mine[0] == i


def plain_fold(near, order):
    """The assignment as one loop over all chunks."""
    cluster_of, out = {}, []
    for c in order:
        if c in cluster_of:
            continue
        mine = 0
        for other, sim in near.get(c, []):
            mine = mine or cluster_of.get(c, 0)
            if other in cluster_of:
                if not mine:
                    cluster_of[c] = cluster_of[other]
                    out.append((cluster_of[c], c, sim))
                break
            if not mine:
                mine = cluster_of[c] = c
                out.append((c, c, 1.0))
            cluster_of[other] = mine
            out.append((mine, other, sim))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_assignment(spark, seed):
    rng = random.Random(seed)
    near = {}
    for a in range(1, 41):
        picks = rng.sample(range(1, 41), rng.randint(0, 3))
        near[a] = sorted(((b, round(rng.uniform(0.85, 1), 3)) for b in picks if b != a), key=lambda x: (-x[1], x[0]))
    rows = [(a, b, s) for a, xs in near.items() for b, s in xs]
    ids = spark.createDataFrame([(i,) for i in range(1, 41)], "id bigint")
    none = spark.createDataFrame([], "cluster_id bigint, chunk_id bigint, similarity double")
    got = clustering.assign(spark.createDataFrame(rows, "a bigint, b bigint, sim double"), ids, ids.limit(0), none)
    assert sorted(tuple(r) for r in got.collect()) == sorted(plain_fold(near, range(1, 41)))
    assert len({r.chunk_id for r in got.collect()}) == got.count()  # a partition


def test_scores(spark):
    members = [(1, 1, "p", 1, 20, 1.0), (1, 2, "p", 50, 70, 0.9), (1, 3, "p", 100, 115, 0.8)]
    chunks = spark.createDataFrame([(m[1], m[2], "go", m[3], m[4], "x" * 5 + "é", f"{m[1]}") for m in members], "id bigint, path string, language string, start_line int, end_line int, code string, sha string")
    mem = spark.createDataFrame([(m[0], m[1], m[5]) for m in members], "cluster_id bigint, chunk_id bigint, similarity double")
    clusters = spark.createDataFrame([(1, 1)], "cluster_id bigint, canonical_chunk_id bigint")
    one = {k: clustering.load_clusters(clusters, mem, chunks, k).first()["score"] for k in ("old", "impact", "default", "other")}
    assert one["old"] == 7 and one["impact"] == 57
    assert one["default"] == one["other"] == pytest.approx(57 * 0.9 * (1 + np.log2(3)))


def test_deletes(spark):
    clusters = spark.createDataFrame([(1, 1), (2, 5), (3, 7)], "cluster_id bigint, canonical_chunk_id bigint")
    members = spark.createDataFrame([(1, 1, 1.0), (1, 2, 0.9), (2, 5, 1.0)], "cluster_id bigint, chunk_id bigint, similarity double")
    assert sorted(r[0] for r in clustering.small_clusters(clusters, members).collect()) == [2, 3]
    left, kept = clustering.cascade_delete(clusters, members, spark.createDataFrame([(2,), (5,)], "id bigint"))
    assert sorted(r[0] for r in left.collect()) == [1, 3] and [tuple(r)[:2] for r in kept.collect()] == [(1, 1)]


def test_skips(spark):
    none = spark.createDataFrame([], "sha string, code string, created_at string")
    two = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "sha string, code string")
    once = skiplist.add_skips(none, two, "t")
    assert once.count() == 2 and skiplist.add_skips(once, two, "u").count() == 2
    assert skiplist.remove_skip(once, "a").count() == 1


def test_refreeze():
    assert should_refreeze(10, 0, 0.2) and should_refreeze(100, 70, 0.2)
    assert not should_refreeze(100, 80, 0.2) and not should_refreeze(100, 100, 0.2) and not should_refreeze(50, 100, 0.2)


def test_ids(spark):
    c = spark.range(0, 500).select(F.concat(F.lit("p"), F.col("id") % 50).alias("path"), F.col("id").cast("int").alias("start_line"), F.col("id").cast("int").alias("end_line"), F.lit("x").alias("code"))
    rows = with_ids(c, 10).orderBy("id").collect()
    assert [r.id for r in rows] == list(range(11, 511))
    assert [(r.path, r.start_line) for r in rows] == sorted((r.path, r.start_line) for r in rows)


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)]
    parent = list(range(60))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = sorted((root(a), root(b)))
        parent[rb] = ra
    got = {r.v: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    seen = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in seen}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_json_pairs():
    """Objects, arrays and pairs, breadth first, with the places and children of a syntax tree."""
    got = chunking.parse_json('{"a": [1, {"b": "x,}"}],\n "c" : {}, "d": 2 }')
    assert got == [
        ("object", 7, 1, 2, '{"a": [1, {"b": "x,}"}],\n "c" : {}, "d": 2 }'),
        ("pair", 3, 1, 1, '"a": [1, {"b": "x,}"}]'),
        ("pair", 3, 2, 2, '"c" : {}'),
        ("pair", 3, 2, 2, '"d": 2'),
        ("array", 5, 1, 1, '[1, {"b": "x,}"}]'),
        ("object", 2, 2, 2, "{}"),
        ("object", 3, 1, 1, '{"b": "x,}"}'),
        ("pair", 3, 1, 1, '"b": "x,}"'),
    ]
    assert chunking.parse_json("[]") == [("array", 2, 1, 1, "[]")] and chunking.parse_json("3") == []


def test_tiles(spark, monkeypatch):
    """Whatever the blocks, pairs, nearest and members are those of the whole product."""
    from nearfold.operators import tiles

    rng = np.random.default_rng(5)
    m = np.abs(rng.normal(size=(70, 12))) * (rng.random((70, 12)) < 0.6)
    m[5], m[6] = m[4], m[4]
    m = m[np.linalg.norm(m, axis=1) > 0]
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    rows = [(10 * i, [int(j) for j in np.flatnonzero(r)], [float(x) for x in r[r > 0]]) for i, r in enumerate(m)]
    packed = spark.createDataFrame(rows, "chunk_id bigint, ti array<int>, tw array<double>")
    s = m @ m.T
    n = len(m)
    monkeypatch.setattr(tiles, "LEAST_BLOCKS", 3)  # with blocks of 7 and 20 rows by cells
    for size in (7, 20, 1000):
        monkeypatch.setattr(tiles, "ROWS", size)
        got = {(r.a, r.b): r.sim for r in tiles.tile_pairs(packed, 0.7).collect()}
        assert set(got) == {(10 * i, 10 * j) for i in range(n) for j in range(i + 1, n) if s[i, j] >= 0.7}
        assert all(v == pytest.approx(s[a // 10, b // 10]) for (a, b), v in got.items())
        near = {}
        for r in tiles.tile_nearest(packed, 0.5, 4).collect():
            near.setdefault(r.a, []).append((-r.sim, r.b))
        some = {r.a: None for r in tiles.tile_nearest(packed.where("chunk_id < 100"), 0.5, 4, packed).collect()}
        for i in range(n):
            want = sorted((-round(s[i, j], 9), 10 * j) for j in range(n) if j != i and s[i, j] >= 0.5)[:4]
            assert [b for _, b in sorted(near.get(10 * i, []))[:4]] == [b for _, b in want]
            assert (10 * i in some) == (i < 10 and bool(want))
        hits = {r.id for r in tiles.tile_members(packed, packed.where("chunk_id < 50"), 0.8).collect()}
        assert hits == {10 * j for j in range(n) if s[:5, j].max() >= 0.8}
    assert tiles.tile_pairs(packed.limit(0), 0.5).count() == 0 and tiles.tile_members(packed, packed.limit(0), 0.5).count() == 0


GO_SOURCE = """package main

type Point struct {
	X, Y int // a { brace
}

const (
	A = 1
	B = "}"
)

func (p Point) Sum(k int) int {
	if n := k; n > 0 {
		return p.X + n
	} else if k < 0 {
		return 0
	}
	for i := 0; i < k; i++ {
		k--
	}
	return p.Y
}

func plain() {
	x := map[string]int{"a": 1}
	_ = x
}
"""
JS_SOURCE = """import x from 'y'
export async function load(a, b) {
  const f = (c) => { return `}${c}` };
  if (a) { return b } else { return f(a) }
}
class Box extends Base {
  static size(w) {
    for (let i = 0; i < w; i++) { w-- }
    while (w) w--;
    switch (w) { case 1: break }
  }
}
"""
JAVA_SOURCE = """package p;
public class Box extends Base {
  private int w;
  public int size(int k) throws Bad {
    if (k > 0) return k; else return w;
  }
  List<String> names() { return null; }
}
"""
C_SOURCE = """#include <stdio.h>
#define F(x) { x
static int add(int a, int b) {
  do { a++; } while (a < b);
  for (int i = 0; i < b; i++)
    a += i;
  return a;
}
"""


SHARP_SOURCE = """using System;
#region { x
namespace N {
  [Serializable]
  public sealed class Box<T> : Base, IFoo where T : class {
    private readonly string p = @"c:\\";
    public Box(int k) { }
    [Test]
    public static async Task<List<int>> Run(int k) {
      if (k > 0) { return null; } else if (k < 0) { return x; } else { y(); }
      for (int i = 0; i < k; i++) { k--; }
      foreach (var q in z) { q.Go(); }
      while (true) { break; }
      switch (k) { case 1: break; }
      do { k++; } while (k < 3);
    }
    int[] Names() {
      return null;
    }
  }
}
"""
PHP_SOURCE = """<p>don't {</p>
<?php
# it's a comment {
namespace A;
use const B\\C;
const X = 1;
abstract class Box extends Base implements I, J {
  private const Y = 2, Z = 3;
  #[Attr(1)]
  public static function make(int $k = 1): ?Box {
    $s = "a
    { b";
    if ($k > 0) { return $x['a']; } elseif ($k) { return 1; } else { return 2; }
    for ($i = 0; $i < $k; $i++) { echo $i; }
    foreach ($a as $b) { f($b); }
    while ($k) { $k--; }
    switch ($k) { case 1: break; }
    $g = function ($q) use ($k) { return $q; };
    return Box::class;
  }
  abstract function none();
}
function &plain($a) {
  $t = <<<EOT
  it's { here
  EOT;
  return new class { function m() { return 1; } };
}
?>
<b>"</b>
"""
YAML_SOURCE = """# top
version: "2"  # c
services:
  web:
    image: a/b:1
    ports:
    - "80:80"
    - 443
    env: {A: 1, B: [x, y], C: {}}
  db: &x
    cmd: |
      line: one
        - two

    list:
      - name: n
        run: >-
          k: v
      - - a
        - b
other: [1,
  2]
---
- x
- y: 1
"""


@pytest.mark.parametrize(
    ("language", "source", "want"),
    [
        ("go", GO_SOURCE, [("type_declaration", 2, 3, 5), ("const_declaration", 5, 7, 10), ("method_declaration", 6, 12, 22), ("function_declaration", 4, 24, 27), ("if_statement", 7, 13, 17), ("for_statement", 3, 18, 20), ("if_statement", 3, 15, 17)]),
        ("javascript", JS_SOURCE, [("function_declaration", 5, 2, 5), ("class_declaration", 4, 6, 12), ("lexical_declaration", 3, 3, 3), ("if_statement", 4, 4, 4), ("method_definition", 4, 7, 11), ("arrow_function", 3, 3, 3), ("for_statement", 7, 8, 8), ("while_statement", 3, 9, 9), ("switch_statement", 3, 10, 10)]),
        ("java", JAVA_SOURCE, [("class_declaration", 5, 2, 8), ("method_declaration", 6, 4, 6), ("method_declaration", 4, 7, 7), ("if_statement", 5, 5, 5)]),
        ("c", C_SOURCE, [("function_definition", 4, 3, 8), ("for_statement", 8, 5, 6)]),
        ("csharp", SHARP_SOURCE, [("class_declaration", 9, 4, 20), ("method_declaration", 8, 8, 16), ("method_declaration", 4, 17, 19), ("if_statement", 7, 10, 10), ("for_statement", 9, 11, 11), ("while_statement", 5, 13, 13), ("switch_statement", 5, 14, 14), ("if_statement", 7, 10, 10)]),
        ("php", PHP_SOURCE, [("const_declaration", 3, 6, 6), ("class_declaration", 6, 7, 22), ("function_definition", 5, 23, 28), ("const_declaration", 6, 8, 8), ("method_declaration", 9, 9, 20), ("method_declaration", 4, 27, 27), ("if_statement", 5, 13, 13), ("for_statement", 9, 14, 14), ("while_statement", 3, 16, 16), ("switch_statement", 3, 17, 17)]),
    ],
)
def test_braces(language, source, want):
    from nearfold.operators.braces import parse_braces

    got = [n for n in parse_braces(source, language) if not (n[0] == "lexical_declaration" and n[4].startswith("let"))]
    assert [n[:4] for n in got] == want
    lines = source.split("\n")
    assert all(n[4].count("\n") == n[3] - n[2] and lines[n[2] - 1].find(n[4].split("\n")[0]) >= 0 for n in got)
    if language != "php":  # the text ends outside of its tags
        with pytest.raises(ValueError):
            parse_braces(source + "}", language)


def test_yaml():
    from nearfold.operators.indents import parse_yaml

    got = parse_yaml(YAML_SOURCE)
    assert [n[:4] for n in got] == [
        ("block_mapping", 3, 2, 22), ("block_mapping", 2, 4, 20), ("block_mapping", 3, 5, 9), ("block_sequence", 2, 7, 8),
        ("flow_mapping", 7, 9, 9), ("flow_sequence", 5, 9, 9), ("flow_mapping", 2, 9, 9), ("block_mapping", 2, 11, 20),
        ("block_sequence", 2, 16, 20), ("block_mapping", 2, 16, 18), ("block_sequence", 2, 19, 20), ("flow_sequence", 5, 21, 22),
        ("block_sequence", 2, 24, 25), ("block_mapping", 1, 25, 25),
    ]
    lines = YAML_SOURCE.split("\n")
    assert all(n[4].count("\n") == n[3] - n[2] and n[4].split("\n")[0] in lines[n[2] - 1] for n in got)
    assert [n[4] for n in parse_yaml("a: b\r\nc: 'it''s'  # d\r\n")] == ["a: b\r\nc: 'it''s'"]
    assert [parse_yaml(x) for x in ("", "plain", "---\n", "\n \n", "url: x\n"[:3])] == [[]] * 5
    for bad in ("a: [1", "a: [1}", 'a: "b'):
        with pytest.raises(ValueError):
            parse_yaml(bad)
    assert parse_yaml("a" + " " * 50_000 + "b") == [] and parse_yaml("- " * 300)


def test_scanned_files(spark):
    """Nodes where there are some, lines where there are none or brackets don't match."""
    got = chunking.chunk_files(files(spark, [("a.go", GO_SOURCE), ("b.go", "let x\nlet y\nlet z\n"), ("c.go", "func f() {\nx\ny\n"), ("d.java", JAVA_SOURCE)]), EngineConfig())
    rows = sorted((r.path, r.start_line, r.end_line) for r in got.collect())
    assert rows == [("a.go", 3, 5), ("a.go", 7, 10), ("a.go", 12, 22), ("a.go", 13, 17), ("a.go", 15, 17), ("a.go", 18, 20), ("a.go", 24, 27), ("b.go", 1, 3), ("c.go", 1, 3), ("d.java", 2, 8), ("d.java", 4, 6), ("d.java", 5, 5), ("d.java", 7, 7)]


@pytest.mark.parametrize("seed,kind,rounds,most", [(1, "random", 2, 10**6), (2, "chain", 3, 60), (3, "star", 1, 0), (4, "dense", 2, 4), (6, "random", 0, 10**6)])
def test_assignment_in_rounds(spark, seed, kind, rounds, most):
    """Rounds over all chunks, components folded in tasks, and both: the same as one loop over all chunks."""
    rng = random.Random(seed)
    n, near = 30, {}
    for a in range(1, n + 1):
        if kind == "chain":
            others = [b for b in range(a - 2, a + 3) if 0 < b <= n and b != a]
        elif kind == "star":
            others = [b for b in (1, 2, 3) if b != a] + ([rng.randrange(4, n)] if a % 9 == 0 else [])
        else:
            others = [b for b in rng.sample(range(1, n + 1), rng.randrange(1, 3 if kind == "random" else 8)) if b != a]
        near[a] = sorted(((b, round(rng.choice([0.9, 0.95, rng.random()]), 3)) for b in set(others) - {a}), key=lambda x: (-x[1], x[0]))
    old = [(1000, 1000), (1000, n), (1001, 5)]
    cluster_of = {c: k for k, c in old}
    want = []
    for a in sorted(near):
        if a in cluster_of:
            continue
        for b, sim in near[a]:
            if b in cluster_of:
                if a not in cluster_of:
                    cluster_of[a] = cluster_of[b]
                    want.append((cluster_of[b], a, sim))
                break
            if a not in cluster_of:
                cluster_of[a] = a
                want.append((a, a, 1.0))
            cluster_of[b] = cluster_of[a]
            want.append((cluster_of[a], b, sim))
    edges = spark.createDataFrame([(a, b, s) for a, x in near.items() for b, s in x], "a bigint, b bigint, sim double")
    existing = spark.createDataFrame([(k, c, 1.0) for k, c in old], "cluster_id bigint, chunk_id bigint, similarity double")
    ids = spark.createDataFrame([(a,) for a in near], "id bigint")
    got = clustering.assign_new(edges, ids, ids.limit(0), existing, rounds, most).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_dense_by_tiles(spark, monkeypatch):
    """Dense vectors in many tiles, new ones only, and skips by cosine."""
    monkeypatch.setattr(tiles, "ROWS", 16)
    monkeypatch.setattr(tiles, "STRIP", 5)
    monkeypatch.setattr(tiles, "LEAST_BLOCKS", 3)
    rng = np.random.default_rng(8)
    m = np.repeat(rng.normal(size=(12, 6)), 8, axis=0) + rng.normal(size=(96, 6)) * 0.3
    m[17], m[40] = m[3], 0
    v = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "chunk_id bigint, embedding array<float>")
    u = m.astype(np.float32).astype(float)
    u /= np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-30)
    s = np.round(u @ u.T, 9)
    np.fill_diagonal(s, 1.0)
    new = spark.createDataFrame([(i,) for i in range(0, 96, 5)], "id bigint")
    live = [i for i in range(96) if i != 40]
    for threshold, ids in ((-2.0, None), (-2.0, new), (0.8, None), (0.8, new)):
        got = {}
        for r in similarity.dense_neighbours(v, 7, threshold=threshold, new_ids=ids).collect():
            got.setdefault(r.a, []).append((r["rank"], r.b, r.sim))
        assert set(got) == {i for i in live if ids is None or i % 5 == 0}
        for i, found in got.items():
            want = sorted(((-s[i, j], j) for j in live if s[i, j] >= threshold))[:7]
            assert [x for _, _, x in sorted(found)] == pytest.approx([-x for x, _ in want], abs=1e-6)
    listed = similarity.dense_packed(v.where("chunk_id % 20 = 0"))
    out = {r.id for r in skiplist.skipped_similar(similarity.dense_packed(v), listed, 0.9).collect()}
    assert out == {i for i in live if any(u[i] @ u[j] >= 0.9 for j in range(0, 96, 20) if j != 40)}


def test_codes(spark):
    """The search by codes has the hits of the exact one, and computes few rows exactly."""
    from nearfold.operators import quantised

    rng = np.random.default_rng(12)
    m = rng.normal(size=(3000, 32)) + 2 * rng.normal(size=(12, 32))[rng.integers(12, size=3000)]
    m[7] = 0
    v = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)] + [(5000, [1.0, 2.0]), (5001, None)], "chunk_id bigint, embedding array<float>")
    codes = quantised.encode(v)
    assert codes.count() == 3000 and {r.chunk_id for r in codes.where("chunk_id in (7, 5000)").collect()} == {5000}
    for k, threshold, limit in ((3, 0.2, 5), (9, 0.9, 10), (11, -1.0, 3)):
        q = [float(x) for x in m[k]]
        want = [(r.chunk_id, r.sim) for r in similarity.dense_search(v.where("size(embedding) = 32"), q, threshold, limit).collect()]
        assert [(r.chunk_id, r.sim) for r in quantised.coded_search(v, codes, q, threshold, limit).collect()] == want
        assert quantised.candidates(codes, q, threshold, limit).count() < 150
    exact = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30) @ (m[3] / np.linalg.norm(m[3]))
    assert all(r.low <= exact[r.chunk_id] <= r.high for r in quantised.bounded(codes, [float(x) for x in m[3]], -2.0).where("chunk_id < 3000").collect())
