import math

import pytest
from pyspark.sql import functions as F

from nearfold.functions import text as X
from nearfold.functions.globs import compile_rule, parse_patterns, parse_rules
from nearfold.functions.languages import file_language, language_from_extension
from nearfold.sources import ignore


def column(spark, values, kind, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_languages(spark):
    cases = {".go": "go", ".GO": "go", ".py": "python", ".tf": "hcl", ".xyz": "", "": "", ".hxx": "cpp", ".yml": "yaml", ".fish": "bash", ".mli": "ocaml"}
    assert column(spark, list(cases), "string", language_from_extension) == list(cases.values())
    paths = ["a/b.d/Dockerfile", "x/y.test.go", ".bashrc", "q/.sh"]
    assert column(spark, paths, "string", file_language) == ["", "go", "", "bash"]


def test_split_lines(spark):
    assert column(spark, ["a\r\nb\n", "a\n\nb", "", "\n"], "string", X.split_lines) == [["a", "b"], ["a", "", "b"], [], [""]]


def test_preprocess(spark):
    cases = ["func a() {\n  x\n}\n", "{\n}\n", "  \n\ty\n { \n", ""]
    assert column(spark, cases, "string", X.preprocess_code) == ["func a() {\n  x", "", "\ty", ""]


def test_tokenize(spark):
    assert column(spark, ["Foo_Bar(x, y2) + é1 a", ""], "string", X.tokenize) == [["foo_bar", "y2"], []]


def test_sha(spark):
    import hashlib

    got = column(spark, ["abc é"], "string", X.chunk_sha)[0]
    assert got == hashlib.sha1("abc é".encode()).hexdigest() and len(got) == 40
    assert column(spark, ["0123456789", "01"], "string", X.short_sha) == ["01234567", "01"]


@pytest.mark.parametrize(("a", "b", "want"), [([1.0, 0.0], [1.0, 0.0], 1), ([1.0, 0.0], [0.0, 1.0], 0), ([1.0, 0.0], [-1.0, 0.0], -1), ([1.0], [1.0, 2.0], 0), ([0.0, 0.0], [1.0, 1.0], 0), ([], [], 0), ([1.0, 1.0], [1.0, 0.0], 1 / math.sqrt(2)), ([2.0, 4.0], [1.0, 2.0], 1)])
def test_cosine(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    assert df.select(X.cosine(F.col("a"), F.col("b"))).first()[0] == pytest.approx(want)


@pytest.mark.parametrize(("a", "b", "want"), [(("f", 1, 10), ("f", 2, 5), True), (("f", 2, 5), ("f", 1, 10), True), (("f", 1, 10), ("f", 1, 10), False), (("f", 1, 10), ("g", 2, 5), False), (("f", 1, 5), ("f", 3, 8), False), (("f", 1, 5), ("f", 6, 9), False), (("f", 1, 5), ("f", 1, 9), True), (("f", 5, 9), ("f", 1, 9), True), (("f", 1, 5), ("f", 5, 5), True)])
def test_subset(spark, a, b, want):
    df = spark.createDataFrame([(*a, *b)], "p string, s int, e int, q string, t int, u int")
    assert df.select(X.is_subset(*[F.col(c) for c in "pseqtu"])).first()[0] is want


def test_progress(spark):
    assert column(spark, [0, 5, 10, 55, 1000, 5000], "int", X.progress_interval) == [1, 1, 1, 5, 100, 100]


def test_parse_patterns():
    assert parse_patterns("# c\n\n *.log \n!a\n\t\n  # d\n/x/") == ["*.log", "!a", "/x/"]


def test_last_match(spark):
    def got(path, patterns):
        one = spark.createDataFrame([(path,)], "p string")
        r = one.select(ignore.ignored_by(F.col("p"), patterns), ignore.is_ignored(F.col("p"), patterns)).first()
        assert (r[0] is not None) == r[1]
        return r[0]

    assert got("a/debug.log", ["*.log"]) == "*.log"
    assert got("a/debug.log", ["*.log", "!debug.log"]) is None
    assert got("a/debug.log", ["!debug.log", "*.log"]) == "*.log"
    assert got("build/x.go", ["build/"]) == "build/"
    assert got("rebuild/x.go", ["build/"]) == "build/"  # a folder is found anywhere in the path
    assert got("src/main.go", ["*.log", "build/"]) is None
    assert got("src/main.go", ["/src/*.go"]) == "/src/*.go"
    assert got("src/a/main.go", ["src/*.go"]) is None
    assert got("x[1].go", ["[a", "x?1?.go"]) == "x?1?.go"
    assert got(".", ["*"]) is None


def test_rules():
    import re

    def hit(line, path):
        r = compile_rule(line)
        return bool(re.search(r.regex, path))

    assert [r.pattern for r in parse_rules("# c\n\na\n!b \nc \n/\n")] == ["a", "!b ", "c "]
    assert hit("*.log", "x/y/a.log") and not hit("*.log", "a.logs")
    assert hit("/a*", "abc/d") and not hit("/a*", "x/abc")
    assert hit("a/*.go", "a/b.go") and not hit("a/*.go", "a/b/c.go") and not hit("a/*.go", "x/a/b.go")
    assert hit("**/foo", "foo") and hit("**/foo", "a/b/foo") and hit("a/**/b", "a/b") and hit("a/**/b", "a/x/y/b")
    assert hit("a/**", "a/x/y") and hit("a/**", "a") and not hit("a/**", "b/a")
    assert compile_rule("build/").folder_only and compile_rule("!x").negated
    assert hit("\\#a", "#a") and hit("a\\ ", "a ") and hit("[!a]b", "cb") and not hit("[!a]b", "ab")
    assert compile_rule("a**b") is None and compile_rule("#x") is None and compile_rule("[a") is None


def test_binary(spark):
    cases = [b"hello\n\tworld\r\n", b"a\x00b", b"", bytes([1] * 40) + b"a" * 60, bytes([1] * 20) + b"a" * 80, b"a" * 600 + b"\x00"]
    assert column(spark, cases, "binary", ignore.is_binary) == [False, True, False, True, False, False]
