"""Text, hash and vector functions; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRIMMED = " \t\n\x0b\x0c\r\x85\xa0"


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(TRIMMED))


def split_lines(text: Column) -> Column:
    """Lines without line ends; an empty last line isn't one, and one \\r before a line end goes."""
    parts = F.split(text, "\n", -1)
    last = F.element_at(parts, -1)
    lines = F.when(last == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.transform(lines, lambda x: F.regexp_replace(x, "\r$", ""))


def preprocess_code(code: Column) -> Column:
    """Without the lines that are blank or a lone brace."""
    return F.array_join(F.filter(F.split(code, "\n", -1), lambda x: ~trimmed(x).isin("", "{", "}")), "\n")


def tokenize(code: Column) -> Column:
    """Lower-case runs of letters, digits and underscores of at least two bytes."""
    return F.filter(F.split(F.lower(code), "[^a-zA-Z0-9_]+"), lambda t: F.octet_length(t) >= 2)


def chunk_sha(code: Column) -> Column:
    return F.sha1(F.encode(code, "UTF-8"))


def short_sha(sha: Column) -> Column:
    return F.substring(sha, 1, 8)


def cosine(a: Column, b: Column) -> Column:
    """0 for unequal lengths and for zero vectors."""

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)

    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    na = F.sqrt(total(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))
    nb = F.sqrt(total(F.transform(b, lambda x: x.cast("double") * x.cast("double"))))
    return F.when((F.size(a) == F.size(b)) & (na > 0) & (nb > 0), dot / (na * nb)).otherwise(0.0)


def to_single(v: Column) -> Column:
    """A vector at the precision it is stored in."""
    return F.transform(v, lambda x: x.cast("float"))


def is_subset(path_a: Column, start_a: Column, end_a: Column, path_b: Column, start_b: Column, end_b: Column) -> Column:
    """Same path, and one line range holds the other without being equal to it."""
    equal = (start_a == start_b) & (end_a == end_b)
    inside = ((start_a >= start_b) & (end_a <= end_b)) | ((start_b >= start_a) & (end_b <= end_a))
    return (path_a == path_b) & inside & ~equal


def progress_interval(total: Column) -> Column:
    return F.least(F.greatest(F.floor(total / 10), F.lit(1)), F.lit(100))


def request_text(language: Column, path: Column, start: Column, end: Column, code: Column) -> Column:
    """What a remote embedder is sent for a chunk."""
    return F.concat(F.lit("language: "), language, F.lit("\npath: "), path, F.lit("\nlines: "), start.cast("string"), F.lit("-"), end.cast("string"), F.lit("\n\n"), preprocess_code(code))
