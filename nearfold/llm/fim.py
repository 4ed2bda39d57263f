"""Fill-in-the-middle: texts cut at two borders of units and put in another order, with a mark before each piece.

A grammar of units becomes a regular expression that matches nothing but a place: a look back at the class of what
comes before a border and a look ahead at the class of what comes after.  Spark's split cuts at such places and
keeps every character, so the units joined are the text.  A text without characters has no unit and is set apart, since a
split gives one empty piece for it.

All of it are column functions; no row leaves the JVM.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The classes beside a border, by unit: what has just ended, and what must follow it.  Something must follow, so
#: that a text's end is no border.
GRAMMARS = {
    "line": (r"\n", r"[\s\S]"),
    "paragraph": (r"\n\n", r"[^\n]"),
    "word": (r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"),
    "sentence": (r"[.!?][\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"),
}


@dataclass(frozen=True)
class Marks:
    """What stands before each piece.  A mark begins with < and ends with >, with neither inside, so that it can't
    arise where a piece meets a mark."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        three = (self.prefix, self.suffix, self.middle)
        if len(set(three)) < 3 or not all(re.fullmatch(r"<[^<>]+>", m) for m in three):
            raise ValueError("marks are three different words in < and >")

    def inside(self, text: Column) -> Column:
        """Whether a text has a mark in it."""
        return F.contains(text, F.lit(self.prefix)) | F.contains(text, F.lit(self.suffix)) | F.contains(text, F.lit(self.middle))


def border(unit: str) -> str:
    """The zero-width expression of a unit's borders."""
    before, after = GRAMMARS[unit]
    return f"(?<={before})(?={after})"


def units(text: Column, unit: str = "line") -> Column:
    """The units of a text in order; none for a null or empty one.  "char": code points."""
    pieces = F.split(text, "" if unit == "char" else border(unit), -1)
    return F.when(F.length(text) > 0, pieces).otherwise(F.array().cast("array<string>"))


def _piece(u: Column, start: Column, end: Column) -> Column:
    return F.array_join(F.slice(u, start + 1, end - start), "")


def transform(docs: DataFrame, key: str = "doc_id", unit: str = "line", seed: int = 7, rate: int = 100, spm: int = 50, marks: Marks = Marks()) -> DataFrame:
    """docs with n (units of the text), form (plain, psm or spm), prefix, middle, suffix and output.

    A hash of seed and key draws the two borders, whether the text is transformed (rate in a hundred) and which order it
    takes (spm in a hundred begin with the suffix), so reruns and other partitions agree.  Plain texts, which are those
    not drawn, without characters, or with a mark in them, stay as they are and have no pieces.

    Defined results: a null text is an empty one; a null key is the empty word; rows that share a key have the same
    draws; columns of docs with one of the new names give way; an empty table gives no rows; a text is cut whole.
    """
    made = ("n", "form", "prefix", "middle", "suffix", "output")
    docs = docs.drop(*made)
    hexes = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    draw = [F.conv(F.substring("h", 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    text = F.coalesce("text", F.lit(""))
    x = docs.select(F.struct(*docs.columns).alias("row"), text.alias("text"), units(text, unit).alias("u"), hexes.alias("h"))
    x = x.select("row", "text", "u", F.size("u").alias("n"), *[d.alias(f"h{k}") for k, d in enumerate(draw, 1)])
    a, b = (F.col(h) % (F.col("n") + 1) for h in ("h1", "h2"))
    plain = (F.col("text") == "") | marks.inside(F.col("text")) | (F.col("h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    x = x.select("row", "text", "u", "n", F.least(a, b).cast("int").alias("a"), F.greatest(a, b).cast("int").alias("b"), form.alias("form"))
    zero, u, n = F.lit(0), F.col("u"), F.col("n")
    some = F.col("form") != "plain"
    cuts = {"prefix": (zero, F.col("a")), "middle": (F.col("a"), F.col("b")), "suffix": (F.col("b"), n)}
    x = x.select("row", "text", n.cast("long").alias("n"), "form", *[F.when(some, _piece(u, s, e)).alias(k) for k, (s, e) in cuts.items()])
    psm = F.concat(F.lit(marks.prefix), "prefix", F.lit(marks.suffix), "suffix", F.lit(marks.middle), "middle")
    turned = F.concat(F.lit(marks.suffix), "suffix", F.lit(marks.prefix), "prefix", F.lit(marks.middle), "middle")
    x = x.withColumn("output", F.when(~some, F.col("text")).when(F.col("form") == "spm", turned).otherwise(psm))
    return x.select("row.*", *made)


def restore(output: Column, form: Column, marks: Marks = Marks()) -> Column:
    """The text that an output was made of."""
    pattern = "<(?:" + "|".join(re.escape(m[1:-1]) for m in (marks.prefix, marks.suffix, marks.middle)) + ")>"

    def joined(p: Column) -> Column:
        """p: nothing, two pieces in the order of the form, the middle."""
        return F.when(form == "spm", F.concat(p[2], p[3], p[1])).otherwise(F.concat(p[1], p[3], p[2]))

    cut = F.array(F.split(output, pattern, -1))  # an array of one, so that it is split once
    return F.when(form == "plain", output).otherwise(F.transform(cut, joined)[0])


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return transform(docs).select(
        "doc_id",
        "n",
        "form",
        F.length("prefix").cast("long").alias("prefix_chars"),
        F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


ORACLE = r"""
with t as (select doc_id, coalesce(text, '') as text, sha256('7:' || coalesce(doc_id::varchar, '')) as h from documents),
u as (select doc_id, text, case when text = '' then [] else regexp_extract_all(text, '[^\n]*\n|[^\n]+') end as u,
  ('0x' || substr(h, 1, 8))::bigint as h1, ('0x' || substr(h, 9, 8))::bigint as h2, ('0x' || substr(h, 17, 8))::bigint as h3, ('0x' || substr(h, 25, 8))::bigint as h4 from t),
c as (select *, len(u)::bigint as n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) as a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) as b,
  case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 100 then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form from u),
p as (select doc_id, text, n, form, coalesce(array_to_string(u[1:a], ''), '') as prefix, coalesce(array_to_string(u[a + 1:b], ''), '') as middle, coalesce(array_to_string(u[b + 1:], ''), '') as suffix from c)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(text) as restored_sha256
from p
"""
