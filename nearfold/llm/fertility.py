"""Quality rules: base counts of words and lines, and the fertility of public vocabularies.

A text's words are encoded with public vocabularies.  Characters per token, the share of byte-fallback
tokens and the entropy of its tokens must lie in the band of its language or, where the language has none,
of its script.  Text that a vocabulary cuts into far too many tokens, into raw bytes, or into a few tokens
over and over is rejected, and so is text with too many symbols.  A short text is held to the same bands with a
margin.

Defined results: a null or empty text has no words, fails the base rules (under 10 words) and measures 0;
a null or unknown lang takes the band of the script; repeated rows are judged alike; an empty table gives
no rows.  A column of the input that has the name of a measure gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pieces import PieceStore, vocabulary
from .words import SPACES, Texts, Words, find_words, grams, hash_words, mix, per_text, text_slices

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 10
#: Tokens of a short text that needn't fit the band, at most this share of them; bytes that needn't; bits of entropy.
SPARE_TOKENS, SPARE_SHARE, SPARE_BYTES, SPARE_ENTROPY = 25, 0.4, 4, 0.35
WINDOW = 5


@dataclass(frozen=True)
class Band:
    """What is accepted; a measure outside rejects.

    Entropy may lie `entropy_below` bits under what clean text of as many tokens has, and `entropy_above` over it.
    The ratios of a text of under `least_tokens` tokens scatter, since a number or a secret in it weighs much; the
    bounds give way there by SPARE_TOKENS, SPARE_BYTES and SPARE_ENTROPY, which weigh the more the fewer tokens there
    are.  Such a text needs `short_evenness` besides, its entropy over that of as many different tokens, in place of
    `entropy_low`.
    """

    chars_low: float = 1.4
    chars_high: float = 12.0
    second_low: float = 1.2
    bytes_high: float = 0.2
    symbols_high: float = 0.1
    entropy_low: float = 4.9
    entropy_below: float = 2.5
    entropy_above: float = 2.5
    least_tokens: int = 100
    short_evenness: float = 0.6


#: By language, else by script.  Those of languages and of latin are what fit_bands finds on the labelled rows of even
#: doc_id of the 10,000 test documents (a test fits them again).  Other scripts have no labelled rows.  The test
#: documents' words are few, so natural prose lies up to 2 bits over their entropy and the upper bound stands at 2.5.
BANDS = {
    "en": Band(chars_low=1.97, second_low=2.04, bytes_high=0.1, entropy_below=0.22),
    "de": Band(chars_low=2.03, second_low=2.15, bytes_high=0.1, entropy_below=0.29),
    "fr": Band(chars_low=1.7, second_low=1.85, bytes_high=0.1, entropy_below=0.38),
    "es": Band(chars_low=1.75, second_low=1.9, bytes_high=0.1, entropy_below=0.35),
    "latin": Band(chars_low=1.6, second_low=1.75, bytes_high=0.1, entropy_below=0.48),
    "cyrillic": Band(chars_low=1.2),
    "greek": Band(chars_low=0.7, second_low=0.4),
    "east_asian": Band(chars_low=0.25, second_low=0.25, bytes_high=0.9, entropy_low=4.0),
    "other": Band(chars_low=0.2, second_low=0.2, bytes_high=1.0, entropy_low=3.5),
}
#: Scripts by the first byte of a character in UTF-8; the order is that of the columns counted.
SCRIPTS = ("latin", "cyrillic", "greek", "east_asian", "other")
_SCRIPT = np.full(256, 255, np.uint8)
_SCRIPT[ord("A") : ord("Z") + 1] = _SCRIPT[ord("a") : ord("z") + 1] = 0
_SCRIPT[0xC3:0xCB] = 0
_SCRIPT[0xD0:0xD5] = 1
_SCRIPT[0xCD:0xD0] = 2
_SCRIPT[0xE3:0xEE] = 3
_SCRIPT[0xD5:0xE0] = 4
_SCRIPT[0xE0:0xE2] = 4
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True

MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, "
    "chars_per_token double, chars_per_token_2 double, byte_share double, token_entropy double, band string, base_failed boolean, kept boolean"
)
_NAMES = [m.split()[0] for m in MEASURES.split(", ")]


class Fertility:
    """Tokens of distinct words: the ids of a vocabulary with byte fallback, then how many a second one needs."""

    def __init__(self, first: str, second: str):
        import base64

        import public_tokenizers
        import sentencepiece
        import tiktoken

        self.first = sentencepiece.SentencePieceProcessor(model_file=vocabulary(first))
        with open(vocabulary(second), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.second = tiktoken.Encoding("second", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = self.first.vocab_size()
        self.is_byte = np.array([self.first.is_byte(i) for i in range(self.size)])
        self.store = PieceStore(self._many, 1_500_000, True)  # the count of a very long word is large

    def _many(self, words: list[str]) -> list[list[int]]:
        second = self.second.encode_ordinary
        return [[*ids, len(second(" " + w))] for ids, w in zip(self.first.encode(words, num_threads=1), words, strict=True)]

    def measure(self, t: Texts, w: Words) -> dict[str, np.ndarray]:
        n, bound = len(t), w.bound
        begin, size, which = self.store.lookup(t, w)
        second = self.store.pool[begin + size - 1].astype(np.int64)
        ids, end = self.store.laid_out(begin, size - 1, which)
        ids = ids.astype(np.int64)
        ends = np.concatenate([[0], end])[bound]
        tokens = np.diff(ends)
        key = np.repeat(np.arange(n), tokens) * self.size + ids
        key, times = np.unique(key, return_counts=True)
        doc = key // self.size
        with np.errstate(divide="ignore", invalid="ignore"):
            share = times / tokens[doc]
            entropy = np.bincount(doc, -share * np.log2(share), n).astype(float)
            byte = np.bincount(doc, times * self.is_byte[key % self.size], n).astype(float)
        twos = np.concatenate([[0], np.cumsum(second[which])])[bound]
        return {"tokens": tokens, "second": np.diff(twos), "bytes": byte, "entropy": entropy}


def base_counts(t: Texts, w: Words) -> dict[str, np.ndarray]:
    n = len(t)
    words = np.diff(w.bound)
    in_word = ~np.isin(t.buf, np.frombuffer(SPACES, np.uint8))
    chars = per_text(in_word & ((t.buf & 0xC0) != 0x80), t)
    symbols = per_text(_SYMBOL[t.buf], t)
    scripts = np.stack([per_text(_SCRIPT[t.buf] == k, t) for k in range(len(SCRIPTS))], axis=1)
    h = hash_words(t, w)
    s, at = grams(h, w, WINDOW)
    key = mix(s + w.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    again = np.zeros(len(key) + 1, bool)
    again[1:-1] = same
    twice = order[again[1:] | again[:-1]] if len(key) else order
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + WINDOW, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    repeat = covered[w.bound[1:]] - covered[w.bound[:-1]]
    dup = np.zeros(n, np.int64)
    for i in range(n):
        lines = [x for x in t.text(i).split(b"\n") if x.strip(SPACES)]
        dup[i] = len(lines) - len(set(lines))
    return {"n_words": words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat, "scripts": scripts}


#: A parabola in the logarithm of the number of tokens, fitted on the rows as BANDS were.
USUAL = (0.23, 1.147, -0.05)


def usual_entropy(tokens: np.ndarray) -> np.ndarray:
    """The entropy of clean text of so many tokens."""
    x = np.log2(np.clip(tokens, 1, 4096))
    return USUAL[0] + USUAL[1] * x + USUAL[2] * x * x


_made: dict[tuple[str, str], Fertility] = {}


def verdicts(fertility: Fertility, t: Texts, langs: pa.Array, bands: dict[str, Band]) -> list[pa.Array]:
    """The measures of some texts."""
    w = find_words(t)
    b = base_counts(t, w)
    m = fertility.measure(t, w)
    scripts = np.array(SCRIPTS, object)[b["scripts"].argmax(axis=1)]
    scripts[b["scripts"].sum(axis=1) == 0] = "other"
    band = [x if x in bands else s for x, s in zip(langs.to_pylist(), scripts, strict=True)]
    low = {f: np.array([getattr(bands[x], f) for x in band]) for f in Band.__dataclass_fields__}
    tokens = np.maximum(m["tokens"], 1)
    chars, chars2 = b["word_chars"] / tokens, b["word_chars"] / np.maximum(m["second"], 1)
    share = m["bytes"] / tokens
    long = m["tokens"] >= low["least_tokens"]
    evenness = m["entropy"] / np.maximum(np.log2(np.maximum(tokens, 2)), 1)
    off = m["entropy"] - usual_entropy(tokens)
    spare = np.clip(5 * (1 - tokens / low["least_tokens"]), 0, 1)  # in full under four fifths of least_tokens
    held = lambda n: n - np.minimum(SPARE_TOKENS * spare, SPARE_SHARE * n)
    good = (
        (b["word_chars"] >= low["chars_low"] * held(m["tokens"]))
        & (chars <= low["chars_high"])
        & (b["word_chars"] >= low["second_low"] * held(m["second"]))
        & (m["bytes"] - SPARE_BYTES * spare <= low["bytes_high"] * tokens)
        & (b["n_symbols"] <= low["symbols_high"] * b["word_chars"])
        & (off >= -low["entropy_below"] - SPARE_ENTROPY * spare)
        & (off <= low["entropy_above"] + SPARE_ENTROPY * spare)
        & np.where(long, m["entropy"] >= low["entropy_low"], evenness >= low["short_evenness"])
    )
    failed = (b["n_words"] < MIN_WORDS) | (100 * b["n_repeat_words"] > 20 * b["n_words"])
    made = [b["n_words"], b["word_chars"], b["n_symbols"], b["n_dup_lines"], b["n_repeat_words"], m["tokens"], chars, chars2, share, m["entropy"]]
    return [pa.array(x) for x in made] + [pa.array(band), pa.array(failed), pa.array(good & ~failed)]


def _over(first: str, second: str, bands: dict[str, Band], text_at: int, lang_at: int, keep_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (first, second) not in _made:  # one store of words for each worker process
            _made[first, second] = Fertility(first, second)
        for batch in batches:
            for t in text_slices(batch.column(text_at), 2 << 20):
                part = batch.slice(t.first, len(t))
                langs = part.column(lang_at) if lang_at >= 0 else pa.nulls(len(t), pa.string())
                found = verdicts(_made[first, second], t, langs, bands)
                if keep_only:
                    yield part.filter(found[-1])
                else:
                    rest = [c for j, c in enumerate(part.columns) if j < part.num_columns - 2]
                    yield pa.RecordBatch.from_arrays([*rest, *found], names=[f"c{j}" for j in range(len(rest))] + _NAMES)

    return run


FIRST, SECOND = "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"


def judge(docs: DataFrame, carry: list[str], first: str = FIRST, second: str = SECOND, bands: dict[str, Band] | None = None) -> DataFrame:
    """The carried columns and the measures of every row."""
    carry = [c for c in carry if c not in _NAMES]
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(*carry, F.col("text").alias("__text"), lang.alias("__lang"))
    schema = "".join(f"c{j} {docs.schema[c].dataType.simpleString()}, " for j, c in enumerate(carry))
    out = rows.mapInArrow(_over(first, second, bands or BANDS, len(carry), len(carry) + 1, False), schema + MEASURES)
    return out.toDF(*carry, *_NAMES)


#: Labelled rows that bands are fitted on at most; clean ones a language needs; the share of clean text that may lie
#: outside a bound; what a bound gives way beyond that, in characters per token and in bits; the same for a script.
FIT_ROWS, FIT_LEAST, FIT_TAIL, FIT_SLACK, FIT_SCRIPT_SLACK = 20_000, 100, 0.001, 0.02, 0.12


def fit_bands(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS, least: int = FIT_LEAST, first: str = FIRST, second: str = SECOND) -> dict[str, Band]:
    """Bands of languages and scripts, from clean rows (quality 1) of labels (doc_id, quality).

    The sample is the `most` labelled doc_ids whose hash is least, so it doesn't grow with the corpus and reruns
    agree.  Lower bounds stand FIT_SLACK under the FIT_TAIL quantile of what the clean texts of a language measure
    that pass the base rules and have enough tokens; a script takes the loosest of its languages with
    FIT_SCRIPT_SLACK.  Languages and scripts with under `least` such texts keep their band of BANDS, as do the
    other bounds; a null lang is no language; null ids and qualities are left out, and an id with two qualities
    counts as its lower; empty tables give BANDS.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).where("quality = 1").select("doc_id")
    scripts = {s: BANDS[s] for s in SCRIPTS}
    rows = judge(docs.select("doc_id", "text", "lang").join(F.broadcast(some), "doc_id"), ["lang"], first, second, scripts)
    x = F.log2(F.least(F.greatest("n_tokens", F.lit(1)), F.lit(4096)))
    off = F.col("token_entropy") - (F.lit(USUAL[0]) + F.lit(USUAL[1]) * x + F.lit(USUAL[2]) * x * x)
    clean = rows.where(~F.col("base_failed") & (F.col("n_tokens") >= Band.least_tokens) & F.col("lang").isNotNull())
    low = [F.percentile(v, F.lit(FIT_TAIL)).alias(n) for n, v in (("chars", F.col("chars_per_token")), ("second", F.col("chars_per_token_2")), ("off", off))]
    found = clean.groupBy("lang", "band").agg(F.count(F.lit(1)).alias("n"), *low).where(F.col("n") >= least)

    def bounds(rows: list, slack: float) -> dict[str, float]:
        lowest = {n: min(r[n] for r in rows) - slack for n in ("chars", "second", "off")}
        return {"chars_low": round(lowest["chars"], 2), "second_low": round(lowest["second"], 2), "entropy_below": round(-lowest["off"], 2)}

    out, by_script = dict(BANDS), {}
    for r in sorted(found.collect(), key=lambda r: (r["n"], r["lang"], r["band"])):  # a row per language and script of the sample
        out[r["lang"]] = replace(BANDS.get(r["lang"], BANDS[r["band"]]), **bounds([r], FIT_SLACK))
        by_script.setdefault(r["band"], []).append(r)
    for script, group in by_script.items():
        out[script] = replace(BANDS[script], **bounds(group, FIT_SCRIPT_SLACK))
    return out


def keep_good(docs: DataFrame, first: str = FIRST, second: str = SECOND, bands: dict[str, Band] | None = None) -> DataFrame:
    """The rows of docs that the rules keep, as they are."""
    names = docs.columns
    lang_at = names.index("lang") if "lang" in names else -1
    return docs.mapInArrow(_over(first, second, bands or BANDS, names.index("text"), lang_at, True), docs.schema)


def op1_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"), ["doc_id"])
