"""TF-IDF vectors over a frozen vocabulary, as sparse rows (chunk_id, term_index, w) or packed, a row a chunk.

The vocabulary has a fixed number of terms, so every task has all of it and a chunk is embedded where it is read,
without a shuffle.  Only its making groups terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.tokens import token_slices

SIZE = 1536


def tokens(chunks: DataFrame) -> DataFrame:
    """(chunk_id, terms) of chunks (id, code)."""
    return chunks.select(F.col("id").alias("chunk_id"), X.tokenize(F.col("code")).alias("terms"))


def term_counts(chunks: DataFrame) -> DataFrame:
    """(chunk_id, term, n, total): n of total tokens are the term."""
    x = tokens(chunks).select("chunk_id", F.size("terms").alias("total"), F.explode("terms").alias("term"))
    return x.groupBy("chunk_id", "term").agg(F.count(F.lit(1)).alias("n"), F.first("total").alias("total"))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, row, tokens in token_slices(batch.column(0)):
            coded = tokens.dictionary_encode()
            width = max(1, len(coded.dictionary))
            each = np.unique(row * width + coded.indices.to_numpy()) % width
            df = np.bincount(each, minlength=len(coded.dictionary))
            yield pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.string()), pa.array(df.astype(np.int64))], names=["term", "df"])


def document_frequency(chunks: DataFrame) -> DataFrame:
    """(term, df): in how many chunks the term is."""
    each = chunks.select(F.lower("code").alias("code")).mapInArrow(_frequencies, "term string, df bigint")
    return each.groupBy("term").agg(F.sum("df").alias("df"))


def build_vocabulary(chunks: DataFrame, size: int = SIZE) -> DataFrame:
    """(term, term_index, df, idf) of the most frequent terms; ties go by term, so reruns agree."""
    n = chunks.agg(F.count(F.lit(1)).alias("n_chunks"))
    top = document_frequency(chunks).orderBy(F.col("df").desc(), "term").limit(size)
    order = W.orderBy(F.col("df").desc(), "term")  # at most `size` rows
    ranked = top.withColumn("term_index", (F.row_number().over(order) - 1).cast("int")).crossJoin(F.broadcast(n))
    return ranked.select("term", "term_index", "df", F.log(F.col("n_chunks").cast("double") / F.col("df")).alias("idf"))


def embed(chunks: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(chunk_id, ti, tw): vectors of unit length, terms ascending; a chunk without weight has no row."""
    known = sorted((r["term_index"], r["term"], r["idf"]) for r in vocabulary.select("term", "term_index", "idf").collect())  # SIZE rows at most
    index = np.array([k for k, _, _ in known], np.int64)
    idf = np.array([x for _, _, x in known])
    terms = pa.array([t for _, t, _ in known], pa.large_string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n_texts, where, tokens in token_slices(batch.column(1)):
                total = np.bincount(where, minlength=n_texts)
                at = pc.index_in(tokens, terms)
                found = at.is_valid().to_numpy(zero_copy_only=False)
                key, n = np.unique(where[found] * max(1, len(idf)) + at.drop_null().to_numpy().astype(np.int64), return_counts=True)
                row, term = np.divmod(key, max(1, len(idf)))
                w = n / total[row] * idf[term]
                row, term, w = row[w > 0], term[w > 0], w[w > 0]
                w = w / np.sqrt(np.bincount(row, w * w, n_texts))[row]
                size = np.bincount(row, minlength=n_texts)
                some = np.flatnonzero(size)
                edge = pa.array(np.concatenate([[0], np.cumsum(size[some])]), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first + some)), pa.ListArray.from_arrays(edge, pa.array(index[term], pa.int32())), pa.ListArray.from_arrays(edge, pa.array(w))], names=["chunk_id", "ti", "tw"])

    return chunks.select(F.col("id").cast("bigint").alias("chunk_id"), F.lower("code").alias("code")).mapInArrow(run, "chunk_id bigint, ti array<int>, tw array<double>")


def unpacked(packed: DataFrame) -> DataFrame:
    """(chunk_id, term_index, w) of packed vectors."""
    return packed.select("chunk_id", F.inline(F.arrays_zip(F.col("ti").alias("term_index"), F.col("tw").alias("w"))))


def weights(chunks: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(chunk_id, term_index, w) of unit length; a chunk without weight has no rows."""
    return unpacked(embed(chunks, vocabulary))


def vectors(sparse: DataFrame) -> DataFrame:
    """(chunk_id, ti, tw) of (chunk_id, term_index, w), terms ascending; the engine stores vectors in this form."""
    terms = F.sort_array(F.collect_list(F.struct("term_index", "w")))
    x = sparse.groupBy("chunk_id").agg(terms.alias("v"))
    return x.select("chunk_id", F.col("v.term_index").alias("ti"), F.col("v.w").alias("tw"))


def all_vectors(chunks: DataFrame, sparse: DataFrame) -> DataFrame:
    """As vectors, with an empty one for each chunk without weight."""
    x = vectors(sparse)
    none = chunks.select(F.col("id").alias("chunk_id")).join(x, "chunk_id", "left_anti")
    return x.unionByName(none.select("chunk_id", F.array().cast("array<int>").alias("ti"), F.array().cast("array<double>").alias("tw")))
