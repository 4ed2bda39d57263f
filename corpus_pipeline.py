"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last
return the columns of documents.  run() writes each stage's rows to the shared folder and reads them again.

Every stage gives an empty table for an empty one, takes whole texts of any length, and passes on columns that
documents don't have, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nearfold.llm import fertility, jaccard, line_runs, mixing, packing
from nearfold.llm.scratch import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the fertility bands reject go.

    A null or empty text has under 10 words and goes; a null lang takes the band of the script; a null doc_id or source
    changes nothing; repeated rows are judged alike.
    """
    return fertility.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in three documents or more stay in the last of them.

    A null or empty text stays as it is; a row with a null doc_id neither counts nor changes; rows that share a doc_id
    count each, and if it is the largest that holds a line, all of them keep it; n_chars is counted anew.
    """
    return line_runs.dedup_lines(spark, docs).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least doc_id stays.

    Documents without words stay; rows with a null doc_id stay; rows that share the least doc_id of a group all stay.
    """
    return jaccard.keep_one(spark, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the target weights draw it.

    A null source is a source of its own, last in order; a null text has no words and is drawn like others of size 0;
    documents of equal size go by doc_id; rows that share a doc_id, or have none, are drawn as often as the most drawn.
    """
    return mixing.emit_copies(spark, docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in training sequences.

    A null or empty text is its end id alone; a null doc_id stays null; copies are packed each for itself; the columns
    are doc_id, piece, start, length, ids_crc32, sequence_id and offset.
    """
    return packing.pack_documents(spark, docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]

#: Token ids decide the first and the last stage, which SQL can't express; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = scratch.save(out, f"{k}-{name}") if k + 1 < len(STAGES) else out
    return docs
