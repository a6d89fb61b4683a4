"""The corpus pipeline: language ID, line dedup, near-duplicate removal, packing.

Each stage works on the documents that its predecessor kept. All but the last return the columns of
``documents``; the last returns one row per packed piece.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.langid import fit, predicted
from tidemark.llm.line_dedup import without_duplicate_lines
from tidemark.llm.packing import pack_documents
from tidemark.llm.shared import free_name, staged
from tidemark.llm.simhash_dedup import one_of_each
from tidemark.llm.tokens import default_path

#: A document whose likeliest language has less posterior probability than this is rejected.
LEAST_SCORE = 0.5
#: So is one whose letters are, on average, less likely than its language's by more than so many nats.
MOST_BELOW = 3.0


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns the languages from the labelled documents; those without a clear language go.

    Where no document is labelled there is nothing to judge by: every document with a letter stays. Null texts and
    those without a letter go; repeated rows fare alike; an empty table stays empty; other columns go along.
    """
    model = fit(docs, default_path("piece_bpe_32k.model"))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    own = free_name(docs, "_language")
    told = docs.withColumn(own, predicted(F.col("text"), model, spark))
    clear = (F.col(own)["score"] >= LEAST_SCORE) & (F.col(own)["below"] <= MOST_BELOW)
    return told.where((F.col(own)["lang"] != "und") & clear).drop(own)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines that an earlier line matches; documents of which no word is left go.

    Rows repeated in id and text are one document, and each stays; null ids come first; null and empty texts
    stay as they are; an empty table stays empty; other columns go along, n_chars, if there is one, is counted anew.
    """
    kept = without_duplicate_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else kept


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of every group linked by Jaccard 0.8 or more of five-word shingles: that of the smallest id.

    Candidates are pairs that share a key of minima of their shingles; pivot distances and SimHash fingerprints
    discard those that are too far apart, and the shingle sets confirm a link.

    Rows repeated in id and text are one document; of a group without ids one row stays. Null and wordless texts
    are alike. An empty table stays empty; other columns go along.
    """
    return one_of_each(docs, width=5)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all that is left, one row for each piece; null text is the end id alone, repeated rows are packed as often as they come."""
    return pack_documents(docs, default_path("word_bpe_49k.json"), room=4096)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: The stages fit a language model, join word sets by similarity, merge fingerprints and pack bins:
#: SQL can't express them. tests/llm/test_pipeline.py holds the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
