"""A corpus in five stages: language ID, exact dedup, near-duplicate removal, mixing, packing.

Every stage but the last returns the columns of its input, whatever they are called. Empty input: empty result. Null texts
count as empty, null ids are ids like others, rows that are repeated are copies (the second stage keeps one).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexigrove.llm import exact_dedup, language_id, mixing, ngram_join, packing
from lexigrove.llm.common import documents, materialise


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not rejected; learned from the labelled documents that came in.

    Texts without a letter, null ones among them, are rejected; ties between languages go to the first in code point order.
    Without any label all are rejected.
    """
    return language_id.accepted(docs, language_id.learn(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with identical texts, the one with the largest id; of rows that repeat id and text one, of null ids the others."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more of their five-word runs, the one with the smallest id.

    Texts without a word are linked with none and stay.
    """
    return ngram_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; a null source is one of its own, rows of equal keys go by id."""
    return mixing.take(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids with their sequences and offsets; an empty text is the end id alone, copies are packed each."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack),
]

#: SQL has no compression, no MinHash join and no seeded sampling as these stages have them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written as Parquet and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
