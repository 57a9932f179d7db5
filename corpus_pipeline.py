"""The corpus pipeline: five stages over documents, each a written table that the next one reads.

Defined cases, for all stages: an empty table gives an empty table; columns beside those of documents are kept, whatever
their names (the last stage has columns of its own); ids are whole numbers, and a null id is no other row's id; repeated
rows are repeated documents. A null or empty text is rejected by the first stage; to the others it is a text without words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerflow.llm import mixing, pieces, quality, simhash, substrings
from ledgerflow.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the forest reject go; without labels, the rules alone decide. Texts of any length are read
    whole; of equal rows all go or all stay."""
    return quality.filtered(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id (one row of it, if the id repeats). Of
    rows without an id one of each text stays, if no document with an id is in their group or not. Texts without words are
    one group."""
    return simhash.deduplicated(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words and more that start earlier as well are cut from the texts; a document may be left without words.
    Equal rows count as one document; texts under 20 words stay as they are, as do null ones."""
    return substrings.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes: a row for each document and pass over its source. Documents without words, and those that
    the mix takes nothing of, have none; a null source is a source."""
    return mixing.mixed_documents(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, round_trip; a null or empty text has no ids."""
    return pieces.encoded(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("sentencepiece", sentencepiece),
]

#: Forests, components and piece merges are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
