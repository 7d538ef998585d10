"""Corpus pipeline: raw documents to a mixed, tokenised training set.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows that its predecessor
kept, and returns a DataFrame that is written as Parquet and read again as the next
one's ``docs``. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm.common import read, stored
from tickloom.llm.exact_dedup import keep_first
from tickloom.llm.language_id import keep_identified
from tickloom.llm.mixing import mix
from tickloom.llm.near_dedup import keep_one
from tickloom.llm.sentence_pieces import encode, token_digest


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null, or no letter) go."""
    return keep_identified(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the smallest doc_id stays."""
    return keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, the smallest doc_id stays. The stage before has
    left one row of equal texts."""
    return keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are cut or repeated to their target weights; a document has one row
    for each time it is taken."""
    return mix(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, with their number and digest."""
    return token_digest(encode(docs.select("doc_id", "lang", "source", "text")))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentence_pieces", tokenise),
]

#: Language ID, near-duplicate classes and token ids are beyond SQL; the result is
#: tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
