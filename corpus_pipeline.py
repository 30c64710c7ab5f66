"""Corpus pipeline: raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``.  All stages but the last
return the columns they got.

    language   rows that language identification rejects go (no letter, or a
               posterior under a half; without labels to learn from: no letter)
    near_dups  one document of each group of near-duplicates stays
               (five-word shingles, similarity 0.8)
    secrets    secrets become a mask; n_chars, if there, follows
    mixture    documents repeat or go so that sources reach their weights
    packing    sequences of 1024 tokens, one row per piece

Empty inputs give empty outputs of the same columns.  ORACLE_SQL is None: hashed
n-grams, entropy windows and tokenisation are not SQL; the tests hold the stages
against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import lang_id, minhash, mixing, packing, queries, secret_scan
from quire.session import materialize
from quire.sources.tables import table

ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lang_id.detect(docs, queries.language_model(docs), reject=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.dedup(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs, length="n_chars")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, **queries.tokenizer_files())


STAGES = [("language", language), ("near_dups", near_duplicates), ("secrets", secrets),
          ("mixture", mixture), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
