"""A corpus from documents to tokens: five stages, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir), docs with the columns of documents, and returns these columns; the last one returns
doc_id, n_tokens, token_ids and round_trip. Null, empty and repeated rows are treated as the operators' docstrings say, and
columns beside those of documents go along untouched. A stage's table is dropped once the next one is written, with all that stage made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import bpe, langid, mixing, pii, simhash
from quire.llm.common import drop_dir, made, materialize, table
from quire.session import ship


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; lang is the language found, the others go."""
    ship(spark)
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    ship(spark)
    return simhash.drop_near_duplicates(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, private data replaced by its kind; n_chars follows."""
    ship(spark)
    return pii.redact_pii(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture's budgets take them."""
    ship(spark)
    return mixing.mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    ship(spark)
    return bpe.encode_documents(docs)


STAGES = [("language_id", language), ("near_duplicates", near_duplicates), ("pii", private_data), ("mixing", mixture), ("bpe", tokens)]

ORACLE_SQL = None
"""Trained models, fingerprints and byte-pair merges aren't expressible in SQL; tests hold run() against brute force."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with made() as folders:
            docs, at = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        for folder in [*folders, before]:
            if folder and folder != at:
                drop_dir(spark, folder)
        before = at
    return STAGES[-1][1](spark, docs, sf_dir)
