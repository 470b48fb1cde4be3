"""Corpus pipeline: quality, near-duplicates, secrets, mixing and encoding, one stage after another.

Every stage takes the documents that its predecessor kept and writes Parquet in the folder
that all executors share, so a lost executor costs work of one stage only.

Stages and their decisions:

- quality: documents that score below 0.7 go; the classifier learns from the rows of
  ``labels`` that the query of the operator may learn from as well;
- near_duplicates: of documents linked by five-word shingles with a Jaccard similarity of 0.8
  or more, the one with the least id stays;
- secrets: findings are replaced in the text and ``n_chars`` follows;
- mixing: documents are repeated or left out so that sources come to their target weights;
- encoding: byte-level BPE ids of every text, decoded again; returns a row for each document.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from weftline.llm import byte_bpe, jaccard_join, mixing, quality, secrets
from weftline.llm.common import crc_fold, settle, table

#: Score from which a document stays.
QUALITY = 0.7


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(crc_fold("doc_id", 4) != 2)
    return quality.keep_good(docs, quality.train(docs, labels), QUALITY)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs, size=5, percent=80)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_secrets(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.byte_bpe(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        # what a stage has written on its way is deleted once its rows are written
        docs = settle(functools.partial(stage, spark, docs, sf_dir), spark, f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: A trained classifier and a prefix tree have no SQL form; tests/llm hold the stages against brute force.
ORACLE_SQL = None
