"""Registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.chat import ROTATE_SQL
from weftline.llm.collocations import COLLOCATIONS_SQL
from weftline.llm.common import crc_fold, table
from weftline.llm.fill_in_middle import FILL_SQL

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {"op3_perspectives": ROTATE_SQL, "op12_fill_in_middle": FILL_SQL, "op13_collocations": COLLOCATIONS_SQL}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.byte_bpe import byte_bpe

    docs = table(spark, sf_dir, "documents")
    return byte_bpe(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)


@query
def op5_id_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.common import scratch_path
    from weftline.llm.id_index import round_trip

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), scratch_path(spark, "ids"))


@query
def op2_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.mixing import mix_report

    return mix_report(table(spark, sf_dir, "documents"))


@query
def op3_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.chat import rotate_perspectives

    return rotate_perspectives(table(spark, sf_dir, "conversations"))


@query
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.quality import score, train

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc_fold("doc_id", 4) == 2
    model = train(docs, labels.where(~held_out))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.toxicity import score, train

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc_fold("doc_id", 5) == 0
    model = train(docs, labels.where(~held_out))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.secrets import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents"))


@query
def op7_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.edit_embedding import edit_fingerprints

    return edit_fingerprints(table(spark, sf_dir, "documents"))


@query
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), size=3, percent=90)


@query
def op8_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


@query
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.fill_in_middle import fill_in_middle

    return fill_in_middle(table(spark, sf_dir, "documents"), keep_text=False)


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


@query
def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))
