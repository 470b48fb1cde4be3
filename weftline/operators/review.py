"""Inferred edges: cleaning, the confidence gate, column retries, and the review log."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.joins import latest, sort_dedupe

#: Edge types that a proposal may have, names that stand for nothing, and prefixes taken off a name.
EDGE_TYPES = ("READS_FROM", "WRITES_TO", "TRANSFORMS_TO", "EXECUTES")
PLACEHOLDERS = ("", "UNKNOWN", "N/A", "NONE", "NULL", "?", "*")
PREFIX = "(?i)^(table|file|program|job):"


class Provider(Protocol):
    """Proposes edges for constructs (construct_id, snippet) as rows of construct_id, source_entity, target_entity, edge_type, conf."""

    def propose(self, constructs: DataFrame) -> DataFrame: ...


class OfflineProvider:
    """Reads ``INSERT INTO t`` and ``FROM t`` names off the snippet itself; no network."""

    def propose(self, constructs: DataFrame) -> DataFrame:
        target = F.upper(F.regexp_extract("snippet", r"(?i)insert\s+into\s+([\w.]+)", 1))
        source = F.upper(F.regexp_extract("snippet", r"(?i)\bfrom\s+([\w.]+)", 1))
        return constructs.select("construct_id", source.alias("source_entity"), target.alias("target_entity"), F.lit("WRITES_TO").alias("edge_type"), F.when((source != "") & (target != ""), 70).otherwise(0).alias("conf"))


def cleaned(proposals: DataFrame) -> DataFrame:
    """Valid proposals with bare upper-case names, once for each (source, target, type): that of the first construct."""
    bare_name = lambda c: F.upper(F.trim(F.regexp_replace(F.trim(F.col(c)), PREFIX, "")))
    bare = proposals.select(bare_name("source_entity").alias("source"), bare_name("target_entity").alias("target"), "edge_type", "construct_id", "conf")
    bare = bare.where(F.col("edge_type").isin(*EDGE_TYPES) & ~F.col("source").isin(*PLACEHOLDERS) & ~F.col("target").isin(*PLACEHOLDERS))
    return sort_dedupe(bare, ["source", "target", "edge_type"], [F.col("construct_id")])


def gated(proposals: DataFrame, threshold: float) -> DataFrame:
    """Proposals whose judged confidence reaches the threshold; a failed judgement (null) counts as 0."""
    return proposals.where(F.coalesce("conf", F.lit(0)) >= threshold).withColumn("status", F.lit("PROVISIONAL"))


def with_columns(accepted: DataFrame, mappings: DataFrame, retried: DataFrame) -> DataFrame:
    """Mappings of accepted edges; those of WRITES_TO without any take the retry's. Mappings with an empty end are dropped.

    accepted: construct_id, edge_type; mappings and retried: construct_id, source_column, target_column.
    """
    named = lambda m: m.where("coalesce(source_column, '') <> '' and coalesce(target_column, '') <> ''")
    first = named(mappings).join(accepted.select("construct_id"), "construct_id", "left_semi")
    lacking = accepted.where("edge_type = 'WRITES_TO'").join(first.select("construct_id").distinct(), "construct_id", "left_anti")
    return first.unionByName(named(retried).join(lacking.select("construct_id"), "construct_id", "left_semi"))


def reviewed(edges: DataFrame, log: DataFrame) -> DataFrame:
    """Edges under the latest verdict of an append-only log (event_id, edge_id, verdict, ts)."""
    last = latest(log.select("edge_id", "verdict", "ts", "event_id"), ["edge_id"], [F.col("ts"), F.col("event_id")]).select("edge_id", "verdict")
    return edges.join(last, "edge_id", "left").select("edge_id", F.coalesce("verdict", "status").alias("status"))
