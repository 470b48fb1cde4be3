"""Inferred edges as a table of states: proposals are resolved, judged, asked for columns once and emitted with their audit.

Every proposal of every construct is one row with a state. A round takes all rows that wait for the same
answer to the provider at once, joins the answers back and moves each row on by one rule:

- ``PROPOSED`` waits for the judge: below the threshold ``DROPPED`` (no answer counts as 0); a ``WRITES_TO`` without a
  named column mapping goes to ``ASKED``, all others to ``READY``;
- ``ASKED`` waits for columns, once: ``READY`` with those that the answer names, if any;
- ``READY`` is emitted as a provisional edge.

There are at most three rounds, however many proposals. With a folder, the rows are stored after each round under its
number; a run that finds rounds there goes on from the last one, without asking again what was answered.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from weftline.operators.review import PLACEHOLDERS, PREFIX
from weftline.operators.sink import exists
from weftline.session import settled

MAPPINGS = "array<struct<source_column:string,target_column:string,transformation:string>>"
KEY = ["construct_id", "source_entity", "target_entity", "edge_type"]
#: Edge types that an inferred edge can have, and the length of a prompt that is kept.
INFERRED = ("READS_FROM", "WRITES_TO")
PROMPT = 1500
ROUNDS = 3


class Asked(Protocol):
    """A provider answers for whole tables. Rows it has no answer for may be missing; of several for a key, the least counts."""

    name: str
    model: str

    def propose(self, constructs: DataFrame) -> DataFrame:
        """construct_id, pos, source_entity, source_kind, target_entity, target_kind, edge_type, mappings, reasoning, self_confidence."""

    def judge(self, proposals: DataFrame) -> DataFrame:
        """KEY, confidence, rationale."""

    def columns(self, proposals: DataFrame) -> DataFrame:
        """KEY, mappings."""


def _is_named(name: Column) -> Column:
    return ~F.coalesce(F.upper(F.trim(name)), F.lit("")).isin(*PLACEHOLDERS)


def named_mappings(mappings: Column) -> Column:
    """Mappings with a name at both ends, none instead of null."""
    kept = F.filter(mappings, lambda m: _is_named(m["source_column"]) & _is_named(m["target_column"]))
    return F.coalesce(kept, F.array().cast(MAPPINGS))


def proposed(constructs: DataFrame, proposals: DataFrame) -> DataFrame:
    """The first state: proposals of a known type whose anchor has a name, each once for a construct (the first by pos).

    The anchor of WRITES_TO, also of an edge without a type, is the target, of READS_FROM the source. constructs:
    construct_id, program, construct_type, path, line, snippet, context.
    """
    bare = lambda c: F.regexp_replace(F.trim(F.col(c)), PREFIX, "")
    kind = F.coalesce("edge_type", F.lit("WRITES_TO"))
    p = proposals.withColumns({"edge_type": kind, "source_entity": F.upper(bare("source_entity")), "target_entity": F.upper(bare("target_entity"))})
    writes = F.col("edge_type") == "WRITES_TO"
    p = p.withColumns({"anchor": F.when(writes, F.col("target_entity")).otherwise(F.col("source_entity")), "anchor_kind": F.when(writes, F.col("target_kind")).otherwise(F.col("source_kind"))})
    p = p.where(F.col("edge_type").isin(*INFERRED) & _is_named(F.col("anchor"))).withColumns({c: F.coalesce(c, F.lit("")) for c in ("source_entity", "target_entity")})
    p = p.withColumn("rank_", F.row_number().over(W.Window.partitionBy(*KEY).orderBy("pos", F.to_json("mappings")))).where("rank_ = 1").drop("rank_")
    prompt = F.left(F.concat_ws("\n", "program", "construct_type", "snippet", "context"), F.lit(PROMPT))
    own = constructs.select("construct_id", "program", "construct_type", "path", "line", "snippet", prompt.alias("prompt"))
    none = F.lit(None)
    return p.join(own, "construct_id").select(*KEY, "anchor", "anchor_kind", "mappings", "reasoning", "self_confidence", "program", "construct_type", "path", "line", "snippet", "prompt", F.lit("PROPOSED").alias("state"), none.cast("double").alias("confidence"), none.cast("string").alias("rationale"), F.lit(False).alias("asked"))


def advanced(rows: DataFrame, provider: Asked, threshold: float) -> DataFrame:
    """All rows after one round: what waits is answered for and moved on, the rest stays."""
    once = lambda df, value: df.groupBy(*KEY).agg(F.min(value).alias("answer"))
    waiting, asked = rows.where("state = 'PROPOSED'"), rows.where("state = 'ASKED'")
    verdicts = once(provider.judge(waiting), F.struct("confidence", "rationale"))
    confidence = F.coalesce(F.col("answer.confidence"), F.lit(0.0))
    lacks = (F.col("edge_type") == "WRITES_TO") & (F.size(named_mappings(F.col("mappings"))) == 0)
    judged = waiting.join(verdicts, KEY, "left").withColumns({"confidence": confidence, "rationale": F.coalesce("answer.rationale", F.lit("no answer"))})
    judged = judged.withColumn("state", F.when(F.col("confidence") < threshold, "DROPPED").when(lacks, "ASKED").otherwise("READY"))
    found = once(provider.columns(asked), F.col("mappings"))
    told = asked.join(found, KEY, "left").withColumns({"mappings": named_mappings(F.col("answer")), "asked": F.lit(True), "state": F.lit("READY")})
    stay = rows.where("state in ('DROPPED', 'EMITTED')").unionByName(rows.where("state = 'READY'").withColumn("state", F.lit("EMITTED")))
    return stay.unionByName(judged.select(*rows.columns)).unionByName(told.select(*rows.columns))


def infer(constructs: DataFrame, provider: Asked, threshold: float = 0.6, folder: str | None = None) -> DataFrame:
    """The last state of every proposal: DROPPED or EMITTED."""
    spark = constructs.sparkSession

    def kept(k: int, make) -> DataFrame:
        if folder is None:
            return settled(make())
        path = f"{folder}/round-{k}"
        if not exists(spark, f"{path}/_SUCCESS"):  # a round that was cut short is made again
            make().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    rows = kept(0, lambda: proposed(constructs, provider.propose(constructs)))
    for k in range(1, ROUNDS + 1):
        rows = kept(k, lambda rows=rows: advanced(rows, provider, threshold))
    return rows


def emitted(rows: DataFrame, provider: Asked) -> tuple[DataFrame, DataFrame]:
    """Edges of emitted proposals with their audit, and their column mappings.

    edges: source_id, target_id, edge_type, program, status, provenance, confidence, reasoning, evidence, audit (JSON);
    columns: source_id, target_id, edge_type, program, source_column, target_column, transformation.
    """
    done = rows.where("state = 'EMITTED'")
    entity = F.concat(F.when(F.lower(F.coalesce("anchor_kind", F.lit(""))) == "file", "FILE:").otherwise("TABLE:"), "anchor")
    program, writes = F.upper(F.concat(F.lit("PROGRAM:"), "program")), F.col("edge_type") == "WRITES_TO"
    done = done.withColumns({"source_id": F.when(writes, program).otherwise(entity), "target_id": F.when(writes, entity).otherwise(program), "confidence": F.round("confidence", 2)})
    audit = F.to_json(F.struct(F.lit(provider.name).alias("provider"), F.lit(provider.model).alias("model"), "construct_id", "construct_type", F.concat_ws(":", "path", "line").alias("source"), "prompt", "self_confidence", F.col("confidence").alias("judge_confidence"), F.col("rationale").alias("judge_rationale"), F.col("asked").alias("columns_asked")))
    evidence = F.concat_ws(" | ", "snippet", "reasoning", "rationale")
    ends = ["source_id", "target_id", "edge_type", "program"]
    edges = done.select(*ends, F.lit("PROVISIONAL").alias("status"), F.lit("INFERRED").alias("provenance"), "confidence", "reasoning", evidence.alias("evidence"), audit.alias("audit"))
    columns = done.select(*ends, F.explode(named_mappings(F.col("mappings"))).alias("m"))
    return edges, columns.select(*ends, "m.source_column", "m.target_column", F.coalesce("m.transformation", F.lit("inferred")).alias("transformation"))
