"""Proposals, their gate and the review queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import inference as N
from weftline.operators import review as R
from weftline.plans.registry import registered
from weftline.session import table

PROPOSALS_SQL = """p AS (SELECT o_orderkey AS construct_id, CASE o_orderkey % 4 WHEN 0 THEN 'table:T' WHEN 1 THEN 'FILE:T' WHEN 2 THEN 'unknown' ELSE 'T' END || CASE WHEN o_orderkey % 4 = 2 THEN '' ELSE (o_custkey % 50)::VARCHAR END AS source_entity,
  'File:F' || (o_custkey % 7) AS target_entity, CASE o_orderkey % 9 WHEN 8 THEN 'COPIES' ELSE 'WRITES_TO' END AS edge_type, (o_orderkey * 13 % 100)::INTEGER AS conf FROM orders),
c AS (SELECT construct_id, upper(regexp_replace(source_entity, '^(?i:table|file|program|job):', '')) AS source, upper(regexp_replace(target_entity, '^(?i:table|file|program|job):', '')) AS target, edge_type, conf FROM p
  WHERE edge_type IN ('READS_FROM', 'WRITES_TO', 'TRANSFORMS_TO', 'EXECUTES') AND upper(source_entity) NOT IN ('', 'UNKNOWN', 'N/A', 'NONE', 'NULL', '?')),
k AS (SELECT source, target, edge_type, min(construct_id) AS construct_id, arg_min(conf, construct_id) AS conf FROM c GROUP BY 1, 2, 3)"""


def proposals(spark, sf_dir):
    kind = (F.col("o_orderkey") % 4).cast("int")
    source = F.when(kind == 2, F.lit("unknown")).otherwise(F.concat(F.get(F.array(*[F.lit(x) for x in ("table:T", "FILE:T", "", "T")]), kind), F.col("o_custkey") % 50))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("construct_id"), source.alias("source_entity"), F.concat(F.lit("File:F"), F.col("o_custkey") % 7).alias("target_entity"),
        F.when(F.col("o_orderkey") % 9 == 8, "COPIES").otherwise("WRITES_TO").alias("edge_type"), (F.col("o_orderkey") * 13 % 100).cast("int").alias("conf"),
    )


@registered(f"WITH {PROPOSALS_SQL} SELECT source, target, edge_type, construct_id, conf FROM k")
def proposal_clean(spark, sf_dir):
    return R.cleaned(proposals(spark, sf_dir))


@registered(f"WITH {PROPOSALS_SQL} SELECT source, target, edge_type, construct_id, conf, 'PROVISIONAL' AS status FROM k WHERE conf >= 60")
def proposal_gate(spark, sf_dir):
    return R.gated(R.cleaned(proposals(spark, sf_dir)), 60)


@registered(f"WITH {PROPOSALS_SQL} SELECT conf // 10 * 10 AS band, count(*) AS n, count(*) FILTER (WHERE conf >= 60) AS n_kept FROM k GROUP BY 1")
def threshold_report(spark, sf_dir):
    c = R.cleaned(proposals(spark, sf_dir))
    return c.groupBy(F.expr("cast(conf div 10 * 10 as int)").alias("band")).agg(F.count("*").alias("n"), F.count_if(F.col("conf") >= 60).alias("n_kept"))


REVIEW_SQL = """e AS (SELECT o_orderkey AS edge_id, CASE WHEN o_orderkey % 3 = 0 THEN 'PROVISIONAL' ELSE 'CONFIRMED' END AS status FROM orders),
log AS (SELECT event_id, user_id AS edge_id, CASE WHEN event_id % 2 = 0 THEN 'CONFIRMED' ELSE 'REJECTED' END AS verdict, ts FROM events),
l AS (SELECT edge_id, arg_max(verdict, (ts, event_id)) AS verdict FROM log GROUP BY edge_id)"""


def _review(spark, sf_dir):
    e = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("edge_id"), F.when(F.col("o_orderkey") % 3 == 0, "PROVISIONAL").otherwise("CONFIRMED").alias("status"))
    log = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("edge_id"), F.when(F.col("event_id") % 2 == 0, "CONFIRMED").otherwise("REJECTED").alias("verdict"), "ts")
    return e, log


@registered(f"WITH {REVIEW_SQL} SELECT e.edge_id, coalesce(verdict, status) AS status FROM e LEFT JOIN l USING (edge_id)")
def review_latest_wins(spark, sf_dir):
    return R.reviewed(*_review(spark, sf_dir))


@registered(f"WITH {REVIEW_SQL} SELECT e.edge_id FROM e LEFT JOIN l USING (edge_id) WHERE coalesce(verdict, status) = 'PROVISIONAL'")
def provisional_queue(spark, sf_dir):
    return R.reviewed(*_review(spark, sf_dir)).where("status = 'PROVISIONAL'").select("edge_id")


@registered(f"WITH {REVIEW_SQL} SELECT e.edge_id || '>' || c AS column_edge_id, coalesce(verdict, status) AS status FROM e LEFT JOIN l USING (edge_id), (VALUES ('A'), ('B')) t(c)")
def review_cascade(spark, sf_dir):
    e, log = _review(spark, sf_dir)
    columns = e.select(F.col("edge_id").alias("parent_edge_id"), F.explode(F.array(F.lit("A"), F.lit("B"))).alias("c"))
    done = columns.join(R.reviewed(e, log), F.col("parent_edge_id") == F.col("edge_id"))
    return done.select(F.concat("parent_edge_id", F.lit(">"), "c").alias("column_edge_id"), "status")


class _ByOrder:
    """Answers that follow from an order's key, in place of a hosted model."""

    name, model = "by-order", "arithmetic"

    def __init__(self, orders):
        self.orders = orders

    def propose(self, constructs):
        k = F.col("o_orderkey")
        mapped = F.array(F.struct(F.lit("A").alias("source_column"), F.lit("B").alias("target_column"), F.lit(None).cast("string").alias("transformation")))
        return self.orders.select(k.alias("construct_id"), F.lit(0).alias("pos"), F.concat(F.lit("table:S"), F.col("o_custkey") % 50).alias("source_entity"), F.lit("Table").alias("source_kind"), F.concat(F.lit("T"), F.col("o_custkey") % 7).alias("target_entity"), F.when(k % 2 == 0, "File").otherwise("Table").alias("target_kind"), F.when(k % 9 == 8, "COPIES").when(k % 3 == 0, "READS_FROM").alias("edge_type"), F.when(k % 4 == 0, mapped).cast(N.MAPPINGS).alias("mappings"), F.lit("why").alias("reasoning"), F.lit(0.5).alias("self_confidence"))

    def judge(self, proposals):
        return proposals.where("construct_id % 11 <> 0").select(*N.KEY, (F.col("construct_id") * 13 % 100 / 100).alias("confidence"), F.lit("ok").alias("rationale"))

    def columns(self, proposals):
        return proposals.where("construct_id % 5 = 0").select(*N.KEY, F.array(F.struct(F.lit("C").alias("source_column"), F.lit("D").alias("target_column"), F.lit("C").alias("transformation"))).cast(N.MAPPINGS).alias("mappings"))


@registered(
    """WITH p AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'READS_FROM' ELSE 'WRITES_TO' END AS edge_type, 'PROGRAM:ORD' || o_orderkey AS program, 'TABLE:S' || o_custkey % 50 AS s,
  CASE WHEN o_orderkey % 2 = 0 THEN 'FILE' ELSE 'TABLE' END || ':T' || o_custkey % 7 AS t FROM orders WHERE o_orderkey % 9 <> 8 AND o_orderkey % 11 <> 0 AND o_orderkey * 13 % 100 >= 60)
SELECT CASE WHEN edge_type = 'READS_FROM' THEN s ELSE program END AS source_id, CASE WHEN edge_type = 'READS_FROM' THEN program ELSE t END AS target_id, edge_type, 'PROVISIONAL' AS status,
  (k * 13 % 100 / 100)::DOUBLE AS confidence, CASE WHEN k % 4 = 0 THEN 'A>B' WHEN edge_type = 'WRITES_TO' AND k % 5 = 0 THEN 'C>D' END AS mapping FROM p"""
)
def inferred_edges(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    constructs = orders.select(F.col("o_orderkey").alias("construct_id"), F.concat(F.lit("ord"), "o_orderkey").alias("program"), F.lit("DYNAMIC_SQL").alias("construct_type"), F.lit("/o").alias("path"), F.lit(1).alias("line"), F.col("o_orderpriority").alias("snippet"), F.lit("").alias("context"))
    provider = _ByOrder(orders)
    edges, columns = N.emitted(N.infer(constructs, provider, 0.6), provider)
    ends = ["source_id", "target_id", "edge_type"]
    return edges.join(columns.select(*ends, F.concat_ws(">", "source_column", "target_column").alias("mapping")), ends, "left").select(*ends, "status", "confidence", "mapping")
