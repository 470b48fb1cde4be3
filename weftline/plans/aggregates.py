"""Aggregation, window, sort and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import window as W

from weftline.operators import joins as J
from weftline.plans.registry import registered
from weftline.session import table

MONEY = "decimal(15,2)"
AS_OF = "2024-06-30"


@registered(
    """SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderpriority) AS n_priorities, sum(o_totalprice::DECIMAL(15,2))::DECIMAL(25,2) AS total, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date,
sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice::DECIMAL(15,2) ELSE 0 END)::DECIMAL(25,2) AS closed_total FROM orders GROUP BY o_custkey"""
)
def account_summary(spark, sf_dir):
    m = F.col("o_totalprice").cast(MONEY)
    closed = F.sum(F.when(F.col("o_orderstatus") == "F", m).otherwise(F.lit(0).cast(MONEY))).cast("decimal(25,2)")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_distinct("o_orderpriority").alias("n_priorities"), F.sum(m).cast("decimal(25,2)").alias("total"), F.min("o_orderdate").alias("first_date"), F.max("o_orderdate").alias("last_date"), closed.alias("closed_total"))


@registered("SELECT CAST(ts AS DATE) AS load_date, event_type, count(*) AS n_rows, count(*) FILTER (WHERE value < 10) AS n_small FROM events GROUP BY ALL")
def load_audit(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("load_date"), "event_type").agg(F.count("*").alias("n_rows"), F.count_if(F.col("value") < 10).alias("n_small"))


@registered("SELECT s_nationkey, max(s_name) AS rm_name, sum(s_acctbal::DECIMAL(15,2))::DECIMAL(25,2) AS portfolio FROM supplier GROUP BY s_nationkey")
def rm_portfolio(spark, sf_dir):
    return table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.max("s_name").alias("rm_name"), F.sum(F.col("s_acctbal").cast(MONEY)).cast("decimal(25,2)").alias("portfolio"))


@registered(
    """WITH d AS (SELECT CAST(max(ts) AS DATE) AS as_of FROM events)
SELECT user_id, sum(value::DECIMAL(15,2) * CASE event_type WHEN 'purchase' THEN 2 ELSE 1 END)::DECIMAL(25,2) AS weighted, count(*) AS n, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS any_purchase
FROM events, d WHERE CAST(ts AS DATE) > as_of - 30 GROUP BY user_id"""
)
def txn_agg_30d(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    since = e.agg(F.date_sub(F.max("ts"), 29).alias("d")).first()["d"]  # one value, so that it reaches the scan
    weight = F.when(F.col("event_type") == "purchase", 2).otherwise(1)
    recent = e.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
    return recent.groupBy("user_id").agg(F.sum(F.col("value").cast(MONEY) * weight).cast("decimal(25,2)").alias("weighted"), F.count("*").alias("n"), F.max(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).alias("any_purchase"))


@registered("SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn = 1")
def sort_dedupe(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")
    return J.sort_dedupe(li, ["l_partkey", "l_suppkey"], [F.col("l_orderkey"), F.col("l_linenumber")])


@registered("SELECT o_orderkey, sum(o_totalprice::DECIMAL(15,2)) OVER (PARTITION BY o_custkey)::DECIMAL(25,2) AS customer_total FROM orders")
def customer_total_window(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.sum(F.col("o_totalprice").cast(MONEY)).over(W.Window.partitionBy("o_custkey")).cast("decimal(25,2)").alias("customer_total"))


@registered("SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS branch_rank FROM customer")
def branch_rank(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.rank().over(W.Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"))).cast("long").alias("branch_rank"))


@registered("WITH t AS (SELECT c_custkey, c_nationkey, CAST(round(abs(c_acctbal) * 100) AS BIGINT) AS p FROM customer) SELECT c_custkey, p * 1000000 // nullif(sum(p) OVER (PARTITION BY c_nationkey)::BIGINT, 0) AS share_ppm FROM t")
def share_of_branch(spark, sf_dir):
    t = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.round(F.abs("c_acctbal") * 100).cast("long").alias("p"))
    t = t.withColumn("total", F.nullif(F.sum("p").over(W.Window.partitionBy("c_nationkey")), F.lit(0)))
    return t.select("c_custkey", F.expr("p * 1000000 div total").alias("share_ppm"))


@registered("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def ordered_topn(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@registered("SELECT 'node' AS channel, c_custkey AS id FROM customer UNION ALL SELECT 'edge', o_orderkey FROM orders UNION ALL SELECT 'dynamic', s_suppkey FROM supplier UNION ALL SELECT 'unparsed', p_partkey FROM part")
def union_channels(spark, sf_dir):
    parts = [table(spark, sf_dir, t).select(F.lit(c).alias("channel"), F.col(k).alias("id")) for c, t, k in (("node", "customer", "c_custkey"), ("edge", "orders", "o_orderkey"), ("dynamic", "supplier", "s_suppkey"), ("unparsed", "part", "p_partkey"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@registered("SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'")
def set_difference_retire(spark, sf_dir):
    mapped = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(mapped, "o_orderkey", "left_anti").distinct()


@registered("SELECT l_partkey AS k FROM lineitem WHERE l_linestatus = 'F' INTERSECT SELECT l_partkey FROM lineitem WHERE l_linestatus = 'O'")
def intersect_columns(spark, sf_dir):
    side = lambda s: table(spark, sf_dir, "lineitem").where(F.col("l_linestatus") == s).select(F.col("l_partkey").alias("k"))
    return side("F").intersect(side("O"))


@registered("SELECT (SELECT count(*) FROM orders) AS n_source, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS n_target")
def reconciliation_counts(spark, sf_dir):
    marks = table(spark, sf_dir, "orders").select(F.lit(1).alias("s"), F.lit(None).cast("long").alias("t")).unionByName(table(spark, sf_dir, "lineitem").select(F.lit(None).cast("int").alias("s"), F.col("l_orderkey").alias("t")))
    return marks.agg(F.count("s").alias("n_source"), F.count_distinct("t").alias("n_target"))


@registered("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' AND o_totalprice IS NOT NULL AND CAST(o_orderdate AS DATE) >= DATE '1997-06-30' - INTERVAL 12 MONTH AND CAST(o_orderdate AS DATE) <= DATE '1997-06-30'")
def valid_rows_view(spark, sf_dir):
    # bounds of the column itself, so that they reach the scan
    end, at = F.lit("1997-06-30").cast("date"), F.col("o_orderdate")
    within = (at >= F.add_months(end, -12).cast("timestamp_ntz")) & (at < F.date_add(end, 1).cast("timestamp_ntz"))
    return table(spark, sf_dir, "orders").where((F.col("o_orderstatus") == "F") & F.col("o_totalprice").isNotNull() & within).select("o_orderkey", "o_orderdate")
