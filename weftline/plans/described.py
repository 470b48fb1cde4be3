"""Statements that programs and jobs describe: cursors in order, unloads, reports, monthly inserts; and accumulation."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import accumulate as A
from weftline.operators.recordsort import numbered
from weftline.plans.registry import registered
from weftline.session import shared_dir, table


@registered(
    """WITH m AS (SELECT l_partkey AS id, l_orderkey * 10 + l_linenumber AS ord, CASE WHEN l_linenumber % 3 <> 0 THEN l_returnflag END AS language, l_linestatus AS path, 'k' || l_linenumber AS k, l_quantity::BIGINT::VARCHAR AS v FROM lineitem),
a AS (SELECT id, string_agg(k || '=' || v, ';' ORDER BY k) AS attributes FROM (SELECT *, row_number() OVER (PARTITION BY id, k ORDER BY ord, v) AS rn FROM m) WHERE rn = 1 GROUP BY id),
l AS (SELECT id, language FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord, language) AS rn FROM m WHERE language IS NOT NULL) WHERE rn = 1),
p AS (SELECT id, path FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord, path) AS rn FROM m) WHERE rn = 1),
c AS (SELECT id, string_agg(x, ',' ORDER BY x) AS columns FROM (SELECT id, language AS x FROM m WHERE language IS NOT NULL UNION SELECT id, path FROM m) GROUP BY id)
SELECT id, language, path, columns, attributes FROM p LEFT JOIN l USING (id) LEFT JOIN c USING (id) LEFT JOIN a USING (id)"""
)
def node_merge(spark, sf_dir):
    """Mentions of parts by order lines, merged: first language and path, all columns, attributes key by key."""
    language = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_returnflag"))
    m = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), language.alias("language"), F.col("l_linestatus").alias("path"),
        F.array(language, F.col("l_linestatus")).alias("columns"), F.create_map(F.concat(F.lit("k"), F.col("l_linenumber").cast("string")), F.col("l_quantity").cast("long").cast("string")).alias("attributes"),
    )
    pairs = F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return A.merged_nodes(m).select("id", "language", "path", F.array_join("columns", ",").alias("columns"), F.array_join(pairs, ";").alias("attributes"))


@registered(
    """WITH f AS (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS seq, 'P' || l_partkey % 50 AS source, l_returnflag || l_linestatus AS logic FROM lineitem),
s AS (SELECT l_suppkey, string_agg(source, ',' ORDER BY at_, source) AS sources FROM (SELECT l_suppkey, source, min(seq) AS at_ FROM f GROUP BY 1, 2) GROUP BY 1),
l AS (SELECT l_suppkey, string_agg(logic, '; ' ORDER BY at_, logic) AS logic FROM (SELECT l_suppkey, logic, min(seq) AS at_ FROM f GROUP BY 1, 2) GROUP BY 1)
SELECT l_suppkey, sources, logic FROM s JOIN l USING (l_suppkey)"""
)
def transform_accumulation(spark, sf_dir):
    """Each supplier as a target: the parts that reach it, and how, in the order in which they first do."""
    facts = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.concat(F.lit("P"), (F.col("l_partkey") % 50).cast("string")).alias("source"), F.concat("l_returnflag", "l_linestatus").alias("logic"))
    return A.accumulated(facts, ["l_suppkey"]).select("l_suppkey", F.array_join("sources", ",").alias("sources"), "logic")


@registered(
    """SELECT row_number() OVER (ORDER BY o_custkey, o_orderkey) AS pos, trim(o_orderpriority) AS priority, strftime(o_orderdate, '%Y%m%d') AS opened, coalesce(trim(CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END), ' ') AS new_account, o_custkey, o_orderkey
FROM orders WHERE o_orderstatus = 'O' AND substr(o_orderpriority, 1, 1) IN ('1', '2', '3')"""
)
def customer_cursor(spark, sf_dir):
    """A cursor with trimmed, formatted and defaulted columns, a list filter and a sort by two keys."""
    o = table(spark, sf_dir, "orders").where((F.col("o_orderstatus") == "O") & F.left("o_orderpriority", F.lit(1)).isin("1", "2", "3"))
    items = o.select(F.trim("o_orderpriority").alias("priority"), F.date_format("o_orderdate", "yyyyMMdd").alias("opened"), F.coalesce(F.trim(F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderstatus"))), F.lit(" ")).alias("new_account"), "o_custkey", "o_orderkey")
    return numbered(items, [F.col("o_custkey"), F.col("o_orderkey")])


for _name, _of, _where, _order, _cols in (
    ("account_cursor", "orders", "o_orderstatus = 'O'", "o_custkey, o_orderkey", "o_orderkey, o_custkey, o_totalprice"),
    ("transaction_cursor", "events", "event_type = 'purchase' AND value > 0", "user_id, ts, event_id", "event_id, user_id, value"),
    ("customer_master_cursor", "customer", "c_mktsegment IN ('BUILDING', 'MACHINERY')", "c_custkey", "c_custkey, c_name, c_nationkey"),
    ("employee_cursor", "supplier", "s_acctbal > 0 AND s_nationkey < 20", "s_nationkey, s_suppkey", "s_suppkey, s_name, s_nationkey"),
):

    def _f(spark, sf_dir, of=_of, where=_where, order=_order, cols=_cols):
        """A cursor's rows with their place in its order."""
        rows = table(spark, sf_dir, of).where(where)
        return numbered(rows, [F.col(c) for c in order.split(", ")]).select("pos", *cols.split(", "))

    _f.__name__ = _name
    registered(f"SELECT row_number() OVER (ORDER BY {_order}) AS pos, {_cols} FROM {_of} WHERE {_where}")(_f)


@registered(
    """WITH r AS (SELECT c_custkey, c_name, (c_custkey % 40)::BIGINT AS pd_pct FROM customer WHERE c_acctbal >= 0), e AS (SELECT o_custkey, sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT AS total, sum(CAST(round(o_totalprice * 100) AS BIGINT) * (o_orderkey % 4) // 4)::BIGINT AS held FROM orders GROUP BY 1)
SELECT c_custkey, c_name, total AS total_pence, held AS collateral_pence, total - held AS net_pence, (total - held) * pd_pct // 100 AS weighted_pence FROM r JOIN e ON o_custkey = c_custkey"""
)
def risk_report(spark, sf_dir):
    """Approved ratings, unloaded, joined with exposures: net exposure and its part by probability, cut to whole pence."""
    ratings = table(spark, sf_dir, "customer").where("c_acctbal >= 0").select("c_custkey", "c_name", (F.col("c_custkey") % 40).alias("pd_pct"))
    pence = F.round(F.col("o_totalprice") * 100).cast("long")
    held = F.floor(pence * (F.col("o_orderkey") % 4) / 4).cast("long")
    e = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(pence).alias("total_pence"), F.sum(held).alias("collateral_pence"))
    net = F.col("total_pence") - F.col("collateral_pence")
    return ratings.join(e, "c_custkey").select("c_custkey", "c_name", "total_pence", "collateral_pence", net.alias("net_pence"), F.floor(net.cast("decimal(20,0)") * F.col("pd_pct") / 100).cast("long").alias("weighted_pence"))


@registered("SELECT o_orderkey, strftime(o_orderdate, '%Y%m') AS month, 'RISK_SUMMARY_' || strftime(o_orderdate, '%Y%m') AS table_name FROM orders WHERE o_orderstatus = 'F'")
def monthly_insert(spark, sf_dir):
    """An INSERT into a table named at run time: rows written by month, a folder each, and read back."""
    path = f"{shared_dir(spark)}/weftline-monthly-{spark.sparkContext.applicationId}-{sf_dir.rstrip('/').rsplit('/', 1)[-1]}"
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", F.date_format("o_orderdate", "yyyyMM").alias("month"))
    # a repeated run replaces the months it writes and leaves others alone
    rows.repartition("month", F.col("o_orderkey") % 8).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
    back = spark.read.schema("o_orderkey long, month string").parquet(path)
    return back.select("o_orderkey", "month", F.concat(F.lit("RISK_SUMMARY_"), "month").alias("table_name"))
