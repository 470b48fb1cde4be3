"""Projection, predicate and decision queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import scalars as S
from weftline.operators import decisions as D
from weftline.plans.registry import registered
from weftline.session import table

MONEY = "decimal(15,2)"


@registered("SELECT o_orderkey, (CAST(round(o_totalprice * 100) AS BIGINT)::DECIMAL(18,0) / 100)::DECIMAL(15,2) AS gbp FROM orders")
def pence_to_gbp(spark, sf_dir):
    pence = F.round(F.col("o_totalprice") * 100).cast("long")
    return table(spark, sf_dir, "orders").select("o_orderkey", (pence.cast("decimal(18,0)") / F.lit(100)).cast(MONEY).alias("gbp"))


@registered(
    """WITH t AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS drawn, o_orderkey % 5 * 5000000 AS credit FROM orders)
SELECT o_orderkey, CASE WHEN credit > 0 THEN drawn * 10000 // credit ELSE 0 END AS utilisation_bp FROM t"""
)
def utilisation_guard(spark, sf_dir):
    drawn, limit = F.round(F.col("o_totalprice") * 100).cast("long"), F.col("o_orderkey") % 5 * 5000000
    t = table(spark, sf_dir, "orders").select("o_orderkey", drawn.alias("drawn"), limit.alias("credit"))
    return t.select("o_orderkey", F.when(F.col("credit") > 0, F.expr("drawn * 10000 div credit")).otherwise(F.lit(0)).alias("utilisation_bp"))


@registered("SELECT c_custkey, CASE WHEN s >= 800 THEN 'A' WHEN s >= 700 THEN 'B' WHEN s >= 600 THEN 'C' WHEN s >= 500 THEN 'D' ELSE 'E' END AS tier FROM (SELECT c_custkey, (c_custkey * 37 % 600 + 300) AS s FROM customer)")
def customer_tier(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", D.customer_tier(F.col("c_custkey") * 37 % 600 + 300).alias("tier"))


KIND_SQL = "CASE user_id % 4 WHEN 0 THEN 'CASH' WHEN 1 THEN 'GAMB' WHEN 2 THEN 'RETL' ELSE 'MISC' END"


def _kind():
    return F.element_at(F.array(*[F.lit(x) for x in ("CASH", "GAMB", "RETL", "MISC")]), (F.col("user_id") % 4 + 1).cast("int"))


@registered(f"SELECT event_id, (value::DECIMAL(15,2) * CASE {KIND_SQL} WHEN 'CASH' THEN 1.50 WHEN 'GAMB' THEN 2.00 WHEN 'RETL' THEN 1.00 ELSE 1.25 END::DECIMAL(4,2))::DECIMAL(18,4) AS weighted FROM events")
def txn_risk_weight(spark, sf_dir):
    weight = D.looked_up(_kind(), D.RISK_WEIGHT, D.RISK_WEIGHT_DEFAULT, "decimal(4,2)")
    return table(spark, sf_dir, "events").select("event_id", (F.col("value").cast(MONEY) * weight).cast("decimal(18,4)").alias("weighted"))


PD_SQL = """p AS (SELECT o_orderkey, o_orderkey % 120 AS dpd, o_custkey * 31 % 700 + 200 AS score FROM orders),
q AS (SELECT *, CASE WHEN dpd > 90 THEN 'DEFAULT' WHEN dpd > 30 AND score < 500 THEN 'HIGH' WHEN score >= 750 THEN 'LOW' ELSE 'MEDIUM' END AS segment,
CASE WHEN dpd > 90 THEN 1.0 WHEN dpd > 30 AND score < 500 THEN 0.15 WHEN score >= 750 THEN 0.01 ELSE 0.05 END::DECIMAL(5,4) AS pd FROM p)"""


def _pd():
    return D.default_probability(F.col("o_orderkey") % 120, F.col("o_custkey") * 31 % 700 + 200)


@registered(f"WITH {PD_SQL} SELECT o_orderkey, segment, pd FROM q")
def pd_bucket(spark, sf_dir):
    segment, pd = _pd()
    return table(spark, sf_dir, "orders").select("o_orderkey", segment.alias("segment"), pd.alias("pd"))


@registered(f"WITH {PD_SQL} SELECT o_orderkey, CASE WHEN pd >= 1 THEN 'DEFAULTED' WHEN pd >= 0.15 THEN 'SUBSTANDARD' WHEN pd >= 0.05 THEN 'WATCH' ELSE 'PERFORMING' END AS band FROM q")
def exposure_band(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", D.exposure_band(_pd()[1]).alias("band"))


@registered("SELECT o_orderkey, coalesce(bps, 10000)::INTEGER AS ccf_bps FROM orders LEFT JOIN (VALUES ('1', 5000), ('2', 10000), ('3', 7500), ('4', 7500)) t(k, bps) ON k = substr(o_orderpriority, 1, 1)")
def ccf_lookup(spark, sf_dir):
    rows = [(str(k + 1), b) for k, b in enumerate(D.CCF_BPS.values())]
    lookup = F.broadcast(spark.createDataFrame(rows, "k string, bps int"))
    o = table(spark, sf_dir, "orders")
    return o.join(lookup, F.substring("o_orderpriority", 1, 1) == F.col("k"), "left").select("o_orderkey", F.coalesce("bps", F.lit(D.CCF_DEFAULT)).alias("ccf_bps"))


@registered("SELECT c_custkey, coalesce(bps, 4500)::INTEGER AS lgd_bps FROM customer LEFT JOIN (VALUES ('CA', 150), ('GU', 250), ('RE', 100), ('SE', 350)) t(k, bps) ON k = CASE c_custkey % 5 WHEN 0 THEN 'CA' WHEN 1 THEN 'GU' WHEN 2 THEN 'RE' WHEN 3 THEN 'SE' ELSE 'NO' END")
def lgd_lookup(spark, sf_dir):
    key = F.element_at(F.array(*[F.lit(x) for x in ("CA", "GU", "RE", "SE", "NO")]), (F.col("c_custkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", D.looked_up(key, D.LGD_BPS, D.LGD_DEFAULT, "int").alias("lgd_bps"))


@registered("SELECT o_orderkey FROM orders WHERE NOT (o_totalprice::DECIMAL(15,2) <= 50000 AND o_orderstatus = 'O') AND o_orderkey % 7 <> 0")
def control_rule_skip(spark, sf_dir):
    rule = ((F.col("o_totalprice").cast(MONEY) <= 50000) & (F.col("o_orderstatus") == "O")) | (F.col("o_orderkey") % 7 == 0)
    return table(spark, sf_dir, "orders").where(~rule).select("o_orderkey")


DQ_SQL = "CASE WHEN l_quantity <= 5 THEN 'LOW QUANTITY' WHEN l_discount > 0.08 THEN 'DISCOUNT' END"


def _dq(spark, sf_dir):
    return D.split_valid(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount"), [("LOW QUANTITY", F.col("l_quantity") <= 5), ("DISCOUNT", F.col("l_discount") > 0.08)])


@registered(f"SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE {DQ_SQL} IS NULL")
def dq_valid(spark, sf_dir):
    return _dq(spark, sf_dir)[0]


@registered(f"SELECT l_orderkey, l_linenumber, l_quantity, l_discount, {DQ_SQL} AS reject_reason FROM lineitem WHERE {DQ_SQL} IS NOT NULL")
def dq_error(spark, sf_dir):
    return _dq(spark, sf_dir)[1]


@registered(f"SELECT count(*) AS n_read, count(*) FILTER (WHERE {DQ_SQL} IS NULL) AS n_valid, count(*) FILTER (WHERE {DQ_SQL} IS NOT NULL) AS n_error FROM lineitem")
def dq_metrics(spark, sf_dir):
    return _dq(spark, sf_dir)[2]


@registered("SELECT o_orderkey, coalesce(nullif(trim(CASE WHEN o_orderkey % 3 = 0 THEN '  ' ELSE o_orderstatus END), ''), c_mktsegment) AS chosen FROM orders JOIN customer ON c_custkey = o_custkey")
def fallback_value(spark, sf_dir):
    first = F.when(F.col("o_orderkey") % 3 == 0, "  ").otherwise(F.col("o_orderstatus"))
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", D.prefer(first, F.col("c_mktsegment")).alias("chosen"))


@registered("SELECT c_custkey, trim(c_mktsegment) || ' ' || trim(c_name) AS full_name FROM customer")
def full_name_string(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.trim("c_mktsegment"), F.lit(" "), F.trim("c_name")).alias("full_name"))


@registered("SELECT o_orderkey, CASE WHEN o_totalprice::DECIMAL(15,2) * 100 < 10000000 THEN o_totalprice::DECIMAL(15,2) * 100 ELSE 0 END::DECIMAL(9,2) AS ead FROM orders")
def size_error_zero(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", S.zero_on_overflow(F.col("o_totalprice").cast(MONEY) * 100, 9, 2).alias("ead"))


@registered("SELECT s_suppkey, (CAST(trunc(s_acctbal) AS BIGINT) * 1000)::DECIMAL(15,2) AS portfolio_gbp FROM supplier")
def thousand_to_gbp(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal").cast("long") * 1000).cast(MONEY).alias("portfolio_gbp"))


@registered("SELECT l_orderkey, l_linenumber, (trunc(l_quantity::DECIMAL(15,2) * l_discount::DECIMAL(5,2) * 10) / 10)::DECIMAL(15,1) AS cut, round(l_quantity::DECIMAL(15,2) * l_discount::DECIMAL(5,2), 1)::DECIMAL(15,1) AS near FROM lineitem")
def compute_truncates(spark, sf_dir):
    x = F.col("l_quantity").cast(MONEY) * F.col("l_discount").cast("decimal(5,2)")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.truncated(x, 15, 1).alias("cut"), S.rounded(x, 15, 1).alias("near"))
