"""Join queries: sort-step modes, lookups, ranges, patterns, positions, upserts and the mart."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import decisions as D
from weftline.operators import joins as J
from weftline.operators import mart as M
from weftline.plans.registry import registered
from weftline.session import table

MONEY = "decimal(15,2)"


def _files(spark, sf_dir):
    """orders by key; F2: one row for each order with returned lines."""
    f1 = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus")
    li = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    f2 = li.groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n_lines"))
    extra = spark.range(3).select((F.lit(-1) - F.col("id")).alias("k"), F.lit(0).cast("long").alias("n_lines"))
    return f1, f2.unionByName(extra)


FILES_SQL = """f1 AS (SELECT o_orderkey AS k, o_orderstatus FROM orders),
f2 AS (SELECT l_orderkey AS k, count(*) AS n_lines FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 UNION ALL SELECT -1 - range, 0 FROM range(3))"""


for _name, _card, _join, _cols in (
    ("join_inner", "", "f1 JOIN f2 USING (k)", "k, o_orderstatus, n_lines"),
    ("join_left", "UNPAIRED,F1", "f1 LEFT JOIN f2 USING (k)", "k, o_orderstatus, n_lines"),
    ("join_right", "UNPAIRED,F2", "f1 RIGHT JOIN f2 USING (k)", "k, o_orderstatus, n_lines"),
    ("join_full", "UNPAIRED", "f1 FULL JOIN f2 USING (k)", "k, o_orderstatus, n_lines"),
    ("join_left_anti", "UNPAIRED,F1,ONLY", "f1 WHERE k NOT IN (SELECT k FROM f2)", "k, o_orderstatus"),
    ("join_right_anti", "UNPAIRED,F2,ONLY", "f2 WHERE k NOT IN (SELECT k FROM f1)", "k, n_lines"),
):

    def _f(spark, sf_dir, card=_card):
        return J.joinkeys(*_files(spark, sf_dir), ["k"], card)

    _f.__name__ = _name
    registered(f"WITH {FILES_SQL} SELECT {_cols} FROM {_join}")(_f)


@registered(f"WITH {FILES_SQL} SELECT k, o_orderstatus FROM f1 WHERE k IN (SELECT k FROM f2)")
def join_left_semi(spark, sf_dir):
    f1, f2 = _files(spark, sf_dir)
    return f1.join(f2, "k", "left_semi")


@registered(
    """SELECT o_orderkey, l_linenumber, l_partkey, rpad(l_returnflag, 4, ' ') || lpad(l_linenumber::VARCHAR, 3, '0') AS rec
FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linestatus <> 'F' AND o_orderstatus <> 'P'"""
)
def joinkeys_reformat(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'"), table(spark, sf_dir, "lineitem").where("l_linestatus <> 'F'")
    rec = F.concat(F.rpad("l_returnflag", 4, " "), F.lpad(F.col("l_linenumber").cast("string"), 3, "0"))
    return J.joinkeys(o.withColumnRenamed("o_orderkey", "k"), li.withColumnRenamed("l_orderkey", "k"), ["k"]).select(F.col("k").alias("o_orderkey"), "l_linenumber", "l_partkey", rec.alias("rec"))


@registered("SELECT c_custkey, o_orderkey, o_orderdate FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal < 0 AND o_orderdate >= TIMESTAMP '1996-01-01' ")
def file_driven_lookup(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer").where("c_acctbal < 0"), table(spark, sf_dir, "orders").where("o_orderdate >= timestamp_ntz '1996-01-01'")
    return c.join(o, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "o_orderkey", "o_orderdate")


@registered("SELECT c_custkey, coalesce(sum(o_totalprice::DECIMAL(15,2)), 0)::DECIMAL(25,2) AS exposure, max(o_totalprice) AS largest FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def call_aggregate_lookup(spark, sf_dir):
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast(MONEY)).alias("s"), F.max("o_totalprice").alias("largest"))
    c = table(spark, sf_dir, "customer")
    return c.join(per, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("s", F.lit(0)).cast("decimal(25,2)").alias("exposure"), "largest")


LAYOUT_SQL = "f(record, field, s, e) AS (VALUES (0, 'ACCT', 1, 8), (0, 'SORT', 9, 14), (0, 'AMT', 15, 31), (1, 'ID', 1, 15), (1, 'NAME', 16, 55), (2, 'ALL', 1, 80))"


@registered(f"WITH {LAYOUT_SQL} SELECT o_orderkey, field FROM orders JOIN f ON record = o_orderkey % 3 AND s <= o_orderkey % 40 + 10 AND e >= o_orderkey % 40 + 1")
def range_overlap(spark, sf_dir):
    fields = spark.createDataFrame([(0, "ACCT", 1, 8), (0, "SORT", 9, 14), (0, "AMT", 15, 31), (1, "ID", 1, 15), (1, "NAME", 16, 55), (2, "ALL", 1, 80)], "record long, field string, start long, end long")
    ranges = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 3).alias("record"), (F.col("o_orderkey") % 40 + 1).alias("lo"), (F.col("o_orderkey") % 40 + 10).alias("hi"))
    return J.overlaps(ranges, fields).select("o_orderkey", "field")


@registered(
    """WITH o AS (SELECT l_orderkey * 10 + l_linenumber AS record, 1 AS out, l_linenumber AS src, 10 AS len FROM lineitem),
i AS (SELECT l_orderkey * 10 + l_linenumber AS record, 1 AS out, 20 AS src, 6 AS len FROM lineitem UNION ALL SELECT l_orderkey * 10 + l_linenumber, 7, 1, 9 FROM lineitem)
SELECT record, o.out + greatest(o.src, i.out) - o.src AS out, i.src + greatest(o.src, i.out) - i.out AS src, least(o.src + o.len, i.out + i.len) - greatest(o.src, i.out) AS len
FROM o JOIN i USING (record) WHERE greatest(o.src, i.out) < least(o.src + o.len, i.out + i.len)"""
)
def build_composition(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("record"), "l_linenumber")
    piece = lambda out, src, n: li.select("record", F.lit(out).alias("out"), src.alias("src"), F.lit(n).alias("len"))
    return J.composed(piece(1, F.col("l_linenumber"), 10), piece(1, F.lit(20), 6).union(piece(7, F.lit(1), 9)))


@registered(
    """WITH n AS (SELECT DISTINCT 'PROD.CUST.D' || c_custkey AS name FROM customer), t AS (SELECT DISTINCT 'PROD.CUST.D' || (o_custkey % 400) || '*' AS template FROM orders)
SELECT template, min(name) AS name FROM t JOIN n ON name LIKE replace(template, '*', '%') GROUP BY template HAVING count(*) = 1"""
)
def pattern_unique_match(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select(F.concat(F.lit("PROD.CUST.D"), F.col("c_custkey")).alias("name")).distinct()
    templates = table(spark, sf_dir, "orders").select(F.concat(F.lit("PROD.CUST.D"), F.col("o_custkey") % 400, F.lit("*")).alias("template")).distinct()
    return J.unique_matches(names, templates)


@registered(
    """WITH l AS (SELECT l_orderkey AS stmt, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos, l_partkey AS source FROM lineitem WHERE l_returnflag <> 'N'),
r AS (SELECT l_orderkey AS stmt, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos, l_suppkey AS target FROM lineitem WHERE l_linestatus = 'F')
SELECT stmt, pos, source, target FROM l JOIN r USING (stmt, pos) WHERE (SELECT count(*) FROM l l2 WHERE l2.stmt = l.stmt) = (SELECT count(*) FROM r r2 WHERE r2.stmt = l.stmt)"""
)
def positional_pairing(spark, sf_dir):
    from pyspark.sql import window as W

    li = table(spark, sf_dir, "lineitem")
    pos = F.row_number().over(W.Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).cast("long")
    left = li.where("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("stmt"), pos.alias("pos"), F.col("l_partkey").alias("source"))
    right = li.where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("stmt"), pos.alias("pos"), F.col("l_suppkey").alias("target"))
    return J.paired(left, right, ["stmt"]).select("stmt", "pos", "source", "target")


@registered("WITH s AS (SELECT o_custkey AS k, max(o_orderpriority) AS p FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT c_custkey, CASE WHEN k IS NOT NULL THEN p ELSE c_mktsegment END AS c_mktsegment FROM customer LEFT JOIN s ON k = c_custkey")
def merge_update(spark, sf_dir):
    source = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("c_mktsegment"))
    return J.merged(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), source, ["c_custkey"], ["c_mktsegment"])


@registered("SELECT o_orderkey, CASE WHEN o_totalprice < 2000 THEN 'ERROR' ELSE o_orderstatus END AS load_status FROM orders WHERE o_orderpriority <> '5-LOW'")
def post_load_update(spark, sf_dir):
    status = F.when(F.col("o_totalprice") < 2000, "ERROR").otherwise(F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").where("not (o_orderpriority = '5-LOW')").select("o_orderkey", status.alias("load_status"))


def accounts(spark, sf_dir):
    """One row for each order: exposures in money, reference rates as integers."""
    li = table(spark, sf_dir, "lineitem")
    cents = lambda c: F.round(F.col("l_extendedprice") * F.col(c) * 100).cast("long")
    per = li.groupBy("l_orderkey").agg(F.sum(cents("l_discount")).alias("u"), F.sum(cents("l_tax")).alias("a"))
    o, c, n = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    money = lambda x: (x.cast("decimal(18,0)") / F.lit(100)).cast("decimal(18,2)")
    ccf = F.when(F.col("o_orderpriority").startswith("1"), 5000).when(F.col("o_orderpriority").startswith("3") | F.col("o_orderpriority").startswith("4"), 7500).otherwise(10000)
    lgd = F.when(F.col("c_mktsegment") == "AUTOMOBILE", 150).when(F.col("c_mktsegment") == "BUILDING", 250).when(F.col("c_mktsegment") == "FURNITURE", 100).when(F.col("c_mktsegment") == "HOUSEHOLD", 350).otherwise(4500)
    out = o.join(c, F.col("c_custkey") == F.col("o_custkey")).join(n, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(per, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return out.select(
        F.col("o_orderkey").alias("account_number"),
        F.col("c_custkey").alias("customer_key"),
        F.col("c_nationkey").alias("branch"),
        F.col("n_name").alias("branch_name"),
        money(F.round(F.col("o_totalprice") * 100).cast("long")).alias("drawn"),
        money(F.coalesce("u", F.lit(0))).alias("undrawn"),
        money(F.coalesce("a", F.lit(0))).alias("accrued"),
        ccf.alias("ccf_bps"),
        lgd.alias("lgd_bps"),
        (F.col("o_orderkey") % 120).alias("dpd"),
        (F.col("c_custkey") * 31 % 700 + 200).alias("score"),
    )


STAR_SQL = """li AS (SELECT l_orderkey, sum(CAST(round(l_extendedprice * l_discount * 100) AS BIGINT))::BIGINT AS u, sum(CAST(round(l_extendedprice * l_tax * 100) AS BIGINT))::BIGINT AS a FROM lineitem GROUP BY 1),
acc AS (SELECT o_orderkey AS account_number, c_custkey AS customer_key, c_nationkey AS branch, n_name AS branch_name,
  CAST(round(o_totalprice * 100) AS BIGINT) AS drawn_p, coalesce(u, 0) AS undrawn_p, coalesce(a, 0) AS accrued_p,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 5000 WHEN '3' THEN 7500 WHEN '4' THEN 7500 ELSE 10000 END AS ccf_bps,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 150 WHEN 'BUILDING' THEN 250 WHEN 'FURNITURE' THEN 100 WHEN 'HOUSEHOLD' THEN 350 ELSE 4500 END AS lgd_bps,
  o_orderkey % 120 AS dpd, c_custkey * 31 % 700 + 200 AS score
  FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN li ON l_orderkey = o_orderkey)"""


@registered(f"WITH {STAR_SQL} SELECT account_number, customer_key, branch, branch_name, (drawn_p::DECIMAL(18,0) / 100)::DECIMAL(18,2) AS drawn, (undrawn_p::DECIMAL(18,0) / 100)::DECIMAL(18,2) AS undrawn, (accrued_p::DECIMAL(18,0) / 100)::DECIMAL(18,2) AS accrued, ccf_bps, lgd_bps, dpd, score FROM acc")
def star_mart(spark, sf_dir):
    return accounts(spark, sf_dir)


# Exact integer arithmetic in DuckDB: ead in pence rounds the drawn-down part half up, el is in 1e-4 of a pound.
LOSS_SQL = f"""{STAR_SQL},
x AS (SELECT *, drawn_p + (undrawn_p * ccf_bps + 5000) // 10000 + accrued_p AS ead_p,
  CASE WHEN dpd > 90 THEN 'DEFAULT' WHEN dpd > 30 AND score < 500 THEN 'HIGH' WHEN score >= 750 THEN 'LOW' ELSE 'MEDIUM' END AS segment,
  CASE WHEN dpd > 90 THEN 100 WHEN dpd > 30 AND score < 500 THEN 15 WHEN score >= 750 THEN 1 ELSE 5 END AS pd_pct FROM acc),
y AS (SELECT *, (ead_p::HUGEINT * pd_pct * lgd_bps + 5000) // 10000 AS el_u FROM x)"""


@registered(
    f"""WITH {LOSS_SQL}
SELECT account_number, customer_key, branch, segment, (ead_p::DECIMAL(20,0) / 100)::DECIMAL(18,2) AS ead, (el_u::BIGINT::DECIMAL(20,0) / 10000)::DECIMAL(18,4) AS el,
CASE WHEN pd_pct >= 100 THEN 'DEFAULTED' WHEN pd_pct >= 15 THEN 'SUBSTANDARD' WHEN pd_pct >= 5 THEN 'WATCH' ELSE 'PERFORMING' END AS band,
(sum(ead_p) OVER (PARTITION BY customer_key))::BIGINT AS customer_ead_pence, rank() OVER (PARTITION BY branch ORDER BY el_u DESC) AS branch_rank,
(sum(el_u) OVER (PARTITION BY branch))::BIGINT AS branch_el_units, (el_u * 125)::BIGINT AS capital_units FROM y"""
)
def credit_risk_model(spark, sf_dir):
    m = M.windows(M.expected_loss(accounts(spark, sf_dir)))
    return m.select(
        "account_number", "customer_key", "branch", "segment", "ead", "el", "band",
        (F.col("customer_ead") * 100).cast("long").alias("customer_ead_pence"), "branch_rank",
        (F.col("branch_el") * 10000).cast("long").alias("branch_el_units"), (F.col("capital") * 100000).cast("long").alias("capital_units"),
    )


RUN_DATE = "2001-06-30"


@registered(
    f"""WITH {LOSS_SQL},
z AS (SELECT y.*, c_name, c_custkey * 37 % 600 + 300 AS cs, c_custkey % 10 = 0 AS vulnerable, (account_number % 5 * 5000000)::BIGINT AS limit_p, (ead_p::HUGEINT * pd_pct * lgd_bps) AS loss FROM y JOIN customer ON c_custkey = customer_key),
tx AS (SELECT l_orderkey, sum(CAST(round(l_extendedprice * 100) AS BIGINT) * (1 + l_linenumber % 2))::BIGINT AS v, count(*) AS n, max(l_returnflag) AS r FROM lineitem WHERE l_shipdate >= DATE '{RUN_DATE}' - 30 GROUP BY 1),
rm AS (SELECT s_nationkey, max(s_suppkey) AS emp, sum(CAST(round(s_acctbal * 100) AS BIGINT))::BIGINT AS v FROM supplier GROUP BY 1),
b AS (SELECT *, (sum(el_u) OVER (PARTITION BY branch))::HUGEINT AS t FROM z)
SELECT customer_key, c_name AS customer_full_name, CASE WHEN cs >= 800 THEN 'A' WHEN cs >= 700 THEN 'B' WHEN cs >= 600 THEN 'C' WHEN cs >= 500 THEN 'D' ELSE 'E' END AS customer_risk_tier, branch, account_number,
'P' || account_number % 4 AS product_code, (drawn_p::DECIMAL(20,0) / 100)::DECIMAL(18,2) AS account_balance, (limit_p::DECIMAL(20,0) / 100)::DECIMAL(18,2) AS credit_limit, ((drawn_p - accrued_p)::DECIMAL(20,0) / 100)::DECIMAL(18,2) AS net_exposure,
CASE WHEN limit_p > 0 THEN drawn_p * 10000 // limit_p ELSE 0 END AS utilisation_bp, dpd AS arrears_days, (coalesce(tx.v, 0)::DECIMAL(20,0) / 100)::DECIMAL(25,2) AS txn_volume_30d, coalesce(tx.n, 0) AS txn_count_30d,
emp AS rm_emp_id, (rm.v::DECIMAL(20,0) / 100)::DECIMAL(25,2) AS rm_portfolio_value, CASE WHEN vulnerable THEN 'Y' ELSE 'N' END AS vulnerable_flag, coalesce(tx.r, 'N') AS reportable_flag, CASE WHEN dpd > 90 THEN 'Y' ELSE 'N' END AS default_flag,
(ead_p::DECIMAL(20,0) / 100)::DECIMAL(18,2) AS ead, lgd_bps AS final_lgd_bps, (pd_pct::DECIMAL(5,0) / 100)::DECIMAL(5,4) AS pd_rate, (((loss + 500000) // 1000000)::BIGINT::DECIMAL(20,0) / 100)::DECIMAL(18,2) AS expected_loss, segment AS risk_status,
CASE WHEN pd_pct >= 100 THEN 'DEFAULTED' WHEN pd_pct >= 15 THEN 'SUBSTANDARD' WHEN pd_pct >= 5 THEN 'WATCH' ELSE 'PERFORMING' END AS band,
((sum(ead_p) OVER (PARTITION BY customer_key))::BIGINT::DECIMAL(20,0) / 100)::DECIMAL(28,2) AS customer_total_ead, (((loss * 125 + 5000000) // 10000000)::BIGINT::DECIMAL(20,0) / 100)::DECIMAL(20,2) AS regulatory_capital,
rank() OVER (PARTITION BY branch ORDER BY el_u DESC) AS branch_el_rank, CASE WHEN t <> 0 THEN ((el_u * 20000 + t) // (2 * t))::BIGINT END AS share_of_branch_bp, DATE '{RUN_DATE}' AS model_run_date
FROM b LEFT JOIN tx ON l_orderkey = account_number LEFT JOIN rm ON s_nationkey = branch"""
)
def unified_mart(spark, sf_dir):
    """The mart's 29 columns: customers, accounts, managers and transactions of 30 days."""
    pence = lambda c: F.round(F.col(c) * 100).cast("long")
    money = lambda x: (x.cast("decimal(18,0)") / F.lit(100)).cast("decimal(18,2)")
    yes = lambda cond: F.when(cond, "Y").otherwise("N")
    k = F.col("account_number")
    a = M.expected_loss(accounts(spark, sf_dir)).withColumns({"product_code": F.concat(F.lit("P"), (k % 4).cast("string")), "credit_limit": money(k % 5 * 5000000), "default_flag": yes(F.col("dpd") > 90), "risk_status": F.col("segment")})
    c = F.col("c_custkey")
    customers = table(spark, sf_dir, "customer").select(c.alias("customer_key"), F.col("c_name").alias("customer_full_name"), D.customer_tier(c * 37 % 600 + 300).alias("customer_risk_tier"), yes(c % 10 == 0).alias("vulnerable_flag"))
    managers = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("branch"), F.col("s_suppkey").alias("emp_id"), money(pence("s_acctbal")).alias("value"))
    txns = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("account_number"), F.col("l_shipdate").alias("posted"), money(pence("l_extendedprice")).alias("amount"), (1 + F.col("l_linenumber") % 2).alias("weight"), F.col("l_returnflag").alias("reportable"))
    return M.unified(customers, a, managers, txns, RUN_DATE)
