"""Record queries: sort steps by typed keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import joins as J
from weftline.operators import recordsort as R
from weftline.plans.registry import registered
from weftline.session import table
from weftline.sources import fixed_width as X

SORT_CARD = "SORT FIELDS=(1,1,CH,D,2,3,PD,A,5,2,FI,D,7,3,ZD,A,10,4,BI,D)"


@registered(
    """SELECT o_orderkey, row_number() OVER (ORDER BY o_orderstatus DESC, (o_orderkey % 5 - 2) * (o_custkey % 3), o_orderkey % 3 - 1 DESC, (o_custkey % 4 - 2) * 100, o_custkey DESC, o_orderkey) AS pos
FROM orders"""
)
def typed_sort(spark, sf_dir):
    """Records of text, packed, signed binary, zoned and binary keys, in the order of a SORT card."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    parts = [F.col("o_orderstatus").cast("binary"), X.packed((k % 5 - 2) * (c % 3), 3), X.binary_number(k % 3 - 1, 2), X.zoned((c % 4 - 2) * 100, 3).cast("binary"), X.binary_number(c, 4)]
    records = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(*parts).alias("record"))
    return R.sort_records(records, "record", SORT_CARD, ["o_orderkey"]).select("o_orderkey", "pos")


MERGE_CARD = "SORT FIELDS=(1,10,CH,A,21,8,CH,D,29,12,ZD,D,11,10,CH,A)"


@registered(
    """WITH r AS (SELECT *, lpad(o_custkey::VARCHAR, 10, '0') AS acct, lpad(o_orderkey::VARCHAR, 10, '0') AS k, strftime(o_orderdate, '%Y%m%d') AS d, lpad(round(o_totalprice * 100)::BIGINT::VARCHAR, 12, '0') AS p
  FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AND o_orderstatus <> 'P')
SELECT row_number() OVER (ORDER BY acct, d DESC, p DESC, k) AS pos, acct || k || p || o_orderstatus AS rec FROM r"""
)
def merge_step(spark, sf_dir):
    """A merge step: unpaired records of the second file, in the order of four keys, some left out, rebuilt from byte ranges."""
    f1 = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("key"))
    o = table(spark, sf_dir, "orders").where("o_custkey is not null").withColumns({"d": F.date_format("o_orderdate", "yyyyMMdd"), "pence": F.round(F.col("o_totalprice") * 100).cast("long")})
    layout: X.Layout = [("o_custkey", 10, "number"), ("o_orderkey", 10, "number"), ("d", 8, "text"), ("pence", 12, "number"), ("o_orderstatus", 1, "text")]
    f2 = o.select(X.encode(layout).alias("record")).withColumn("key", F.substring("record", 1, 10))
    left = J.joinkeys(f1, f2, ["key"], "UNPAIRED,F2,ONLY").where(F.substring("record", 41, 1) != "P")
    return R.sort_records(left, "record", MERGE_CARD, ["record"]).select("pos", R.built("record", [(1, 20), (29, 12), (41, 1)]).alias("rec"))
