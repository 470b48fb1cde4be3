"""Codec and source-format queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import scalars as S
from weftline.plans.registry import registered
from weftline.session import table
from weftline.sources import fixed_width as X

ORDER_LAYOUT: X.Layout = [("o_orderkey", 10, "number"), ("o_orderstatus", 2, "text"), ("o_orderpriority", 20, "text"), ("o_custkey", 9, "number")]


@registered("SELECT o_orderkey, o_orderstatus, o_orderpriority, o_custkey, lpad(o_orderkey::VARCHAR, 10, '0') || rpad(o_orderstatus, 2, ' ') || rpad(o_orderpriority, 20, ' ') || lpad(o_custkey::VARCHAR, 9, '0') AS line FROM orders")
def fixed_width_encode_decode(spark, sf_dir):
    lines = table(spark, sf_dir, "orders").select(X.encode(ORDER_LAYOUT).alias("line"))
    return lines.select(*X.decode(F.col("line"), ORDER_LAYOUT), "line")


@registered("SELECT l_orderkey AS record, l_linenumber AS ord, (sum(l) OVER w - l + 1)::BIGINT AS start, (sum(l) OVER w)::BIGINT AS \"end\" FROM (SELECT DISTINCT l_orderkey, l_linenumber, (l_linenumber * 3)::BIGINT AS l FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)")
def record_offsets(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record"), F.col("l_linenumber").alias("ord"), F.concat(F.lit("F"), "l_linenumber").alias("field"), (F.col("l_linenumber") * 3).cast("long").alias("length")).distinct()
    return X.offsets(f).select("record", "ord", "start", "end")


@registered(
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size WHEN 1 THEN (p_size % 16 + 3) // 2 + 1 WHEN 2 THEN CASE WHEN p_size % 18 + 1 <= 4 THEN 2 WHEN p_size % 18 + 1 <= 9 THEN 4 ELSE 8 END
WHEN 3 THEN p_size % 9 + 3 ELSE p_size % 9 + 5 END::INTEGER AS bytes FROM part"""
)
def pic_length(spark, sf_dir):
    """Pictures made from each part's size: display, packed, binary, with CR, and edited."""
    n = F.col("p_size")
    say = lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in x])
    kinds = [say("X(", n, ")"), say("S9(", n % 16 + 1, ")V99"), say("9(", n % 18 + 1, ")"), say("9(", n % 9 + 1, ")CR"), say("-9(", n % 9 + 1, ").99")]
    pic, usage = kinds[0], F.lit(None).cast("string")
    for k, kind in enumerate(kinds[1:], 1):
        pic = F.when(F.col("p_partkey") % 5 == k, kind).otherwise(pic)
    usage = F.when(F.col("p_partkey") % 5 == 1, "COMP-3").when(F.col("p_partkey") % 5 == 2, "COMP")
    return table(spark, sf_dir, "part").select("p_partkey", S.pic_length(pic, usage).alias("bytes"))


@registered("SELECT o_orderkey, (CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END * CAST(round(o_totalprice * 100) AS BIGINT))::DECIMAL(18,0) AS pence FROM orders")
def packed_decimal(spark, sf_dir):
    signed = F.when(F.col("o_orderkey") % 2 == 0, -1).otherwise(1) * F.round(F.col("o_totalprice") * 100).cast("long")
    return table(spark, sf_dir, "orders").select("o_orderkey", X.packed(signed, 8).alias("b")).select("o_orderkey", X.unpacked("b").alias("pence"))


@registered("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def xml_item_roundtrip(spark, sf_dir):
    items = table(spark, sf_dir, "orders").select(F.to_xml(F.struct("o_orderkey", "o_orderstatus", "o_orderpriority"), {"rowTag": "Item"}).alias("item"))
    read = items.select(F.from_xml("item", "o_orderkey bigint, o_orderstatus string, o_orderpriority string", {"rowTag": "Item"}).alias("r"))
    return read.select("r.*")


@registered("SELECT o_orderkey, '<Item><key>' || o_orderkey || '</key><status>' || trim(o_orderstatus) || '</status></Item>' AS line FROM orders")
def xml_lines(spark, sf_dir):
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    body = F.concat(tag("key", F.col("o_orderkey").cast("string")), tag("status", F.trim("o_orderstatus")))
    return table(spark, sf_dir, "orders").select("o_orderkey", tag("Item", body).alias("line"))


@registered("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<p[ >]'))::BIGINT AS n_paragraphs FROM pages")
def html_tag_extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<p[ >]")).cast("long").alias("n_paragraphs"))


@registered("SELECT event_id, json_extract_string(props, '$.k') AS k, len(json_keys(props))::BIGINT AS n_keys FROM events")
def json_attributes(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.size(F.json_object_keys("props")).cast("long").alias("n_keys"))


@registered("SELECT c_custkey, split_part(c_custkey || '|' || c_name || '|' || c_mktsegment || '|' || c_nationkey, '|', 3) AS third, 4::BIGINT AS n_fields FROM customer")
def delimited_split(spark, sf_dir):
    line = F.concat_ws("|", F.col("c_custkey").cast("string"), "c_name", "c_mktsegment", F.col("c_nationkey").cast("string"))
    parts = F.split(line, r"\|")
    return table(spark, sf_dir, "customer").select("c_custkey", F.get(parts, F.lit(2)).alias("third"), F.size(parts).cast("long").alias("n_fields"))


@registered(
    """SELECT o_orderkey, trim('  ' || o_orderpriority) AS priority, CAST(strptime(strftime(o_orderdate, '%Y-%m-%d'), '%Y-%m-%d') AS DATE) AS posted,
CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey * 1.25 AS DECIMAL(15,2)) END AS amount, 'LOADED' AS load_status, 'FILE_' || o_orderstatus AS source_file FROM orders WHERE o_custkey IS NOT NULL"""
)
def typed_stage_load(spark, sf_dir):
    raw = table(spark, sf_dir, "orders").where("o_custkey is not null").select(
        "o_orderkey", F.concat(F.lit("  "), "o_orderpriority").alias("p"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), "o_orderstatus",
        F.when(F.col("o_orderkey") % 5 == 0, "n/a").otherwise((F.col("o_orderkey") * F.lit("1.25").cast("decimal(5,2)")).cast("string")).alias("a"),
    )
    return raw.select("o_orderkey", F.trim("p").alias("priority"), F.to_date("d", "yyyy-MM-dd").alias("posted"), F.trim("a").try_cast("decimal(15,2)").alias("amount"), F.lit("LOADED").alias("load_status"), F.concat(F.lit("FILE_"), "o_orderstatus").alias("source_file"))
