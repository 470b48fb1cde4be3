"""Lineage graph queries over edges derived from orders and lineitem."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import graph as G
from weftline.operators import lineage as L
from weftline.operators import sink as K
from weftline.plans.registry import registered
from weftline.session import settled, shared_dir, table

START = "JOB:CUST.1"


def edges(spark: SparkSession, sf_dir: str, files: bool = True, once: bool = True) -> DataFrame:
    """Edges of orders and their lines; with ``once`` equal ones are told apart, which takes a shuffle of all."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    program = F.concat(F.lit("PROGRAM:ORD."), F.col("l_orderkey"))
    part = F.concat(F.lit("TABLE:PART."), F.col("l_partkey"))
    edge = lambda df, s, t, kind: df.select(s.alias("source_id"), t.alias("target_id"), F.lit(kind).alias("edge_type"))
    out = edge(o, F.concat(F.lit("JOB:CUST."), F.col("o_custkey")), F.concat(F.lit("PROGRAM:ORD."), F.col("o_orderkey")), "EXECUTES")
    out = out.union(edge(li.where("l_returnflag <> 'R'"), part, program, "READS_FROM")).union(edge(li.where("l_returnflag = 'R'"), program, part, "WRITES_TO"))
    if files:
        out = out.union(edge(li, program, F.concat(F.lit("FILE:SUPP."), F.col("l_suppkey")), "WRITES_TO"))
    return out.distinct() if once else out


def column_edges(spark: SparkSession, sf_dir: str, once: bool = True) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    p, part, file = F.concat(F.lit("PROGRAM:ORD."), F.col("l_orderkey")), F.concat(F.lit("TABLE:PART."), F.col("l_partkey")), F.concat(F.lit("FILE:SUPP."), F.col("l_suppkey"))
    column = lambda e, c: F.concat(e, F.lit("|"), F.lit(c))
    out = li.select(column(part, "QTY").alias("source_id"), column(p, "QTY").alias("target_id")).union(li.select(column(p, "QTY"), column(file, "QTY")))
    return out.distinct() if once else out


EDGES_SQL = """
e0 AS (
  SELECT DISTINCT * FROM (
    SELECT 'JOB:CUST.' || o_custkey AS source_id, 'PROGRAM:ORD.' || o_orderkey AS target_id, 'EXECUTES' AS edge_type FROM orders
    UNION ALL SELECT 'TABLE:PART.' || l_partkey, 'PROGRAM:ORD.' || l_orderkey, 'READS_FROM' FROM lineitem WHERE l_returnflag <> 'R'
    UNION ALL SELECT 'PROGRAM:ORD.' || l_orderkey, 'TABLE:PART.' || l_partkey, 'WRITES_TO' FROM lineitem WHERE l_returnflag = 'R')),
e AS (SELECT * FROM e0 UNION SELECT DISTINCT 'PROGRAM:ORD.' || l_orderkey, 'FILE:SUPP.' || l_suppkey, 'WRITES_TO' FROM lineitem),
ce AS (
  SELECT DISTINCT 'TABLE:PART.' || l_partkey || '|QTY' AS source_id, 'PROGRAM:ORD.' || l_orderkey || '|QTY' AS target_id FROM lineitem
  UNION SELECT DISTINCT 'PROGRAM:ORD.' || l_orderkey || '|QTY', 'FILE:SUPP.' || l_suppkey || '|QTY' FROM lineitem)"""


def _bfs_sql(edge_table: str, depth: int) -> str:
    """Distances up to ``depth`` from START as the table d."""
    return f"""
adj AS (SELECT source_id AS a, target_id AS b FROM {edge_table} UNION SELECT target_id, source_id FROM {edge_table}),
bfs AS (SELECT '{START}' AS id, 0 AS dist UNION SELECT adj.b, bfs.dist + 1 FROM bfs JOIN adj ON adj.a = bfs.id WHERE bfs.dist < {depth}),
d AS (SELECT id, min(dist)::BIGINT AS dist FROM bfs GROUP BY id)"""


def _near_sql(depth: int) -> str:
    return f"""WITH RECURSIVE {EDGES_SQL}, {_bfs_sql("e", depth - 1)}
SELECT DISTINCT e.source_id, e.target_id, e.edge_type FROM e WHERE source_id IN (SELECT id FROM d) OR target_id IN (SELECT id FROM d)"""


@registered(f"WITH {EDGES_SQL} SELECT *, substr(sha1(source_id || '|' || edge_type || '|' || target_id || '|None|None'), 1, 16) AS edge_id FROM e")
def graph_edges(spark, sf_dir):
    none = F.lit(None)
    return edges(spark, sf_dir).withColumn("edge_id", G.edge_id(F.col("source_id"), F.col("edge_type"), F.col("target_id"), none, none))


@registered("SELECT l_orderkey, l_linenumber, substr(sha1('TABLE:PART.' || l_partkey || '|READS_FROM|PROGRAM:ORD.' || l_orderkey || '|P' || l_suppkey || '|' || l_returnflag), 1, 16) AS edge_id FROM lineitem")
def edge_ids_sha1(spark, sf_dir):
    s, t = F.concat(F.lit("TABLE:PART."), F.col("l_partkey")), F.concat(F.lit("PROGRAM:ORD."), F.col("l_orderkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", G.edge_id(s, F.lit("READS_FROM"), t, F.concat(F.lit("P"), F.col("l_suppkey")), F.col("l_returnflag")).alias("edge_id"))


@registered(
    f"""WITH {EDGES_SQL}, n AS (SELECT source_id AS id FROM e UNION SELECT target_id FROM e),
c AS (SELECT 'TABLE:PART.' || l_partkey AS owner_id, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1)
SELECT id, split_part(id, ':', 1) AS kind, coalesce(n, 0)::BIGINT AS n_columns FROM n LEFT JOIN c ON owner_id = id"""
)
def entity_catalogue(spark, sf_dir):
    columns = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("TABLE:PART."), F.col("l_partkey")).alias("owner_id"), F.concat(F.lit("L"), F.col("l_linenumber")).alias("name")).distinct()
    return G.column_counts(G.nodes_of(edges(spark, sf_dir)), columns)


@registered(_near_sql(1))
def neighbourhood_d1(spark, sf_dir):
    return G.neighbourhood(edges(spark, sf_dir, once=False), START, 1)


@registered(_near_sql(2))
def neighbourhood_d2(spark, sf_dir):
    return G.neighbourhood(edges(spark, sf_dir, once=False), START, 2)


@registered(_near_sql(3))
def neighbourhood_d3(spark, sf_dir):
    return G.neighbourhood(edges(spark, sf_dir, once=False), START, 3)


@registered(
    f"""WITH RECURSIVE {EDGES_SQL}, {_bfs_sql("e", 1)},
near AS (SELECT * FROM e WHERE source_id IN (SELECT id FROM d) OR target_id IN (SELECT id FROM d)),
ids AS (SELECT source_id AS id FROM near UNION SELECT target_id FROM near)
SELECT source_id, target_id FROM ce WHERE regexp_extract(source_id, '^(.*)\\|[^|]*$', 1) IN (SELECT id FROM ids)
AND regexp_extract(target_id, '^(.*)\\|[^|]*$', 1) IN (SELECT id FROM ids)"""
)
def neighbourhood_columns(spark, sf_dir):
    return G.neighbourhood_columns(edges(spark, sf_dir, once=False), column_edges(spark, sf_dir, once=False), START, 2).distinct()


CHAIN_SQL = """
ch AS (
  SELECT 'TABLE:REGION|' || r_regionkey AS source_id, 'TABLE:NATION|' || n_nationkey AS target_id FROM region JOIN nation ON n_regionkey = r_regionkey
  UNION ALL SELECT 'TABLE:NATION|' || c_nationkey, 'TABLE:CUSTOMER|' || c_custkey FROM customer
  UNION ALL SELECT 'TABLE:CUSTOMER|' || o_custkey, 'TABLE:ORDERS|' || o_orderkey FROM orders)"""


def _chain(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    col = lambda kind, key: F.concat(F.lit(f"TABLE:{kind}|"), F.col(key))
    out = t("region").join(t("nation"), F.col("n_regionkey") == F.col("r_regionkey")).select(col("REGION", "r_regionkey").alias("source_id"), col("NATION", "n_nationkey").alias("target_id"))
    out = out.union(t("customer").select(col("NATION", "c_nationkey"), col("CUSTOMER", "c_custkey")))
    return out.union(t("orders").select(col("CUSTOMER", "o_custkey"), col("ORDERS", "o_orderkey")))


@registered(
    f"""WITH RECURSIVE {CHAIN_SQL}, r AS (SELECT 'TABLE:REGION|1' AS id, 0 AS dist UNION SELECT target_id, dist + 1 FROM r JOIN ch ON source_id = id WHERE dist < 8)
SELECT id, min(dist)::BIGINT AS dist FROM r GROUP BY id"""
)
def column_path_down(spark, sf_dir):
    return G.distances(_chain(spark, sf_dir), spark.createDataFrame([("TABLE:REGION|1",)], "id string"), 8, "down")


@registered(
    f"""WITH RECURSIVE {CHAIN_SQL}, r AS (SELECT 'TABLE:ORDERS|' || o_orderkey AS id, 0 AS dist FROM orders WHERE o_custkey = 5 UNION SELECT source_id, dist + 1 FROM r JOIN ch ON target_id = id WHERE dist < 8)
SELECT id, min(dist)::BIGINT AS dist FROM r GROUP BY id"""
)
def column_path_up(spark, sf_dir):
    start = table(spark, sf_dir, "orders").where("o_custkey = 5").select(F.concat(F.lit("TABLE:ORDERS|"), F.col("o_orderkey")).alias("id"))
    return G.distances(_chain(spark, sf_dir), start, 8, "up")


@registered(
    f"""WITH {EDGES_SQL} SELECT r.source_id, count(*) AS n_flows FROM e r JOIN e w ON w.source_id = r.target_id AND w.edge_type = 'WRITES_TO'
WHERE r.edge_type = 'READS_FROM' AND w.target_id <> r.source_id GROUP BY r.source_id"""
)
def data_flow(spark, sf_dir):
    return G.data_flow_counts(edges(spark, sf_dir))


@registered(
    f"""WITH {EDGES_SQL} SELECT w.target_id AS entity, count(*) AS n_handoffs FROM e w JOIN e r ON r.source_id = w.target_id AND r.edge_type = 'READS_FROM'
WHERE w.edge_type = 'WRITES_TO' AND w.source_id <> r.target_id GROUP BY w.target_id"""
)
def process_handoff(spark, sf_dir):
    return G.handoff_counts(edges(spark, sf_dir))


@registered(
    f"""WITH {EDGES_SQL} SELECT DISTINCT split_part(source_id, '|', 1) AS source_id, split_part(target_id, '|', 1) AS target_id, 'READS_FROM' AS edge_type FROM ce
WHERE target_id LIKE 'PROGRAM:%' AND NOT EXISTS (SELECT 1 FROM e WHERE edge_type = 'READS_FROM' AND e.source_id = split_part(ce.source_id, '|', 1) AND e.target_id = split_part(ce.target_id, '|', 1))"""
)
def reconcile_missing_reads(spark, sf_dir):
    return G.missing_reads(edges(spark, sf_dir), column_edges(spark, sf_dir))


@registered(f"WITH {EDGES_SQL} SELECT source_id, target_id, edge_type FROM e WHERE source_id LIKE 'TABLE:%' AND NOT EXISTS (SELECT 1 FROM part WHERE p_size > 10 AND 'TABLE:PART.' || p_partkey = source_id)")
def orphan_endpoints(spark, sf_dir):
    known = table(spark, sf_dir, "part").where("p_size > 10").select(F.concat(F.lit("TABLE:PART."), F.col("p_partkey")).alias("source_id"))
    return edges(spark, sf_dir).where("source_id like 'TABLE:%'").join(known, "source_id", "left_anti").select("source_id", "target_id", "edge_type")


@registered(
    """WITH m AS (SELECT 'PART.' || l_partkey AS id, CASE WHEN l_linenumber > 1 THEN 'F' || l_suppkey END AS path, l_orderkey * 10 + l_linenumber AS seq, l_returnflag || l_linestatus AS c FROM lineitem)
SELECT id, min_by(path, seq) FILTER (WHERE path IS NOT NULL) AS path, string_agg(DISTINCT c, ',' ORDER BY c) AS columns FROM m GROUP BY id"""
)
def node_dedupe(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return G.dedupe_nodes(
        li.select(
            F.concat(F.lit("PART."), F.col("l_partkey")).alias("id"),
            F.when(F.col("l_linenumber") > 1, F.concat(F.lit("F"), F.col("l_suppkey"))).alias("path"),
            F.array(F.concat("l_returnflag", "l_linestatus")).alias("columns"),
            # rows of one number stand in the order of their files, as one reader meets them
            F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("n"), "_metadata.file_path", "_metadata.row_index").alias("seq"),
        )
    )


@registered(f"WITH RECURSIVE {EDGES_SQL}, {_bfs_sql('e0', 4)} SELECT dist, count(*) AS n_nodes FROM d GROUP BY dist")
def impact_depth(spark, sf_dir):
    start = spark.createDataFrame([(START,)], "id string")
    return G.distances(edges(spark, sf_dir, files=False), start, 4).groupBy("dist").agg(F.count("*").alias("n_nodes"))


@registered(
    """WITH RECURSIVE s AS (SELECT p_partkey AS target, p_partkey // 2 AS source FROM part WHERE p_partkey > 1),
r AS (SELECT target, source, 1 AS dist FROM s UNION SELECT r.target, s.source, r.dist + 1 FROM r JOIN s ON s.target = r.source WHERE r.dist < 12)
SELECT target, source AS terminal, min(dist)::BIGINT AS dist FROM r WHERE source NOT IN (SELECT target FROM s) GROUP BY target, source"""
)
def reachability_closure(spark, sf_dir):
    steps = table(spark, sf_dir, "part").where("p_partkey > 1").select(F.col("p_partkey").alias("target"), F.expr("p_partkey div 2").alias("source"))
    return G.terminals(steps)


@registered(
    f"""WITH {EDGES_SQL}, m AS (SELECT 'FILE:SUPP.' || s_suppkey AS old, 'FILE:NATION.' || s_nationkey AS new FROM supplier WHERE s_acctbal > 0)
SELECT DISTINCT source_id, coalesce(new, target_id) AS target_id, edge_type FROM e LEFT JOIN m ON old = target_id"""
)
def template_absorption(spark, sf_dir):
    aliases = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("FILE:SUPP."), F.col("s_suppkey")).alias("old"), F.concat(F.lit("FILE:NATION."), F.col("s_nationkey")).alias("new"))
    return G.absorb(edges(spark, sf_dir), aliases)


@registered(
    f"""WITH {EDGES_SQL}, n AS (SELECT source_id AS id FROM e UNION SELECT target_id FROM e)
SELECT id, CASE WHEN id LIKE 'JOB:%' OR id LIKE 'PROGRAM:%' THEN 'process' WHEN id LIKE 'FILE:%' THEN 'file' WHEN id LIKE '%5' THEN 'view' WHEN id LIKE '%7' THEN 'external' ELSE 'table' END AS entity_type,
CASE WHEN id LIKE 'JOB:%' THEN 'job ' WHEN id LIKE 'PROGRAM:%' THEN 'program ' ELSE '' END || split_part(id, ':', 2) AS label FROM n"""
)
def entity_typing(spark, sf_dir):
    i = F.col("id")
    kind = F.when(i.like("JOB:%") | i.like("PROGRAM:%"), "process").when(i.like("FILE:%"), "file").when(i.like("%5"), "view").when(i.like("%7"), "external").otherwise("table")
    prefix = F.when(i.like("JOB:%"), "job ").when(i.like("PROGRAM:%"), "program ").otherwise("")
    return G.nodes_of(edges(spark, sf_dir)).select("id", kind.alias("entity_type"), F.concat(prefix, F.element_at(F.split("id", ":"), 2)).alias("label"))


@registered(
    """WITH t AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE '["' || event_type || '","' || user_id || '"]' END AS steps, 'MOVE ' || event_type || '; ADD ' || user_id AS transformation FROM events)
SELECT event_id, CASE WHEN steps IS NULL THEN split_part(transformation, '; ', 1) ELSE json_extract_string(steps, '$[0]') END AS first_step,
CASE WHEN steps IS NULL THEN 2 ELSE json_array_length(steps) END::BIGINT AS n_steps FROM t"""
)
def step_fallback(spark, sf_dir):
    t = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_id") % 3 != 0, F.to_json(F.array("event_type", F.col("user_id").cast("string")))).alias("steps"),
        F.concat(F.lit("MOVE "), "event_type", F.lit("; ADD "), F.col("user_id")).alias("transformation"),
    )
    steps = F.coalesce(F.from_json("steps", "array<string>"), F.split("transformation", "; "))
    return t.select("event_id", F.get(steps, F.lit(0)).alias("first_step"), F.size(steps).cast("long").alias("n_steps"))


@registered(
    f"""WITH {EDGES_SQL}, a AS (SELECT * FROM ce WHERE source_id = 'TABLE:PART.1|QTY'), b AS (SELECT * FROM ce WHERE source_id IN (SELECT target_id FROM a) AND target_id LIKE 'FILE:%'),
p AS (SELECT *, 1 AS dist FROM a WHERE target_id IN (SELECT source_id FROM b) UNION ALL SELECT *, 2 FROM b)
SELECT source_id, target_id, dist::BIGINT AS dist, substr(sha1(source_id || '|TRANSFORMS_TO|' || target_id || '|None|None'), 1, 16) AS edge_id FROM p"""
)
def column_path_edges(spark, sf_dir):
    found = column_edges(spark, sf_dir)
    files = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("FILE:SUPP."), F.col("l_suppkey"), F.lit("|QTY")).alias("id"))
    paths = G.shortest_path_edges(found, spark.createDataFrame([("TABLE:PART.1|QTY",)], "id string"), files)
    none = F.lit(None)
    return paths.select("source_id", "target_id", "dist", G.edge_id(F.col("source_id"), F.lit("TRANSFORMS_TO"), F.col("target_id"), none, none).alias("edge_id"))


@registered(
    """WITH RECURSIVE site AS (
  SELECT 'S' || s_suppkey AS program, 1 AS seq, 'N' || s_nationkey AS callee FROM supplier UNION SELECT 'N' || n_nationkey, 2, 'R' || n_regionkey FROM nation
  UNION SELECT 'R' || r_regionkey, 3, 'R' || (r_regionkey + 1) % 5 FROM region),
run AS (
  SELECT program, '' AS chain, [program] AS members FROM (SELECT program FROM site UNION SELECT callee FROM site)
  UNION ALL SELECT s.callee, CASE WHEN r.chain = '' THEN '' ELSE r.chain || '>' END || s.program || '#' || s.seq, list_append(r.members, s.callee) FROM run r JOIN site s ON s.program = r.program WHERE NOT list_contains(r.members, s.callee))
SELECT program, chain FROM run"""
)
def call_strings(spark, sf_dir):
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    name = lambda p, c: F.concat(F.lit(p), F.col(c) if isinstance(c, str) else c)
    site = lambda df, caller, seq, callee: df.select(caller.alias("program"), F.lit(seq).alias("seq"), callee.alias("callee"))
    sites = site(s, name("S", "s_suppkey"), 1, name("N", "s_nationkey")).union(site(n, name("N", "n_nationkey"), 2, name("R", "n_regionkey"))).union(site(r, name("R", "r_regionkey"), 3, name("R", (F.col("r_regionkey") + 1) % 5)))
    return L.call_contexts(sites.select("program").union(sites.select("callee")), sites)[0]


def _batches(spark, sf_dir):
    """Two loads of edges of which some are the same: an order's line is loaded again with another transformation, and half of the orders are new."""
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(F.concat_ws(".", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("edge_id"), F.concat(F.lit("TABLE:PART."), "l_partkey").alias("source_id"), F.concat(F.lit("PROGRAM:ORD."), "l_orderkey").alias("target_id"), "l_orderkey", "l_linenumber", F.col("l_suppkey").cast("string").alias("transformation"))
    first = rows.where("l_orderkey % 2 = 0").drop("l_orderkey", "l_linenumber")
    second = rows.where("l_orderkey % 2 = 1 or l_linenumber = 1").withColumn("transformation", F.concat(F.lit("again "), "transformation")).drop("l_orderkey", "l_linenumber")
    return first, second


@registered(
    """SELECT DISTINCT l_orderkey || '.' || l_linenumber || '.' || l_partkey || '.' || l_suppkey AS edge_id, 'TABLE:PART.' || l_partkey AS source_id, 'PROGRAM:ORD.' || l_orderkey AS target_id,
CASE WHEN l_orderkey % 2 = 1 OR l_linenumber = 1 THEN 'again ' ELSE '' END || l_suppkey AS transformation FROM lineitem"""
)
def graph_upsert(spark, sf_dir):
    path = f"{shared_dir(spark)}/weftline-graph-{uuid.uuid4().hex}/edges"
    first, second = _batches(spark, sf_dir)
    for rows in (first, second, second):  # a load that is repeated changes nothing
        stored = K.upsert(rows, path, K.KEYS["edges"])
    return stored


@registered(
    f"""WITH {EDGES_SQL} SELECT 'edges' AS kind, to_json({{source_id: source_id, target_id: target_id, edge_type: edge_type}})::VARCHAR AS entry FROM e
UNION ALL SELECT 'nodes', to_json({{id: id}})::VARCHAR FROM (SELECT source_id AS id FROM e UNION SELECT target_id FROM e)"""
)
def graph_export(spark, sf_dir):
    path = f"{shared_dir(spark)}/weftline-export-{uuid.uuid4().hex}"
    e = edges(spark, sf_dir, once=False)  # the export tells equal rows apart
    # nodes are written, as the export reads its tables more than once
    K.export_json(path, "gzip", nodes=settled(G.nodes_of(e)), edges=e, dynamic_constructs=e.limit(0), unparsed=e.limit(0))
    lines = spark.read.text(path).select(F.regexp_replace("value", "^,", "").alias("entry")).where("entry like '{%}'")
    return lines.select(F.when(F.get_json_object("entry", "$.edge_type").isNull(), "nodes").otherwise("edges").alias("kind"), "entry")
