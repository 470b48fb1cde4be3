"""Statement analytics: facts taken from statement texts that are derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import window as W

from weftline.functions import scalars as S
from weftline.operators import lineage as L
from weftline.operators import scopes as SC
from weftline.plans.registry import registered
from weftline.session import table

STMT_SQL = """s AS (SELECT o_orderkey AS seq, CASE o_orderkey % 6
  WHEN 0 THEN 'MOVE WS-A' || o_custkey || ' TO OUT-A' WHEN 1 THEN 'COMPUTE T' || o_custkey || ' = P' || o_orderkey % 9 || ' * Q' || o_orderkey % 7
  WHEN 2 THEN 'EXEC SQL FETCH C' || o_custkey % 5 || ' INTO :H' WHEN 3 THEN 'EXEC SQL UPDATE T SET A = ''x y'' END-EXEC'
  WHEN 4 THEN 'UNSTRING X' || o_custkey || ' INTO Y' ELSE 'CALL ''SUB' || o_custkey % 4 || ''' USING A B' END AS stmt FROM orders)"""


def _stmts(spark, sf_dir):
    t = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    kinds = [t("MOVE WS-A", c, " TO OUT-A"), t("COMPUTE T", c, " = P", k % 9, " * Q", k % 7), t("EXEC SQL FETCH C", c % 5, " INTO :H"), F.lit("EXEC SQL UPDATE T SET A = 'x y' END-EXEC"), t("UNSTRING X", c, " INTO Y"), t("CALL 'SUB", c % 4, "' USING A B")]
    stmt = None
    for n, x in enumerate(kinds):
        stmt = F.when(k % 6 == n, x) if stmt is None else stmt.when(k % 6 == n, x)
    return table(spark, sf_dir, "orders").select(F.lit("P").alias("program"), k.alias("seq"), stmt.alias("stmt")).withColumn("verb", F.substring_index("stmt", " ", 1))


@registered(f"WITH {STMT_SQL} SELECT seq, regexp_extract(stmt, '^MOVE (\\S+) TO', 1) AS source, regexp_extract(stmt, ' TO (\\S+)$', 1) AS target FROM s WHERE stmt LIKE 'MOVE %'")
def move_extract(spark, sf_dir):
    return L.transforms(_stmts(spark, sf_dir)).where("kind = 'MOVE'").select("seq", "source", "target")


@registered(f"WITH {STMT_SQL}, c AS (SELECT seq, regexp_extract(stmt, '^COMPUTE (\\S+)', 1) AS target, stmt FROM s WHERE stmt LIKE 'COMPUTE %') SELECT seq, target, regexp_extract(stmt, '= (\\S+)', 1) AS source FROM c UNION SELECT seq, target, regexp_extract(stmt, '\\* (\\S+)', 1) FROM c")
def compute_sources(spark, sf_dir):
    return L.transforms(_stmts(spark, sf_dir)).where("kind = 'COMPUTE'").select("seq", "target", "source")


@registered(f"WITH {STMT_SQL} SELECT regexp_extract(stmt, '^EXEC SQL (\\w+)', 1) AS verb, count(*) AS n FROM s WHERE stmt LIKE 'EXEC SQL %' GROUP BY 1")
def exec_verb_histogram(spark, sf_dir):
    return _stmts(spark, sf_dir).where("verb = 'EXEC'").groupBy(F.regexp_extract("stmt", r"^EXEC SQL (\w+)", 1).alias("verb")).agg(F.count("*").alias("n"))


@registered(f"WITH {STMT_SQL} SELECT seq, regexp_replace(stmt, '''[^'']*''', '', 'g') AS bare FROM s")
def literal_strip(spark, sf_dir):
    return _stmts(spark, sf_dir).select("seq", S.without_literals(F.col("stmt")).alias("bare"))


@registered(f"WITH {STMT_SQL} SELECT seq, CASE WHEN seq % 6 = 3 THEN replace(stmt, '''x y''', '     ') WHEN seq % 6 = 5 THEN regexp_replace(stmt, '''SUB.''', '      ') ELSE stmt END AS blanked FROM s")
def literal_blank(spark, sf_dir):
    return _stmts(spark, sf_dir).select("seq", S.blank_literals(F.col("stmt")).alias("blanked"))


@registered(f"WITH {STMT_SQL} SELECT CASE WHEN stmt LIKE 'UNSTRING %' THEN 'COBOL_UNSTRING' ELSE 'EXEC_SQL_UPDATE' END AS statement_type, count(*) AS n FROM s WHERE seq % 6 IN (3, 4) GROUP BY 1")
def detector_hits(spark, sf_dir):
    s = _stmts(spark, sf_dir)
    return L.cobol_gaps(s, None).groupBy("statement_type").agg(F.count("*").alias("n"))


@registered("WITH h AS (SELECT o_orderkey AS k, o_custkey % 100 AS pos FROM orders), sp AS (SELECT o_orderkey AS k, x * 30 AS lo, x * 30 + 20 AS hi FROM orders, (VALUES (0), (1), (2)) t(x)) SELECT k, pos FROM h WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.k = h.k AND pos >= lo AND pos < hi)")
def coverage_after_spans(spark, sf_dir):
    hits = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 100).alias("pos"))
    spans = hits.select("k", F.explode(F.array(*[F.lit(x) for x in (0, 1, 2)])).alias("x")).select("k", (F.col("x") * 30).alias("lo"), (F.col("x") * 30 + 20).alias("hi"))
    return hits.join(spans, (hits["k"] == spans["k"]) & (F.col("pos") >= F.col("lo")) & (F.col("pos") < F.col("hi")), "left_anti")


@registered("SELECT o_orderkey AS seq, 'T' || o_custkey % 3 || '|A' || o_orderkey % 5 AS first_source, 2::BIGINT AS n_sources FROM orders")
def select_items_sources(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    expr = F.concat(F.lit("NVL(X.A"), k % 5, F.lit(", Y.B) || ' FROM Z.Q'"))
    tables = L.table_aliases(F.concat(F.lit("T"), c % 3, F.lit(" X LEFT JOIN U AS Y ON X.K = Y.K")))
    s = L.source_columns(expr, tables)
    return table(spark, sf_dir, "orders").select(k.alias("seq"), F.get(s, F.lit(0)).alias("first_source"), F.size(s).cast("long").alias("n_sources"))


@registered("SELECT c_custkey, 'TAB' || c_nationkey AS table_x, 'OTHER' AS table_y FROM customer")
def alias_resolution(spark, sf_dir):
    m = L.table_aliases(F.concat(F.lit("TAB"), F.col("c_nationkey"), F.lit(" X, OTHER Y")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.element_at(m, F.lit("X")).alias("table_x"), F.element_at(m, F.lit("Y")).alias("table_y"))


@registered("SELECT s_suppkey, 'PROD.D' || s_nationkey || '.F' || s_suppkey AS dsn FROM supplier")
def symbol_substitution(spark, sf_dir):
    from weftline.sources.estate import substituted

    s = table(spark, sf_dir, "supplier")
    path = F.col("s_suppkey").cast("string").alias("path")
    sets = s.select(path, F.lit("SET").alias("op"), F.lit(1).alias("line"), F.concat(F.lit("ENV=PROD,NAT=D"), F.col("s_nationkey"), F.lit(",HLQ=&ENV..&NAT")).alias("operands"))
    dds = s.select(path, F.lit("DD").alias("op"), F.lit(2).alias("line"), F.concat(F.lit("&HLQ..F"), F.col("s_suppkey")).alias("operands"))
    return substituted(sets.unionByName(dds)).where("op = 'DD'").select(F.col("path").cast("long").alias("s_suppkey"), F.col("operands").alias("dsn"))


@registered(
    """WITH l AS (SELECT DISTINCT l_orderkey AS job, l_linenumber AS line, l_linenumber = 1 OR l_linenumber % 3 <> 0 AS starts FROM lineitem),
n AS (SELECT job, line, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY job ORDER BY line) AS stmt FROM l)
SELECT job, stmt::BIGINT AS stmt, min(line) AS first_line, count(*) AS n_lines FROM n GROUP BY job, stmt"""
)
def continuation_sessionise(spark, sf_dir):
    line = F.col("l_linenumber")
    ls = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job"), line.alias("line"), ((line == 1) | (line % 3 != 0)).alias("starts")).distinct()
    n = ls.withColumn("stmt", F.sum(F.col("starts").cast("long")).over(W.Window.partitionBy("job").orderBy("line")))
    return n.groupBy("job", "stmt").agg(F.min("line").alias("first_line"), F.count("*").alias("n_lines"))


#: One script for each part, all of one member name; what is expected follows from the key alone.
SCOPE_SQL = """k AS (SELECT 'S' || p_partkey AS path, p_partkey % 6 AS kind, 'T' || p_partkey AS t, 'X' || p_partkey % 7 AS x, 'B' || p_partkey % 11 AS b, 'Y' || p_partkey % 3 AS y, 'P' || p_partkey % 5 AS p FROM part)"""


def _scripts(spark, sf_dir):
    key = F.col("p_partkey")
    t, x, b, y, p = (F.concat(F.lit(c), (key % m if m else key).cast("string")) for c, m in (("T", 0), ("X", 7), ("B", 11), ("Y", 3), ("P", 5)))
    say = lambda *parts: F.concat(*[F.lit(part) if isinstance(part, str) else part for part in parts])
    kinds = [
        say("INSERT INTO ", t, " (A, B) SELECT q.", p, ", q.R FROM (SELECT ", p, ", Q AS R FROM ", x, ") q"),
        say("INSERT INTO ", t, " (A) WITH u AS (SELECT ", p, ", Q FROM ", x, "), v AS (SELECT u.", p, " + u.Q AS S FROM u) SELECT v.S FROM v"),
        say("MERGE INTO ", t, " USING (SELECT K, V + ", p, " AS VW FROM ", x, ") S ON (", t, ".K = S.K) WHEN MATCHED THEN UPDATE SET A = S.VW WHEN NOT MATCHED THEN INSERT (K, A) VALUES (S.K, S.VW)"),
        say("UPDATE ", t, " a SET (P, Q) = (SELECT b.M, b.", p, " FROM ", b, " b WHERE b.K = a.K), a.Z = a.W"),
        say("CREATE VIEW ", t, " AS SELECT * FROM (SELECT ", p, " AS C1, Q AS C2 FROM ", x, " UNION ALL SELECT R, S FROM ", y, ")"),
        say("INSERT INTO ", t, " (A, B) SELECT z.P, x.Q FROM ", x, " x"),
    ]
    text = kinds[0]
    for n, kind in enumerate(kinds[1:], 1):
        text = F.when(key % 6 == n, kind).otherwise(text)
    return L.sql_statements(table(spark, sf_dir, "part").select(F.concat(F.lit("S"), key.cast("string")).alias("path"), F.lit("M").alias("member"), F.lit("SQL").alias("language"), F.concat(text, F.lit(";")).alias("text")))


@registered(
    f"""WITH {SCOPE_SQL}
SELECT path, t AS target, 'A' AS target_column, x || '|' || p AS source FROM k WHERE kind IN (0, 1, 2) UNION ALL SELECT path, t, 'B', x || '|Q' FROM k WHERE kind IN (0, 5)
UNION ALL SELECT path, t, 'A', x || '|Q' FROM k WHERE kind = 1 UNION ALL SELECT path, t, 'A', x || '|V' FROM k WHERE kind = 2 UNION ALL SELECT path, t, 'K', x || '|K' FROM k WHERE kind = 2
UNION ALL SELECT path, t, 'P', b || '|M' FROM k WHERE kind = 3 UNION ALL SELECT path, t, 'Q', b || '|' || p FROM k WHERE kind = 3 UNION ALL SELECT path, t, 'Z', t || '|W' FROM k WHERE kind = 3
UNION ALL SELECT path, t, 'C1', x || '|' || p FROM k WHERE kind = 4 UNION ALL SELECT path, t, 'C2', x || '|Q' FROM k WHERE kind = 4
UNION ALL SELECT path, t, 'C1', y || '|R' FROM k WHERE kind = 4 UNION ALL SELECT path, t, 'C2', y || '|S' FROM k WHERE kind = 4"""
)
def scope_columns(spark, sf_dir):
    columns, _ = SC.scope_columns(_scripts(spark, sf_dir))
    return columns.select("path", "target", "target_column", "source").distinct()


@registered(f"WITH {SCOPE_SQL} SELECT path, 'SQL_DML_UNMAPPED' AS statement_type, 'INSERT INTO ' || t || ' (A, B) SELECT Z.P, X.Q FROM ' || x || ' X' AS snippet FROM k WHERE kind = 5")
def scope_gaps(spark, sf_dir):
    stmts = _scripts(spark, sf_dir)
    return SC.scope_unmapped(stmts, *SC.scope_columns(stmts)).select("path", "statement_type", "snippet")
