"""Queries of source places: copybooks in copybooks, and the file and line of facts and gaps.

Every supplier has a program whose copybooks follow each other one to six deep; the last one copies
the first again, or one that isn't there. What is expected follows from the supplier's key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import lineage as L
from weftline.plans.registry import registered
from weftline.session import settled, table
from weftline.sources import estate as E

MAIN = """       IDENTIFICATION DIVISION.
       PROGRAM-ID. PG@.
       PROCEDURE DIVISION.
{}           COPY BK@-1 REPLACING ==OLD-1==
               BY ==NEW-1==.
           UNSTRING A INTO C.
"""
BOOK = """      * COPY NOTHING.
           MOVE OLD-#X TO OLD-#.
           COPY {}.
           MOVE A-# TO B-#.
"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    key, depth = k.cast("string"), k % 6 + 1
    put = lambda text, at, by: F.replace(text, F.lit(at), by)
    s = table(spark, sf_dir, "supplier")
    folder = F.concat(F.lit("/e/"), key, F.lit("/"))
    head, tail = MAIN.split("{}")
    main = s.select(F.concat(folder, F.lit("MAIN.cbl")).alias("path"), F.lit("MAIN").alias("member"), F.lit("COBOL").alias("language"), put(F.concat(F.lit(head), F.repeat(F.lit("           DISPLAY 'X'.\n"), (k % 3).cast("int")), F.lit(tail)), "@", key).alias("text"))
    each = s.select("s_suppkey", F.explode(F.sequence(F.lit(1), depth)).alias("i"))
    next_ = F.when(F.col("i") < depth, F.concat(F.lit("BK"), key, F.lit("-"), (F.col("i") + 1).cast("string"))).when(k % 2 == 0, F.concat(F.lit("BK"), key, F.lit("-1"))).otherwise(F.concat(F.lit("NONE"), key))
    name = F.concat(F.lit("BK"), key, F.lit("-"), F.col("i").cast("string"))
    books = each.select(F.concat(folder, name, F.lit(".cpy")).alias("path"), name.alias("member"), F.lit("COPYBOOK").alias("language"), put(put(F.lit(BOOK), "{}", next_), "#", F.col("i").cast("string")).alias("text"))
    return main.unionByName(books)


@registered(
    """SELECT 'PG' || s_suppkey AS program, x.source AS source, x.target AS target, '/e/' || s_suppkey || '/BK' || s_suppkey || '-' || i || '.cpy' AS file, x.line AS line
FROM supplier, unnest(range(1, s_suppkey % 6 + 2)) AS u(i), LATERAL (VALUES ('OLD-' || i || 'X', CASE WHEN i = 1 THEN 'NEW-1' ELSE 'OLD-' || i END, 2), ('A-' || i, 'B-' || i, 4)) AS x(source, target, line)"""
)
def copy_fixpoint(spark, sf_dir):
    """Moves of copybooks in copybooks, with the book and line that each stands in."""
    lines = E.cobol_lines(_files(spark, sf_dir))
    stmts = settled(E.placed(E.statements(E.programs(lines)), E.line_starts(lines)))
    return L.transforms(stmts).join(stmts.select("program", "seq", "file", "line"), ["program", "seq"]).select("program", "source", "target", "file", "line")


@registered(
    """SELECT 'PG' || s_suppkey AS program, 'COBOL_UNSTRING' AS statement_type, 'UNSTRING A INTO C' AS snippet, '/e/' || s_suppkey || '/MAIN.cbl' AS file, (s_suppkey % 3 + 6)::INTEGER AS line FROM supplier
UNION ALL SELECT 'MAIN', 'COBOL_COPY', CASE WHEN s_suppkey % 2 = 0 THEN 'COPY BK' || s_suppkey || '-1.: cycle' ELSE 'COPY NONE' || s_suppkey || '.: missing' END, '/e/' || s_suppkey || '/BK' || s_suppkey || '-' || (s_suppkey % 6 + 1) || '.cpy', 3 FROM supplier"""
)
def gap_lines(spark, sf_dir):
    """Gaps with file and line: a statement after lines of copybooks, and the COPY lines that can't be followed."""
    lines = E.cobol_lines(_files(spark, sf_dir))
    stmts = settled(E.placed(E.statements(E.programs(lines)), E.line_starts(lines)))
    cols = ["program", "statement_type", "snippet", "file", "line"]
    told = L.cobol_gaps(stmts, None).join(stmts.select("program", "seq", "file", "line"), ["program", "seq"])
    return told.select(*cols).unionByName(E.copy_gaps(lines).select(*cols))


SQL_TEXT = "-- header; of ß\n/* two\n lines; */ INSERT INTO T@ (A, B)\n  SELECT 'x;\n\n--y', B FROM S@;\n{}  MERGE  INTO T@ t USING S@ s ON (t.A = s.B)\n WHEN MATCHED THEN UPDATE SET t.A = s.C;\r\nEND;\n"


@registered(
    """SELECT 'Q' || p_partkey AS program, x.seq AS seq, x.line::INTEGER AS line, x.verb AS verb FROM part,
LATERAL (VALUES (0, 3, 'INSERT'), (1, p_partkey % 4 + 7, 'MERGE'), (2, p_partkey % 4 + 9, 'END')) AS x(seq, line, verb)"""
)
def sql_statement_lines(spark, sf_dir):
    """Statements of a script for each part with the line they begin in, past comments and literals of several lines."""
    key = F.col("p_partkey").cast("string")
    head, tail = SQL_TEXT.split("{}")
    text = F.replace(F.concat(F.lit(head), F.repeat(F.lit("\n"), (F.col("p_partkey") % 4).cast("int")), F.lit(tail)), F.lit("@"), key)
    f = table(spark, sf_dir, "part").select(F.concat(F.lit("/q/"), key, F.lit(".sql")).alias("path"), F.concat(F.lit("Q"), key).alias("member"), F.lit("SQL").alias("language"), text.alias("text"))
    return E.placed(L.sql_statements(f), E.text_line_starts(f)).select("program", "seq", "line", F.substring_index("stmt", " ", 1).alias("verb"))


@registered(
    """WITH o AS (SELECT o_orderkey AS k, 'KEY-' || o_custkey || CASE WHEN o_orderkey % 2 = 1 THEN ', TYP' ELSE '' END AS keyed, 'SEARCH ALL TAB-' || o_custkey AS tab, o_custkey AS c FROM orders),
s AS (SELECT k, tab, keyed, 'KEY-' || c AS source FROM o UNION ALL SELECT k, tab, keyed, 'TYP' FROM o WHERE k % 2 = 1)
SELECT 'P' || k AS program, 2 AS seq, 'RATE' AS target, source, 'CONDITION' AS kind, tab || ': default keyed on ' || keyed AS logic FROM s
UNION ALL SELECT 'P' || k, 4, 'RATE', source, 'CONDITION', tab || ': lookup keyed on ' || keyed FROM s
UNION ALL SELECT 'P' || k, 7, 'TAX', source, 'CONDITION', tab || ': lookup keyed on ' || keyed FROM s
UNION ALL SELECT 'P' || k, 7, 'TAX', 'FLAG', 'CONDITION', 'depends on the condition' FROM o WHERE k % 3 = 0
UNION ALL SELECT 'P' || k, x.seq, x.target, x.source, x.kind, x.logic FROM o, (VALUES (4, 'RATE', 'T-VAL', 'MOVE', 'MOVE T-VAL (IX) TO RATE'), (7, 'TAX', 'RATE', 'COMPUTE', 'COMPUTE TAX = RATE * 2'), (10, 'LAST', 'Z', 'MOVE', 'MOVE Z TO LAST')) x(seq, target, source, kind, logic)"""
)
def search_regions(spark, sf_dir):
    """A table look-up in each order's program: what its default, its found branch and an EVALUATE within it depend on."""
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    say = lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in x])
    typed = F.when(k % 2 == 1, " AND TYP = T-TYP OF T-ROW (IX)").otherwise("")
    nested = lambda text: F.when(k % 3 == 0, text).otherwise("CONTINUE")
    texts = F.array(
        say("SEARCH ALL TAB-", c), F.lit("AT END"), F.lit("MOVE 'N' TO RATE"), say("WHEN T-KEY (IX) = KEY-", c, typed), F.lit("MOVE T-VAL (IX) TO RATE"),
        nested("EVALUATE FLAG"), nested("WHEN 'Y'"), F.lit("COMPUTE TAX = RATE * 2"), nested("END-EVALUATE"), F.lit("END-SEARCH"), F.lit("MOVE Z TO LAST"),
    )
    each = table(spark, sf_dir, "orders").select(say("P", k.cast("string")).alias("program"), F.posexplode(texts).alias("seq", "stmt"))
    stmts = settled(each.withColumns({"sentence": F.lit(0), "verb": F.substring_index("stmt", " ", 1)}))
    moves = settled(L.transforms(stmts))
    cols = ["program", "seq", "target", "source", "kind", "logic"]
    return moves.select(*cols).unionByName(L.conditional_sources(stmts, moves).select(*cols))
