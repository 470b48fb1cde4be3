"""What used to get lost without a trace, each on its own, and the invariant that every statement is mapped or reported."""

import pytest
from pyspark.sql import functions as F

from weftline.functions import scalars as S
from weftline.operators import lineage as L
from weftline.operators import sortsteps as SS
from weftline.operators.estate_lineage import build
from weftline.sources import estate as E


def source(spark, text, member="M", language="SQL", path=None):
    return spark.createDataFrame([(path or f"/e/{member}", member, language, text)], "path string, member string, language string, text string")


def cobol(*lines):
    return "\n".join("       " + x for x in ("IDENTIFICATION DIVISION.", "PROGRAM-ID. P.", "DATA DIVISION.", "WORKING-STORAGE SECTION.", "PROCEDURE DIVISION.", *lines)) + "\n"


def stmts_of(spark, *lines):
    return E.statements(E.programs(E.cobol_lines(source(spark, cobol(*lines), "P", "COBOL"))))


def test_comments_and_literals_do_not_hide_in_each_other(spark):
    long = "x" * 60_000
    text = f"-- the customer's rows\nINSERT INTO T (A) SELECT S.B FROM S; /* it's '' */ INSERT INTO T (A) SELECT S.C FROM S WHERE S.D <> '-- {long}''; ;';"
    s = L.sql_statements(source(spark, text))
    got = {(r.target_column, r.sources[0]) for r in L.sql_columns(s).collect()}
    assert got == {("A", "S|B"), ("A", "S|C")} and L.sql_gaps(s).count() == 0


def test_parts_at_any_depth(spark):
    df = spark.createDataFrame([("a, f(g(h(i(1, 2), 3), 4), 5), b", "SELECT (SELECT X FROM Y) FROM Z WHERE (A IN (SELECT 1 FROM Q))")], "t string, q string")
    r = df.select(S.split_top(F.col("t")).alias("parts"), S.clauses(F.col("q"), "SELECT|FROM|WHERE").alias("c")).first()
    assert r.parts == ["a", "f(g(h(i(1, 2), 3), 4), 5)", "b"]
    assert [(c.key, c.text) for c in r.c] == [("", ""), ("SELECT", "(SELECT X FROM Y)"), ("FROM", "Z"), ("WHERE", "(A IN (SELECT 1 FROM Q))")]


@pytest.mark.parametrize(
    ("stmt", "columns", "gaps"),
    [
        ("INSERT INTO T (A, B) SELECT x.P || ', (' || x.Q, x.R FROM X x", {("A", "X|P"), ("A", "X|Q"), ("B", "X|R")}, 0),
        ("INSERT INTO T (A) SELECT P FROM X UNION SELECT Q FROM Y", {("A", "X|P"), ("A", "Y|Q")}, 0),
        ("INSERT INTO T SELECT * FROM X", set(), 1),
        ("INSERT INTO T (A) SELECT q.P FROM (SELECT P FROM X) q", set(), 1),
        ("INSERT INTO T (A) VALUES (1)", set(), 0),
        ("CREATE TABLE T AS SELECT CAST(X.P AS VARCHAR2(3)) AS A FROM X", {("A", "X|P")}, 0),
        ("CREATE MATERIALIZED VIEW T AS SELECT P FROM X", {("P", "X|P")}, 0),
        ("MERGE INTO T USING (SELECT K, V FROM X) S ON (T.K = S.K) WHEN MATCHED THEN UPDATE SET T.A = S.V", set(), 1),
        ("INSERT INTO T (A) SELECT f(g(h(i(P)))) FROM X", {("A", "X|P")}, 0),
    ],
)
def test_statements_are_mapped_or_reported(spark, stmt, columns, gaps):
    s = L.sql_statements(source(spark, stmt + ";"))
    assert {(r.target_column, x) for r in L.sql_columns(s).collect() for x in r.sources} == columns
    assert L.sql_gaps(s).count() == gaps
    assert gaps == 0 or "VALUES" in stmt or L.sql_edges(s).where("source_id = 'TABLE:X'").count() == 1


def test_cobol_statements_are_mapped_or_reported(spark):
    lines = ["MOVE TAB(I) TO E.", "MOVE R OF S TO D.", "MULTIPLY A BY B.", "DIVIDE C INTO Q.", "MOVE 1 TO Z.", "MOVE CORR X TO Y.", "READ F INTO W.", "EXEC SQL INSERT INTO T SELECT A FROM U END-EXEC.", "EXEC SQL DELETE FROM T END-EXEC.", "COMPUTE K ROUNDED = FUNCTION MAX(M N) + 1.", "SUBTRACT V FROM X1 GIVING X2."]
    s = stmts_of(spark, *lines).cache()
    moves = L.transforms(s)
    assert {(r.target, r.source) for r in moves.collect()} == {("E", "TAB"), ("D", "R"), ("B", "A"), ("B", "B"), ("Q", "C"), ("Q", "Q"), ("K", "M"), ("K", "N"), ("X2", "V"), ("X2", "X1")}
    gaps = {r.statement_type for r in L.cobol_gaps(s, moves).collect()}
    assert gaps == {"COBOL_MOVE_CORRESPONDING", "COBOL_READ", "EXEC_SQL_INSERT", "EXEC_SQL_DELETE"}
    done = {r.seq for r in moves.union(moves.limit(0)).select("seq").collect()} | {r.seq for r in L.cobol_gaps(s, moves).collect()}
    constant = {r.seq for r in s.where("stmt like 'MOVE 1 %'").collect()}
    assert {r.seq for r in s.where("verb not in ('PROCEDURE')").collect()} == done | constant


def test_nested_evaluates(spark):
    s = stmts_of(spark, "EVALUATE OUTER-V", "WHEN 1 EVALUATE INNER-V", "WHEN 2 MOVE 'A' TO T1", "END-EVALUATE", "WHEN 3 MOVE X TO T2", "END-EVALUATE.", "MOVE 1 TO T3.")
    got = {(r.target, r.source) for r in L.conditional_sources(s, L.transforms(s)).collect()}
    assert got == {("T1", "OUTER-V"), ("T1", "INNER-V"), ("T2", "OUTER-V")}


def test_the_nearest_copybook_is_taken_and_replaced(spark):
    main = "       01 A.\n           COPY BK REPLACING ==X1== BY ==Y1==.\n"
    rows = [("/e/p/M.cbl", "M", "COBOL", main), ("/e/p/copybooks/BK.cpy", "BK", "COPYBOOK", "           05 X1 PIC X.\n"), ("/e/a/copybooks/BK.cpy", "BK", "COPYBOOK", "           05 WRONG PIC X.\n")]
    lines = E.cobol_lines(spark.createDataFrame(rows, "path string, member string, language string, text string"))
    assert [r.code.strip() for r in lines.orderBy("line", "sub").collect()] == ["01 A.", "05 Y1 PIC X."]


def test_symbols_follow_the_order_of_their_statements(spark):
    jcl = "//J JOB\n// SET A=1\n// SET B=&A.X\n// SET C=&B.Y,D=&C.Z\n//S EXEC PGM=P\n//X DD DSN=&D\n// SET A=2\n//Y DD DSN=&A..&B..&NONE\n"
    got = {r.name: r.operands for r in E.substituted(E.job_statements(source(spark, jcl, "J", "JCL"))).where("op = 'DD'").collect()}
    assert got == {"X": "DSN=1XYZ", "Y": "DSN=2.1X.&NONE"}


def test_joined_sort_step(spark):
    dds = [
        ("SORT.J.S", "SORTJNF1", "A", []), ("SORT.J.S", "CUST", "B", []), ("SORT.J.S", "OUT1", "C", []), ("SORT.J.S", "OUT2", "D", []),
        ("SORT.J.S", "SYSIN", None, [" JOINKEYS FILE=F1,FIELDS=(1,4,A)", " JOINKEYS F2=CUST,FIELDS=(3,4,CH,A)", " REFORMAT FIELDS=(F1:1,8,F2:7,2)", " SORT FIELDS=(1,4,CH,A)", " OUTFIL FNAMES=OUT1,BUILD=(9,2,2X,5,4,ZD)", " OUTFIL FNAMES=OUT2,INCLUDE=(1,1,CH,EQ,C'A')"]),
    ]
    df = spark.createDataFrame(dds, "program string, dd string, dsn string, data array<string>")
    fields = [("A", "K", 1, 4), ("A", "V", 5, 4), ("B", "X", 1, 2), ("B", "K2", 3, 4), ("B", "N", 7, 2), ("C", "C-N", 1, 2), ("C", "C-FILL", 3, 2), ("C", "C-V", 5, 4)]
    columns, gaps = SS.sort_columns(df, spark.createDataFrame(fields, "dsn string, field string, start int, length int"))
    got = {(r.source_dsn, r.source, r.target_dsn, r.target) for r in columns.collect()}
    assert got == {("B", "N", "C", "C-N"), ("A", "V", "C", "C-V"), ("A", "K", "D", "K"), ("A", "V", "D", "V"), ("B", "N", "D", "N")}
    assert gaps.count() == 0
    keys = {(r.card, r.tag, r.start, r.length, r.order) for r in SS.sort_keys(SS.sort_cards(df)).collect()}
    assert keys == {("JOINKEYS", "F1", 1, 4, "A"), ("JOINKEYS", "F2", 3, 4, "A"), ("SORT", "F0", 1, 4, "A")}


def test_callers_do_not_reach_each_other(spark):
    one = lambda name, table: "\n".join("       " + x for x in (f"PROGRAM-ID. {name}.", "PROCEDURE DIVISION.", f"EXEC SQL SELECT V INTO :A FROM {table}_IN END-EXEC.", "CALL 'SUB' USING A B.", f"EXEC SQL INSERT INTO {table}_OUT (V) VALUES (:B) END-EXEC."))
    sub = "\n".join("       " + x for x in ("PROGRAM-ID. SUB.", "PROCEDURE DIVISION USING L-A L-B.", "MOVE L-A TO L-B."))
    rows = [("/e/1", "ONE", "COBOL", one("ONE", "X")), ("/e/2", "TWO", "COBOL", one("TWO", "Y")), ("/e/3", "SUB", "COBOL", sub)]
    got = build(spark.createDataFrame(rows, "path string, member string, language string, text string"))
    assert {(r.source_id, r.target_id) for r in got.column_edges.collect()} == {("TABLE:X_IN|V", "TABLE:X_OUT|V"), ("TABLE:Y_IN|V", "TABLE:Y_OUT|V")}
    assert got.unparsed.count() == 0


def test_empty_estate(spark):
    got = build(source(spark, "").limit(0))
    assert [t.count() for t in got] == [0] * 5
