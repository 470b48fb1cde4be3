"""Facts and edges of a small estate written for these tests."""

import pytest
from pyspark.sql import functions as F

from weftline.functions import scalars as S
from weftline.operators import graph as G
from weftline.operators import lineage as L
from weftline.operators import sortsteps as SS
from weftline.sources import estate as E


def cobol(*lines):
    return "\n".join("      " + (x if x.startswith("*") else " " + x) for x in lines) + "\n"


MAIN = cobol(
    "IDENTIFICATION DIVISION.",
    "PROGRAM-ID. PAYMAIN.",
    "* MOVE COMMENTED TO NOWHERE.",
    "FILE-CONTROL.",
    "    SELECT IN-FILE ASSIGN TO INDD.",
    "    SELECT OUT-FILE ASSIGN TO OUTDD.",
    "DATA DIVISION.",
    "FILE SECTION.",
    "FD IN-FILE.",
    "01 IN-REC.",
    "   05 IN-KEY PIC X(8).",
    "   05 IN-AMT PIC S9(13)V99 COMP-3.",
    "FD OUT-FILE.",
    "01 OUT-REC.",
    "   05 OUT-KEY PIC X(8).",
    "   05 OUT-AMT PIC S9(13)V99 COMP-3.",
    "   05 OUT-BAND PIC X.",
    "WORKING-STORAGE SECTION.",
    "COPY WSCOMM.",
    "01 WS-BAD.",
    "   05 WS-ONE PIC X(3).",
    "   05 WS-TWO PIC X OCCURS 4 TIMES.",
    "PROCEDURE DIVISION.",
    "    OPEN INPUT IN-FILE OUTPUT OUT-FILE.",
    "    MOVE IN-KEY TO OUT-KEY WS-KEY.",
    "    COMPUTE WS-NET ROUNDED = IN-AMT * WS-RATE - 1.",
    "    ADD WS-NET WS-FEE GIVING OUT-AMT.",
    "    ADD IN-AMT TO WS-TOTAL.",
    "    STRING 'MOVE A TO B' WS-KEY DELIMITED BY SIZE INTO WS-TEXT.",
    "    EVALUATE TRUE",
    "      WHEN WS-NET > 100 MOVE 'A' TO OUT-BAND",
    "      WHEN OTHER MOVE 'B' TO OUT-BAND",
    "    END-EVALUATE.",
    "    CALL 'PAYSUB' USING WS-NET WS-FEE.",
    "    CALL 'NOWHERE' USING WS-NET.",
    "    MOVE IN-REC TO OUT-REC.",
    "    MOVE WS-BAD TO OUT-REC.",
    "    UNSTRING WS-TEXT INTO WS-KEY.",
    "    EXEC SQL UPDATE T SET A = 1 END-EXEC.",
    "    EXEC SQL PREPARE S1 FROM :WS-TEXT END-EXEC.",
    "    GOBACK.",
)
SUB = cobol(
    "IDENTIFICATION DIVISION.",
    "PROGRAM-ID. PAYSUB.",
    "DATA DIVISION.",
    "LINKAGE SECTION.",
    "01 L-NET PIC 9(5).",
    "01 L-FEE PIC 9(5).",
    "PROCEDURE DIVISION USING L-NET L-FEE.",
    "    EXEC SQL DECLARE C1 CURSOR FOR",
    "      SELECT A.FEE, COALESCE(A.X, B.Y)",
    "      FROM FEES A, OTHER B WHERE A.K = B.K END-EXEC.",
    "    EXEC SQL FETCH C1 INTO :H-FEE, :H-X END-EXEC.",
    "    MOVE H-FEE TO L-FEE.",
)
BOOK = cobol("01 WS-AREA.", "   05 WS-KEY PIC X(8).", "   05 WS-NET PIC 9(5).", "   05 WS-FEE PIC 9(5).")
JOB = """//PAYJOB  JOB (1),'X'
// SET ENV=PROD
//* a comment
//S1      EXEC PGM=PAYMAIN
//INDD    DD DSN=&ENV..PAY.IN,DISP=SHR
//OUTDD   DD DSN=&ENV..PAY.OUT,
//           DISP=(NEW,CATLG)
//S2      EXEC PGM=SORT
//SORTIN  DD DSN=PROD.PAY.OUT,DISP=SHR
//SORTOUT DD DSN=PROD.PAY.SRT,DISP=(,CATLG)
//SYSIN   DD *
 SORT FIELDS=(1,8,CH,A)
 OUTFIL FNAMES=SORTOUT,
  BUILD=(1,8,9,8)
/*
//S3      EXEC PGM=IKJEFT01
//SYSTSIN DD *
 DSN SYSTEM(D1)
 RUN PROGRAM(PAYSUB) PLAN(P1)
/*
//S4      EXEC MYPROC
//G1      DD DSN=PROD.GDG(+1),DISP=(NEW,CATLG)
//R1      DD DSN=*.S1.OUTDD,DISP=SHR
"""
SQL = """-- staging
CREATE OR REPLACE PROCEDURE LOAD_PAY AS BEGIN
INSERT INTO PAY_STG (ACCT, NET, BAND) SELECT e.KEY1, NVL(e.AMT, 0) * 2, 'X;Y' FROM PAY_EXT e LEFT JOIN FEES f ON e.K = f.K WHERE e.KEY1 IS NOT NULL;
UPDATE PAY_STG SET NET = 0 WHERE NET IS NULL;
EXECUTE IMMEDIATE 'DROP TABLE X';
INSERT INTO T2 WITH q AS (SELECT 1 FROM DUAL) SELECT * FROM q;
END;
CREATE VIEW PAY_V AS SELECT ACCT, SUM(NET) AS TOTAL FROM PAY_STG GROUP BY ACCT;
"""


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("estate")
    (root / "copybooks").mkdir()
    for name, text in {"PAYMAIN.cbl": MAIN, "PAYSUB.cob": SUB, "copybooks/WSCOMM.cpy": BOOK, "PAYJOB.jcl": JOB, "pay.sql": SQL, "run.ksh": "exit"}.items():
        (root / name).write_text(text)
    return E.files(spark, str(root)).cache()


@pytest.fixture(scope="module")
def progs(files):
    return E.programs(E.cobol_lines(files)).cache()


@pytest.fixture(scope="module")
def stmts(progs):
    return E.statements(progs).cache()


def pairs(df, *cols):
    return {tuple(r[c] for c in cols) for r in df.collect()}


def test_files_and_copybooks(files, progs):
    assert pairs(files, "member", "language") == {("PAYMAIN", "COBOL"), ("PAYSUB", "COBOL"), ("WSCOMM", "COPYBOOK"), ("PAYJOB", "JCL"), ("PAY", "SQL")}
    data = progs.where("program = 'PAYMAIN'").first()["data"]
    assert "WS-AREA" in data and "COPY" not in data
    assert progs.where("program = 'PAYSUB'").first()["parameters"] == ["L-NET", "L-FEE"]


def test_transforms(stmts):
    got = pairs(L.transforms(stmts).where("program = 'PAYMAIN'"), "target", "source", "kind")
    assert {("OUT-KEY", "IN-KEY", "MOVE"), ("WS-KEY", "IN-KEY", "MOVE"), ("WS-NET", "IN-AMT", "COMPUTE"), ("WS-NET", "WS-RATE", "COMPUTE"), ("OUT-AMT", "WS-NET", "GIVING"), ("OUT-AMT", "WS-FEE", "GIVING"), ("WS-TEXT", "WS-KEY", "STRING"), ("WS-TOTAL", "IN-AMT", "ADD"), ("WS-TOTAL", "WS-TOTAL", "ADD")} <= got
    assert not {t for t, _, _ in got} & {"B", "NOWHERE"}
    cond = pairs(L.conditional_sources(stmts, L.transforms(stmts)), "target", "source")
    assert cond == {("OUT-BAND", "WS-NET")}


def test_layouts_and_group_moves(progs, stmts):
    items = L.data_items(progs)
    fields = L.layouts(items)
    at = {(r.record, r.field): (r.start, r.length, r.valid, r.fd) for r in fields.where("program = 'PAYMAIN'").collect()}
    assert at["IN-REC", "IN-AMT"] == (9, 8, True, "IN-FILE") and at["OUT-REC", "OUT-BAND"] == (17, 1, True, "OUT-FILE")
    assert at["WS-BAD", "WS-ONE"][2] is False and at["WS-AREA", "WS-FEE"][:2] == (14, 5)
    moved, gaps = L.group_moves(L.transforms(stmts), fields)
    assert pairs(moved, "target", "source") == {("OUT-KEY", "IN-KEY"), ("OUT-AMT", "IN-AMT")}
    assert gaps.count() == 1 and "WS-BAD" in gaps.first()["snippet"]


def test_calls_cursors_and_resolution(progs, stmts):
    sites, passed, missing = L.call_sites(stmts, progs)
    assert pairs(L.call_edges(sites), "source_id", "target_id") == {("PROGRAM:PAYMAIN", "PROGRAM:PAYSUB")}
    assert missing.count() == 1
    cur = L.cursors(stmts)
    assert [(r.expr, sorted(r.tables.items())) for r in cur.orderBy("pos").collect()][0] == ("A.FEE", [("A", "FEES"), ("B", "OTHER"), ("FEES", "FEES"), ("OTHER", "OTHER")])
    sources = cur.join(L.fetches(stmts), ["program", "cursor", "pos"]).select("variable", L.source_columns(F.col("expr"), F.col("tables")).alias("s")).collect()
    assert {r.variable: r.s for r in sources} == {"H-FEE": ["FEES|FEE"], "H-X": ["FEES|X", "OTHER|Y"]}
    named = lambda *names: stmts.sparkSession.createDataFrame([(n,) for n in names], "name string")
    site = f"PAYMAIN#{sites.first()['seq']}"
    steps = L.steps_in_context(L.transforms(stmts), sites, passed)
    end = {(r.output, r.origin): r.path for r in L.traced(steps, named("PAYMAIN@.OUT-AMT", "PAYMAIN@.OUT-KEY"), named(f"PAYSUB@{site}.H-FEE", "PAYMAIN@.IN-KEY", "PAYSUB@.H-FEE")).collect()}
    assert set(end) == {("PAYMAIN@.OUT-AMT", f"PAYSUB@{site}.H-FEE"), ("PAYMAIN@.OUT-KEY", "PAYMAIN@.IN-KEY")}
    assert end["PAYMAIN@.OUT-AMT", f"PAYSUB@{site}.H-FEE"] == ["MOVE H-FEE TO L-FEE", "CALL", "ADD WS-NET WS-FEE GIVING OUT-AMT"]


def test_jobs(files, progs, stmts):
    js = E.substituted(E.job_statements(files))
    steps = L.job_steps(js)
    dds = L.dd_statements(steps)
    edges = pairs(L.job_edges(steps, dds), "source_id", "target_id", "edge_type")
    assert {("JOB:PAYJOB", "PROGRAM:PAYMAIN", "EXECUTES"), ("JOB:PAYJOB", "PROGRAM:PAYSUB", "EXECUTES"), ("FILE:PROD.PAY.OUT", "PROGRAM:SORT.PAYJOB.S2", "READS_FROM"), ("PROGRAM:SORT.PAYJOB.S2", "FILE:PROD.PAY.SRT", "WRITES_TO")} <= edges
    linked = pairs(L.linked_files(L.file_bindings(progs), L.open_modes(stmts), dds), "source_id", "target_id", "edge_type")
    assert linked == {("FILE:PROD.PAY.IN", "PROGRAM:PAYMAIN", "READS_FROM"), ("PROGRAM:PAYMAIN", "FILE:PROD.PAY.OUT", "WRITES_TO")}
    cards = SS.sort_cards(dds)
    assert pairs(cards, "card") == {("SORT",), ("OUTFIL",)}
    assert pairs(SS.build_items(cards), "out", "src", "len") == {(1, 1, 8), (9, 9, 8)}
    assert pairs(L.job_gaps(steps), "statement_type") == {("JCL_PROC",), ("JCL_GDG",), ("JCL_REFERBACK",)}


def test_sql(files):
    s = L.sql_statements(files)
    cols = {(r.target, r.target_column): (tuple(r.sources), r.transformation) for r in L.sql_columns(s).collect()}
    assert cols["PAY_STG", "ACCT"] == (("PAY_EXT|KEY1",), "direct")
    assert cols["PAY_STG", "NET"] == (("PAY_EXT|AMT",), "NVL(E.AMT, 0) * 2") and ("PAY_STG", "BAND") not in cols
    assert cols["PAY_V", "TOTAL"] == (("PAY_STG|NET",), "SUM(NET)")
    edges = pairs(L.sql_edges(s), "source_id", "target_id", "edge_type")
    assert {("PROGRAM:LOAD_PAY", "TABLE:PAY_STG", "WRITES_TO"), ("TABLE:PAY_EXT", "PROGRAM:LOAD_PAY", "READS_FROM"), ("TABLE:FEES", "PROGRAM:LOAD_PAY", "READS_FROM"), ("TABLE:PAY_STG", "TABLE:PAY_V", "TRANSFORMS_TO")} <= edges
    assert L.sql_gaps(s).count() == 1


def test_every_gap_is_reported(files, stmts):
    gaps = pairs(L.cobol_gaps(stmts, L.transforms(stmts)), "statement_type")
    assert gaps == {("COBOL_UNSTRING",), ("EXEC_SQL_UPDATE",)}
    assert L.dynamic_constructs(stmts, L.sql_statements(files)).count() == 2


def test_end_to_end_path(spark, files, progs, stmts):
    steps = L.job_steps(E.substituted(E.job_statements(files)))
    dds = L.dd_statements(steps)
    edges = L.job_edges(steps, dds).unionByName(L.linked_files(L.file_bindings(progs), L.open_modes(stmts), dds)).unionByName(L.sql_edges(L.sql_statements(files))).distinct()
    down = G.distances(edges, spark.createDataFrame([("FILE:PROD.PAY.IN",)], "id string"), 8, "down")
    got = {r.id: r.dist for r in down.collect()}
    assert got["PROGRAM:PAYMAIN"] == 1 and got["FILE:PROD.PAY.SRT"] == 4


JOB2 = """//UNJOB   JOB (1)
//U1      EXEC PGM=DSNTIAUL
//SYSREC00 DD DSN=P.A,DISP=(NEW,CATLG)
//SYSREC01 DD DSN=P.B,DISP=(NEW,CATLG)
//SYSIN   DD *
 SELECT K, AMT FROM DB.ACCT WHERE X = 1;
 SELECT TRIM(A), B FROM DB.OTHER;
/*
//F1      EXEC PGM=FTP
//INPUT   DD *
 put 'P.A' feed_&DATE..txt
 put 'P.B' plain.txt
 quit
/*
"""


def test_unloads_and_transfers(spark, tmp_path):
    (tmp_path / "u.jcl").write_text(JOB2)
    steps = L.job_steps(E.job_statements(E.files(spark, str(tmp_path))))
    got = {(r.table, tuple(r.columns), r.dsn) for r in L.unloads(L.dd_statements(steps)).collect()}
    assert got == {("DB.ACCT", ("K", "AMT"), "P.A"), ("DB.OTHER", ("TRIM(A)", "B"), "P.B")}
    fields = spark.createDataFrame([("P.A", "RDR", "F-K", 1, 1, 8), ("P.A", "RDR", "F-AMT", 2, 9, 8), ("P.B", "RDR", "ONLY", 1, 1, 8)], "dsn string, program string, field string, ord int, start int, length int")
    named, gaps = L.unload_aliases(L.unloads(L.dd_statements(steps)), fields)
    assert pairs(named, "field", "column") == {("F-K", "K"), ("F-AMT", "AMT")}
    assert pairs(gaps, "program", "snippet") == {("RDR", "P.B")}
    edges, templates = L.transfers(steps)
    assert ("PROGRAM:FTP.UNJOB.F1", "FILE:plain.txt") in pairs(edges, "source_id", "target_id") and edges.count() == 4
    assert pairs(templates, "template", "dsn") == {("feed_*.txt", "P.A")}


def test_assignments(spark):
    rows = [("P", 1, "UPDATE T SET A = B + 1, C = 'X' WHERE D = 2"), ("P", 2, "MERGE INTO T T1 USING S S1 ON (T1.K = S1.K) WHEN MATCHED THEN UPDATE SET T1.A = NVL(S1.A, T1.B), T1.C = S1.D WHEN NOT MATCHED THEN INSERT (K) VALUES (1)")]
    got = {(r.seq, r.target_column): tuple(r.sources) for r in L.assignments(spark.createDataFrame(rows, "program string, seq int, stmt string")).collect()}
    assert got == {(1, "A"): ("T|B",), (1, "C"): (), (2, "A"): ("S|A", "T|B"), (2, "C"): ("S|D",)}


PICS = [("X(20)", None, 20), ("9(4)", "COMP", 2), ("S9(13)V99", "COMP-3", 8), ("S9(13)V99", None, 15), ("-9(13).99", None, 17), ("9.9999", None, 6), ("ZZZ,ZZ9", None, 7), ("S9(9)", "COMP", 4), ("S9(10)", "BINARY", 8), ("X", None, 1), ("999", None, 3), ("9(5)CR", None, 7), ("9(7)", "COMP-1", 4), ("9(7)", "COMP-2", 8)]


def test_pic_length(spark):
    df = spark.createDataFrame(PICS, "pic string, usage string, bytes int")
    assert df.where(S.pic_length(F.col("pic"), F.col("usage")) != F.col("bytes")).count() == 0


def test_callers_of_callers_stay_apart(spark):
    """A1 and A2 call B with their own field, B calls C with it, and C's result comes back to each."""
    moves = spark.createDataFrame([(p, "OUT", "P1", f"{p} moves") for p in ("A1", "A2")] + [("C", "L2", "L1", "C moves"), ("A1", "P1", "P1X", "x")], "program string, target string, source string, logic string")
    sites = spark.createDataFrame([("A1", 1, "B"), ("A2", 1, "B"), ("B", 5, "C")], "program string, seq int, callee string")
    pairs_ = spark.createDataFrame([("A1", 1, "B", "IN", "BP"), ("A2", 1, "B", "IN", "BP"), ("A1", 1, "B", "P1", "BQ"), ("A2", 1, "B", "P1", "BQ"), ("B", 5, "C", "BP", "L1"), ("B", 5, "C", "BQ", "L2")], "program string, seq int, callee string, arg string, param string")
    steps = L.steps_in_context(moves, sites, pairs_)
    named_ = lambda *names: spark.createDataFrame([(n,) for n in names], "name string")
    found = L.traced(steps, named_("A1@.OUT", "A2@.OUT"), named_("A1@.IN", "A2@.IN")).collect()
    assert {(r.output, r.origin) for r in found} == {("A1@.OUT", "A1@.IN"), ("A2@.OUT", "A2@.IN")}


def test_recursion_leads_back_to_its_context(spark):
    sites = spark.createDataFrame([("A", 1, "B"), ("B", 2, "C"), ("C", 3, "B"), ("D", 4, "D")], "program string, seq int, callee string")
    contexts, links = L.call_contexts(sites.select("program"), sites)
    got = pairs(contexts, "program", "chain")
    assert got == {("A", ""), ("B", ""), ("C", ""), ("D", ""), ("B", "A#1"), ("C", "A#1>B#2"), ("C", "B#2"), ("B", "C#3")}
    assert ("C", "A#1>B#2", 3, "B", "A#1") in pairs(links, "program", "chain", "seq", "callee", "callee_chain")
    assert ("D", "", 4, "D", "") in pairs(links, "program", "chain", "seq", "callee", "callee_chain")


def test_all_shortest_paths(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("a", "e"), ("e", "f"), ("f", "d"), ("d", "a"), ("d", "g"), ("z", "d")], "source_id string, target_id string")
    ids = lambda *names: spark.createDataFrame([(n,) for n in names], "id string")
    got = pairs(G.shortest_path_edges(edges, ids("a"), ids("g", "d", "a", "nowhere")), "source_id", "target_id", "dist")
    assert got == {("a", "b", 1), ("a", "c", 1), ("b", "d", 2), ("c", "d", 2), ("d", "g", 3)}
    assert G.shortest_path_edges(edges, ids("g"), ids("a")).count() == 0
