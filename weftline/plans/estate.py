"""Lineage of estates, one for each supplier: source texts below, with the supplier's key in every name; the expected rows are stated with the same key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.estate_lineage import Lineage, build
from weftline.plans.registry import registered
from weftline.session import table


def _cobol(text: str) -> str:
    return "\n".join("      " + (x if x.startswith("*") else " " + x) for x in text.strip("\n").split("\n")) + "\n"


RATER = _cobol("""
IDENTIFICATION DIVISION.
PROGRAM-ID. RATER@.
FILE-CONTROL.
    SELECT ACCT-IN ASSIGN TO ACCTDD.
    SELECT RATED ASSIGN TO RATEDD.
DATA DIVISION.
FILE SECTION.
FD ACCT-IN.
01 ACCT-REC.
   05 A-NO PIC X(8).
   05 A-BAL PIC 9(9).
FD RATED.
01 RATED-REC.
   05 R-NO PIC X(8).
   05 R-BAL PIC 9(9).
   05 R-BAND PIC X(2).
   05 R-NAME PIC X(20).
WORKING-STORAGE SECTION.
COPY WSCOMM.
PROCEDURE DIVISION.
    OPEN INPUT ACCT-IN OUTPUT RATED.
    READ ACCT-IN INTO WS-ACCT.
    MOVE WS-NO TO R-NO.
    COMPUTE R-BAL = WS-BAL * 100.
    EVALUATE WS-NO
      WHEN '1' EVALUATE WS-BAL
        WHEN 0 MOVE 'A' TO R-BAND
      END-EVALUATE
      WHEN OTHER MOVE 'B' TO R-BAND
    END-EVALUATE.
    CALL 'NAMER@' USING WS-NO WS-NAME.
    MOVE WS-NAME TO R-NAME.
    CALL 'GONE' USING WS-NO.
    MULTIPLY WS-RATE BY WS-BAL.
    MOVE WS-TAB(1) TO WS-ONE.
    UNSTRING WS-NAME INTO WS-ONE.
    WRITE RATED-REC.
    EXEC SQL INSERT INTO AUDIT@ (ACCT_NO, STATE)
      VALUES (:WS-NO, 'DONE') END-EXEC.
    EXEC SQL UPDATE RUNS SET N = 1 END-EXEC.
    MOVE 'DELETE FROM T' TO WS-SQL.
    EXEC SQL PREPARE S1 FROM :WS-SQL END-EXEC.
    GOBACK.
""")
NAMER = _cobol("""
IDENTIFICATION DIVISION.
PROGRAM-ID. NAMER@.
DATA DIVISION.
LINKAGE SECTION.
01 L-NO PIC X(8).
01 L-NAME PIC X(20).
PROCEDURE DIVISION USING L-NO L-NAME.
    EXEC SQL SELECT C.FULL_NAME INTO :H-NAME
      FROM CUSTOMERS@ C WHERE C.NO = :L-NO END-EXEC.
    MOVE H-NAME TO L-NAME.
    GOBACK.
""")
BOOK = _cobol("""
01 WS-ACCT.
   05 WS-NO PIC X(8).
   05 WS-BAL PIC 9(9).
""")
OTHER_BOOK = _cobol("""
01 WS-OTHER.
   05 WS-WRONG PIC X(8).
""")
JOB = """//NIGHT@  JOB (1),'X'
// SET HLQ=PROD
//UNLD    EXEC PGM=DSNTIAUL
//SYSREC00 DD DSN=&HLQ..ACCT@,DISP=(NEW,CATLG)
//SYSIN   DD *
 SELECT ACC_NO, BALANCE FROM ACCOUNTS@;
/*
//RATE    EXEC PGM=RATER@
//ACCTDD  DD DSN=&HLQ..ACCT@,DISP=SHR
//RATEDD  DD DSN=&HLQ..RATED@,DISP=(,CATLG)
//SORT1   EXEC PGM=SORT
//SORTIN  DD DSN=&HLQ..RATED@,DISP=SHR
//SORTOUT DD DSN=&HLQ..BANDS@,DISP=(NEW,CATLG)
//SYSIN   DD *
 SORT FIELDS=(1,8,CH,A)
 OUTREC BUILD=(1:18,2,
  3:C'-',1,8)
/*
//SORT2   EXEC PGM=SORT
//SORTIN  DD DSN=&HLQ..NOWHERE@,DISP=SHR
//SORTOUT DD DSN=&HLQ..NOWHERE@X,DISP=(NEW,CATLG)
//SYSIN   DD *
 SORT FIELDS=COPY
/*
//SEND    EXEC PGM=FTP
//INPUT   DD *
 put 'PROD.RATED@' rated@_&DATE..txt
/*
//TSO     EXEC PGM=IKJEFT01
//SYSTSIN DD *
 DSN SYSTEM(D1)
/*
//PROC    EXEC MYPROC
"""
SQL = """-- the customer's rated accounts
CREATE TABLE RATED_EXT@ (ACCOUNT VARCHAR2(8), BALANCE NUMBER(9), BAND VARCHAR2(2))
ORGANIZATION EXTERNAL (TYPE ORACLE_LOADER DEFAULT DIRECTORY IN_DIR ACCESS PARAMETERS (
  RECORDS FIXED 39 FIELDS (ACCOUNT POSITION(1:8) CHAR(8), BALANCE POSITION(9:17) CHAR(9), BAND POSITION(18:19) CHAR(2)))
LOCATION ('rated@_20260101.txt'));
CREATE OR REPLACE PROCEDURE LOAD_RATED@ AS BEGIN
INSERT INTO RATED_STG@ (ACCOUNT, LABEL, BALANCE)
  SELECT e.ACCOUNT, e.ACCOUNT || ', ' || e.BAND, CAST(e.BALANCE AS NUMBER(11,2)) FROM RATED_EXT@ e WHERE e.BAND <> 'it''s; -- no comment'
  UNION ALL SELECT o.ACC, o.NAME, 0 FROM OLD_STG@ o;
MERGE INTO RATED_STG@ s USING (SELECT ACC, MAX(V) AS V FROM FIXES@ GROUP BY ACC) f ON (s.ACCOUNT = f.ACC) WHEN MATCHED THEN UPDATE SET s.BALANCE = f.V;
UPDATE RATED_STG@ SET LABEL = ACCOUNT WHERE LABEL IS NULL;
EXECUTE IMMEDIATE 'TRUNCATE TABLE X';
INSERT INTO T2@ WITH q AS (SELECT 1 A FROM DUAL) SELECT A FROM q;
END;
CREATE VIEW RATED_V@ AS SELECT ACCOUNT, SUM(BALANCE) AS TOTAL FROM RATED_STG@ GROUP BY ACCOUNT;
"""
FILES = [
    ("/e/@/a/RATER.cbl", "RATER", "COBOL", RATER),
    ("/e/@/a/NAMER.cbl", "NAMER", "COBOL", NAMER),
    ("/e/@/a/copybooks/WSCOMM.cpy", "WSCOMM", "COPYBOOK", BOOK),
    ("/e/@/b/copybooks/WSCOMM.cpy", "WSCOMM", "COPYBOOK", OTHER_BOOK),
    ("/e/@/a/NIGHT.jcl", "NIGHT", "JCL", JOB),
    ("/e/@/a/rated.sql", "RATED", "SQL", SQL),
]


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts above once for each supplier, whose key stands for every @."""
    one = F.array(*[F.struct(*[F.lit(x).alias(c) for x, c in zip(f, ("path", "member", "language", "text"), strict=True)]) for f in FILES])
    key = F.col("s_suppkey").cast("string")
    each = table(spark, sf_dir, "supplier").select(key.alias("key"), F.explode(one).alias("f"))
    return each.select(*[F.replace(f"f.{c}", F.lit("@"), F.col("key")).alias(c) for c in ("path", "member", "language", "text")])


_BUILT: dict[tuple[str, str], Lineage] = {}


def lineage(spark: SparkSession, sf_dir: str) -> Lineage:
    """The estates' lineage, built once for a Spark application and folder: its tables are written ones."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = build(files(spark, sf_dir))
    return _BUILT[key]


@registered(
    r"""SELECT replace(id, '@', CAST(s_suppkey AS VARCHAR)) AS id, replace(kind, '@', CAST(s_suppkey AS VARCHAR)) AS kind, replace(name, '@', CAST(s_suppkey AS VARCHAR)) AS name, replace(language, '@', CAST(s_suppkey AS VARCHAR)) AS language, replace(path, '@', CAST(s_suppkey AS VARCHAR)) AS path, replace(columns, '@', CAST(s_suppkey AS VARCHAR)) AS columns FROM (VALUES
  ('FILE:PROD.ACCT@', 'FILE', 'PROD.ACCT@', NULL, NULL, 'A-BAL,A-NO,ACC_NO,BALANCE'),
  ('FILE:PROD.BANDS@', 'FILE', 'PROD.BANDS@', NULL, NULL, 'R-BAND,R-NO'),
  ('FILE:PROD.NOWHERE@', 'FILE', 'PROD.NOWHERE@', NULL, NULL, ''),
  ('FILE:PROD.NOWHERE@X', 'FILE', 'PROD.NOWHERE@X', NULL, NULL, ''),
  ('FILE:PROD.RATED@', 'FILE', 'PROD.RATED@', NULL, NULL, 'R-BAL,R-BAND,R-NAME,R-NO'),
  ('FILE:RATED@_20260101.TXT', 'FILE', 'RATED@_20260101.TXT', NULL, NULL, 'R-BAL,R-BAND,R-NAME,R-NO'),
  ('JOB:NIGHT@', 'JOB', 'NIGHT@', 'JCL', '/e/@/a/NIGHT.jcl', ''),
  ('PROGRAM:DSNTIAUL.NIGHT@.UNLD', 'PROGRAM', 'DSNTIAUL.NIGHT@.UNLD', NULL, NULL, ''),
  ('PROGRAM:FTP.NIGHT@.SEND', 'PROGRAM', 'FTP.NIGHT@.SEND', NULL, NULL, ''),
  ('PROGRAM:LOADER.RATED_EXT@', 'PROGRAM', 'LOADER.RATED_EXT@', NULL, NULL, ''),
  ('PROGRAM:LOAD_RATED@', 'PROGRAM', 'LOAD_RATED@', 'SQL', '/e/@/a/rated.sql', ''),
  ('PROGRAM:NAMER@', 'PROGRAM', 'NAMER@', 'COBOL', '/e/@/a/NAMER.cbl', ''),
  ('PROGRAM:RATER@', 'PROGRAM', 'RATER@', 'COBOL', '/e/@/a/RATER.cbl', ''),
  ('PROGRAM:SORT.NIGHT@.SORT1', 'PROGRAM', 'SORT.NIGHT@.SORT1', NULL, NULL, ''),
  ('PROGRAM:SORT.NIGHT@.SORT2', 'PROGRAM', 'SORT.NIGHT@.SORT2', NULL, NULL, ''),
  ('TABLE:ACCOUNTS@', 'TABLE', 'ACCOUNTS@', NULL, NULL, 'ACC_NO,BALANCE'),
  ('TABLE:AUDIT@', 'TABLE', 'AUDIT@', NULL, NULL, 'ACCT_NO'),
  ('TABLE:CUSTOMERS@', 'TABLE', 'CUSTOMERS@', NULL, NULL, 'FULL_NAME'),
  ('TABLE:FIXES@', 'TABLE', 'FIXES@', NULL, NULL, 'V'),
  ('TABLE:OLD_STG@', 'TABLE', 'OLD_STG@', NULL, NULL, 'ACC,NAME'),
  ('TABLE:RATED_EXT@', 'TABLE', 'RATED_EXT@', NULL, NULL, 'ACCOUNT,BALANCE,BAND'),
  ('TABLE:RATED_STG@', 'TABLE', 'RATED_STG@', NULL, NULL, 'ACCOUNT,BALANCE,LABEL'),
  ('TABLE:RATED_V@', 'TABLE', 'RATED_V@', NULL, NULL, 'ACCOUNT,TOTAL'),
  ('TABLE:T2@', 'TABLE', 'T2@', NULL, NULL, '')
) t(id, kind, name, language, path, columns), supplier"""
)
def estate_nodes(spark, sf_dir) -> DataFrame:
    return lineage(spark, sf_dir).nodes.withColumn("columns", F.array_join("columns", ","))


@registered(
    r"""SELECT replace(source_id, '@', CAST(s_suppkey AS VARCHAR)) AS source_id, replace(target_id, '@', CAST(s_suppkey AS VARCHAR)) AS target_id, replace(edge_type, '@', CAST(s_suppkey AS VARCHAR)) AS edge_type FROM (VALUES
  ('FILE:PROD.ACCT@', 'PROGRAM:RATER@', 'READS_FROM'),
  ('FILE:PROD.NOWHERE@', 'PROGRAM:SORT.NIGHT@.SORT2', 'READS_FROM'),
  ('FILE:PROD.RATED@', 'PROGRAM:FTP.NIGHT@.SEND', 'READS_FROM'),
  ('FILE:PROD.RATED@', 'PROGRAM:SORT.NIGHT@.SORT1', 'READS_FROM'),
  ('FILE:RATED@_20260101.TXT', 'PROGRAM:LOADER.RATED_EXT@', 'READS_FROM'),
  ('JOB:NIGHT@', 'PROGRAM:DSNTIAUL.NIGHT@.UNLD', 'EXECUTES'),
  ('JOB:NIGHT@', 'PROGRAM:FTP.NIGHT@.SEND', 'EXECUTES'),
  ('JOB:NIGHT@', 'PROGRAM:RATER@', 'EXECUTES'),
  ('JOB:NIGHT@', 'PROGRAM:SORT.NIGHT@.SORT1', 'EXECUTES'),
  ('JOB:NIGHT@', 'PROGRAM:SORT.NIGHT@.SORT2', 'EXECUTES'),
  ('PROGRAM:DSNTIAUL.NIGHT@.UNLD', 'FILE:PROD.ACCT@', 'WRITES_TO'),
  ('PROGRAM:FTP.NIGHT@.SEND', 'FILE:RATED@_20260101.TXT', 'WRITES_TO'),
  ('PROGRAM:LOADER.RATED_EXT@', 'TABLE:RATED_EXT@', 'WRITES_TO'),
  ('PROGRAM:LOAD_RATED@', 'TABLE:RATED_STG@', 'WRITES_TO'),
  ('PROGRAM:LOAD_RATED@', 'TABLE:T2@', 'WRITES_TO'),
  ('PROGRAM:RATER@', 'FILE:PROD.RATED@', 'WRITES_TO'),
  ('PROGRAM:RATER@', 'PROGRAM:NAMER@', 'EXECUTES'),
  ('PROGRAM:RATER@', 'TABLE:AUDIT@', 'WRITES_TO'),
  ('PROGRAM:SORT.NIGHT@.SORT1', 'FILE:PROD.BANDS@', 'WRITES_TO'),
  ('PROGRAM:SORT.NIGHT@.SORT2', 'FILE:PROD.NOWHERE@X', 'WRITES_TO'),
  ('TABLE:ACCOUNTS@', 'PROGRAM:DSNTIAUL.NIGHT@.UNLD', 'READS_FROM'),
  ('TABLE:CUSTOMERS@', 'PROGRAM:NAMER@', 'READS_FROM'),
  ('TABLE:FIXES@', 'PROGRAM:LOAD_RATED@', 'READS_FROM'),
  ('TABLE:OLD_STG@', 'PROGRAM:LOAD_RATED@', 'READS_FROM'),
  ('TABLE:RATED_EXT@', 'PROGRAM:LOAD_RATED@', 'READS_FROM'),
  ('TABLE:RATED_STG@', 'TABLE:RATED_V@', 'TRANSFORMS_TO')
) t(source_id, target_id, edge_type), supplier"""
)
def estate_edges(spark, sf_dir) -> DataFrame:
    return lineage(spark, sf_dir).edges


@registered(
    r"""SELECT replace(source_id, '@', CAST(s_suppkey AS VARCHAR)) AS source_id, replace(target_id, '@', CAST(s_suppkey AS VARCHAR)) AS target_id, replace(program, '@', CAST(s_suppkey AS VARCHAR)) AS program, replace(transformation, '@', CAST(s_suppkey AS VARCHAR)) AS transformation FROM (VALUES
  ('FILE:PROD.ACCT@|ACC_NO', 'FILE:PROD.RATED@|R-BAND', 'RATER@', 'READ ACCT-IN INTO WS-ACCT; depends on the condition'),
  ('FILE:PROD.ACCT@|ACC_NO', 'FILE:PROD.RATED@|R-NO', 'RATER@', 'READ ACCT-IN INTO WS-ACCT; MOVE WS-NO TO R-NO'),
  ('FILE:PROD.ACCT@|ACC_NO', 'TABLE:AUDIT@|ACCT_NO', 'RATER@', 'direct'),
  ('FILE:PROD.ACCT@|BALANCE', 'FILE:PROD.RATED@|R-BAL', 'RATER@', 'READ ACCT-IN INTO WS-ACCT; COMPUTE R-BAL = WS-BAL * 100'),
  ('FILE:PROD.ACCT@|BALANCE', 'FILE:PROD.RATED@|R-BAND', 'RATER@', 'READ ACCT-IN INTO WS-ACCT; depends on the condition'),
  ('FILE:PROD.RATED@|R-BAL', 'FILE:RATED@_20260101.TXT|R-BAL', 'FTP.NIGHT@.SEND', 'direct'),
  ('FILE:PROD.RATED@|R-BAND', 'FILE:PROD.BANDS@|R-BAND', 'SORT.NIGHT@.SORT1', 'direct'),
  ('FILE:PROD.RATED@|R-BAND', 'FILE:RATED@_20260101.TXT|R-BAND', 'FTP.NIGHT@.SEND', 'direct'),
  ('FILE:PROD.RATED@|R-NAME', 'FILE:RATED@_20260101.TXT|R-NAME', 'FTP.NIGHT@.SEND', 'direct'),
  ('FILE:PROD.RATED@|R-NO', 'FILE:PROD.BANDS@|R-NO', 'SORT.NIGHT@.SORT1', 'direct'),
  ('FILE:PROD.RATED@|R-NO', 'FILE:RATED@_20260101.TXT|R-NO', 'FTP.NIGHT@.SEND', 'direct'),
  ('FILE:RATED@_20260101.TXT|R-BAL', 'TABLE:RATED_EXT@|BALANCE', 'LOADER.RATED_EXT@', 'direct'),
  ('FILE:RATED@_20260101.TXT|R-BAND', 'TABLE:RATED_EXT@|BAND', 'LOADER.RATED_EXT@', 'direct'),
  ('FILE:RATED@_20260101.TXT|R-NO', 'TABLE:RATED_EXT@|ACCOUNT', 'LOADER.RATED_EXT@', 'direct'),
  ('TABLE:ACCOUNTS@|ACC_NO', 'FILE:PROD.ACCT@|ACC_NO', 'DSNTIAUL.NIGHT@.UNLD', 'direct'),
  ('TABLE:ACCOUNTS@|BALANCE', 'FILE:PROD.ACCT@|BALANCE', 'DSNTIAUL.NIGHT@.UNLD', 'direct'),
  ('TABLE:CUSTOMERS@|FULL_NAME', 'FILE:PROD.RATED@|R-NAME', 'RATER@', 'MOVE H-NAME TO L-NAME; CALL; MOVE WS-NAME TO R-NAME'),
  ('TABLE:FIXES@|V', 'TABLE:RATED_STG@|BALANCE', 'LOAD_RATED@', 'direct'),
  ('TABLE:OLD_STG@|ACC', 'TABLE:RATED_STG@|ACCOUNT', 'LOAD_RATED@', 'direct'),
  ('TABLE:OLD_STG@|NAME', 'TABLE:RATED_STG@|LABEL', 'LOAD_RATED@', 'direct'),
  ('TABLE:RATED_EXT@|ACCOUNT', 'TABLE:RATED_STG@|ACCOUNT', 'LOAD_RATED@', 'direct'),
  ('TABLE:RATED_EXT@|ACCOUNT', 'TABLE:RATED_STG@|LABEL', 'LOAD_RATED@', 'E.ACCOUNT || '', '' || E.BAND'),
  ('TABLE:RATED_EXT@|BALANCE', 'TABLE:RATED_STG@|BALANCE', 'LOAD_RATED@', 'CAST(E.BALANCE AS NUMBER(11,2))'),
  ('TABLE:RATED_EXT@|BAND', 'TABLE:RATED_STG@|LABEL', 'LOAD_RATED@', 'E.ACCOUNT || '', '' || E.BAND'),
  ('TABLE:RATED_STG@|ACCOUNT', 'TABLE:RATED_STG@|LABEL', 'LOAD_RATED@', 'direct'),
  ('TABLE:RATED_STG@|ACCOUNT', 'TABLE:RATED_V@|ACCOUNT', 'LOAD_RATED@', 'direct'),
  ('TABLE:RATED_STG@|BALANCE', 'TABLE:RATED_V@|TOTAL', 'LOAD_RATED@', 'SUM(BALANCE)')
) t(source_id, target_id, program, transformation), supplier"""
)
def estate_column_edges(spark, sf_dir) -> DataFrame:
    return lineage(spark, sf_dir).column_edges


@registered(
    r"""SELECT replace(program, '@', CAST(s_suppkey AS VARCHAR)) AS program, replace(construct_type, '@', CAST(s_suppkey AS VARCHAR)) AS construct_type, replace(snippet, '@', CAST(s_suppkey AS VARCHAR)) AS snippet, replace(context, '@', CAST(s_suppkey AS VARCHAR)) AS context FROM (VALUES
  ('LOAD_RATED@', 'DYNAMIC_SQL', 'EXECUTE IMMEDIATE ''TRUNCATE TABLE X''', ''),
  ('RATER@', 'DYNAMIC_SQL', 'EXEC SQL PREPARE S1 FROM :WS-SQL END-EXEC', 'MOVE ''DELETE FROM T'' TO WS-SQL')
) t(program, construct_type, snippet, context), supplier"""
)
def estate_dynamic(spark, sf_dir) -> DataFrame:
    return lineage(spark, sf_dir).dynamic


@registered(
    r"""SELECT replace(program, '@', CAST(s_suppkey AS VARCHAR)) AS program, replace(statement_type, '@', CAST(s_suppkey AS VARCHAR)) AS statement_type, replace(snippet, '@', CAST(s_suppkey AS VARCHAR)) AS snippet FROM (VALUES
  ('LOAD_RATED@', 'SQL_DML_UNMAPPED', 'INSERT INTO T2@ WITH Q AS (SELECT 1 A FROM DUAL) SELECT A FROM Q'),
  ('NIGHT@', 'JCL_PROC', 'MYPROC'),
  ('NIGHT@', 'JCL_TSO_RUN', ' DSN SYSTEM(D1)'),
  ('RATER@', 'COBOL_CALL', 'CALL ''GONE'' USING WS-NO: not in the estate'),
  ('RATER@', 'COBOL_UNSTRING', 'UNSTRING WS-NAME INTO WS-ONE'),
  ('RATER@', 'EXEC_SQL_UPDATE', 'EXEC SQL UPDATE RUNS SET N = 1 END-EXEC'),
  ('SORT.NIGHT@.SORT2', 'JCL_SORT_CONTROL', 'SORT FIELDS=COPY')
) t(program, statement_type, snippet), supplier"""
)
def estate_unparsed(spark, sf_dir) -> DataFrame:
    return lineage(spark, sf_dir).unparsed.select("program", "statement_type", "snippet")
