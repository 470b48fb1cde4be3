"""Columns of nested queries, statement by statement."""

import pytest

from weftline.operators.lineage import sql_statements
from weftline.operators.scopes import scope_columns

CASES = [
    ("INSERT INTO T (A) SELECT q.P FROM (SELECT P FROM X) q", {("A", "X|P")}, 0),
    ("INSERT INTO T (A, B) SELECT q.P1, r.R FROM (SELECT s.P AS P1 FROM (SELECT x.P, x.K FROM X x) s) q JOIN R r ON (q.P1 = r.K)", {("A", "X|P"), ("B", "R|R")}, 0),
    ("INSERT INTO T (A, B) WITH u AS (SELECT P, Q FROM X), v AS (SELECT u.P + u.Q AS S, u.Q FROM u) SELECT v.S, v.Q FROM v", {("A", "X|P"), ("A", "X|Q"), ("B", "X|Q")}, 0),
    ("WITH u AS (SELECT P FROM X) SELECT P FROM u", set(), 0),
    ("CREATE VIEW T AS SELECT * FROM (SELECT P, Q AS Q2 FROM X)", {("P", "X|P"), ("Q2", "X|Q")}, 0),
    ("CREATE OR REPLACE FORCE VIEW T (A) AS (SELECT y.P FROM Y y)", {("A", "Y|P")}, 0),
    ("INSERT INTO T (A) SELECT P FROM (SELECT P FROM X UNION ALL SELECT Q FROM Y)", {("A", "X|P"), ("A", "Y|Q")}, 0),
    ("INSERT INTO T (A) SELECT (SELECT MAX(b.Y) FROM B b WHERE b.K = x.K) FROM X x", {("A", "B|Y")}, 0),
    ("INSERT INTO T (A) SELECT (SELECT x.P || b.Y FROM B b) FROM X x", {("A", "B|Y"), ("A", "X|P")}, 0),
    ("MERGE INTO T USING (SELECT K, V + W AS VW FROM X) S ON (T.K = S.K) WHEN MATCHED THEN UPDATE SET T.A = S.VW WHERE T.Z = 1 WHEN NOT MATCHED THEN INSERT (K, A) VALUES (S.K, S.VW)", {("A", "X|V"), ("A", "X|W"), ("K", "X|K")}, 0),
    ("UPDATE A7 a SET a.X = (SELECT MAX(b.Y) FROM B7 b WHERE b.K = a.K), a.Z = a.W WHERE a.Q = 1", {("X", "B7|Y"), ("Z", "A7|W")}, 0),
    ("UPDATE T AS x SET (P, Q) = (SELECT b.M, b.N FROM B b)", {("P", "B|M"), ("Q", "B|N")}, 0),
    ("INSERT INTO T (A, B) SELECT z.P, x.Q FROM X x", {("B", "X|Q")}, 1),
    ("INSERT INTO T (A) SELECT P FROM X, Y", set(), 1),
    ("INSERT INTO T (A) SELECT P FROM X, (SELECT P FROM Y) q", {("A", "Y|P")}, 0),
    ("INSERT INTO T (A) SELECT q.NOPE FROM (SELECT P FROM X) q", set(), 1),
    ("INSERT INTO T SELECT * FROM X", set(), 1),
    ("INSERT INTO T (A) SELECT q.P FROM (SELECT * FROM X) q", {("A", "X|P")}, 0),
    ("INSERT INTO T (A) SELECT EXTRACT(YEAR FROM b.D) FROM B b", {("A", "B|D")}, 0),
    ('INSERT INTO T (A) SELECT b."X" || \'(SELECT Z FROM Q)\' FROM B b', {("A", "B|X")}, 0),
    ("INSERT INTO T (A) WITH RECURSIVE u AS (SELECT P FROM X UNION ALL SELECT u.P FROM u) SELECT u.P FROM u", {("A", "X|P")}, 0),
    ("INSERT INTO T (A) WITH u (C) AS (SELECT P FROM X) SELECT u.C FROM u", {("A", "X|P")}, 0),
    ("INSERT INTO T (A) WITH u AS (SELECT P FROM X) SELECT v.P FROM (SELECT u.P FROM u) v", {("A", "X|P")}, 0),
    ("INSERT INTO T (A, B) SELECT s.*, x.Q FROM (SELECT P FROM Y) s, X x", {("A", "Y|P"), ("B", "X|Q")}, 0),
]


@pytest.fixture(scope="module")
def traced(spark):
    """All statements at once, one file each; two files of one member name."""
    files = spark.createDataFrame([(f"/e/{k}/M", "M", "SQL", stmt + ";") for k, (stmt, *_) in enumerate(CASES)], "path string, member string, language string, text string")
    columns, gaps = scope_columns(sql_statements(files))
    return columns.collect(), gaps.collect()


@pytest.mark.parametrize("k", range(len(CASES)))
def test_statement(traced, k):
    columns, gaps = traced
    _, want, lost = CASES[k]
    assert {(r.target_column, r.source) for r in columns if r.path == f"/e/{k}/M"} == want
    assert len([r for r in gaps if r.path == f"/e/{k}/M"]) == lost


def test_each_branch_keeps_its_own_transformation(spark):
    files = spark.createDataFrame([("/e/M", "M", "SQL", "INSERT INTO T (A) SELECT P || Q FROM X WHERE X.Z = 1 UNION SELECT R FROM Y;")], "path string, member string, language string, text string")
    columns, _ = scope_columns(sql_statements(files))
    assert {(r.source, r.transformation, r.filter) for r in columns.collect()} == {("X|P", "P || Q", "X.Z = 1"), ("X|Q", "P || Q", "X.Z = 1"), ("Y|R", "direct", None)}


def test_declared_columns_write_stars_out(spark):
    files = spark.createDataFrame([("/e/M", "M", "SQL", "INSERT INTO T (A, B) SELECT * FROM X;")], "path string, member string, language string, text string")
    declared = spark.createDataFrame([("X", 0, "P"), ("X", 1, "Q")], "table string, pos int, column string")
    columns, gaps = scope_columns(sql_statements(files), declared)
    assert {(r.target_column, r.source) for r in columns.collect()} == {("A", "X|P"), ("B", "X|Q")} and gaps.count() == 0


def test_no_statements(spark):
    stmts = spark.createDataFrame([], "path string, program string, seq int, stmt string")
    columns, gaps = scope_columns(stmts)
    assert columns.count() == 0 and gaps.count() == 0
