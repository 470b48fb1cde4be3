"""What the findings of round 3 named, each on a few rows."""

from weftline.operators import graph as G
from weftline.operators import joins as J
from weftline.operators import lineage as L
from weftline.operators import sink as K
from weftline.plans.catalogue import QUERIES
from weftline.session import settled
from weftline.sources import estate as E


def test_node_dedupe_takes_the_first_of_equal_numbers(spark, tmp_path):
    rows = [(1, 2, 7, 30, "A", "F"), (1, 2, 7, 10, "A", "F"), (1, 2, 7, 20, "A", "F"), (1, 3, 7, 5, "A", "F")]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_linestatus string")
    lines.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [tuple(r) for r in QUERIES["node_dedupe"][0](spark, str(tmp_path)).select("id", "path", "columns").collect()] == [("PART.7", "F30", "AF")]


def test_neighbourhood_does_not_move_the_edges(spark):
    edges = spark.range(1000).selectExpr("concat('JOB:', id % 10) source_id", "concat('PROGRAM:', id) target_id", "'EXECUTES' edge_type").union(spark.createDataFrame([("JOB:1", "PROGRAM:1", "EXECUTES")]))
    near = G.neighbourhood(edges, "JOB:1", 3)
    assert near.count() == 100
    assert "SortMergeJoin" not in near._jdf.queryExecution().executedPlan().toString()


def test_upsert_and_export_write_their_rows_once(spark, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(K, "settled", lambda df: seen.append(df.count()) or settled(df))
    a = spark.range(500).selectExpr("cast(id % 400 as string) id", "'x' v")
    for _ in range(2):
        assert K.upsert(a, f"file://{tmp_path}/t", ["id"]).count() == 400
    K.export_json(f"file://{tmp_path}/x", nodes=a, edges=a.limit(0))
    assert sum(seen) <= 2
    assert spark.read.text(f"file://{tmp_path}/x").where("value like '%\"id\"%'").count() == 400


def test_nearest_copybook_by_folders(spark):
    code = "       COPY BK.\n"
    book = "       01 X.\n"
    made = [("/a/b/P1", "COBOL"), ("/a/q/P2", "COBOL"), ("/z/P3", "COBOL"), ("P4", "COBOL"), ("/a/b/c/BK", "COPYBOOK"), ("/a/q/BK", "COPYBOOK"), ("/a/r/BK", "COPYBOOK"), ("/m/n/BK", "COPYBOOK")]
    files = spark.createDataFrame([(p, p.rsplit("/", 1)[-1], k, code if k == "COBOL" else book) for p, k in made], "path string, member string, language string, text string")
    got = {r.path: r.whence for r in E.cobol_lines(files).collect()}
    assert got == {"/a/b/P1": "/a/b/c/BK", "/a/q/P2": "/a/q/BK", "/z/P3": "/a/b/c/BK", "P4": "/a/b/c/BK"}


def test_moves_work_their_names_out_once(spark):
    """an inner explode has Spark work the names out again to see whether there are any."""
    rows = [("P", 0, "MOVE A (I) TO B OF C D"), ("P", 1, "ADD X TO TO-Y GIVING Z"), ("P", 2, "MOVE 'A' TO B"), ("P", 3, "COMPUTE ZERO = Q"), ("P", 4, "MOVE SPACES TO ALL")]
    stmts = spark.createDataFrame(rows, "program string, seq int, stmt string")
    moves = L.transforms(stmts)
    assert {(r.seq, r.target, r.source) for r in moves.collect()} == {(0, "B", "A"), (0, "D", "A"), (1, "Z", "X"), (1, "Z", "TO-Y")}
    plan = moves._jdf.queryExecution().optimizedPlan().toString()
    assert "size(" not in plan and plan.count("LogicalRDD") == 1


def test_nested_blocks_tell_a_source_once(spark):
    texts = ["EVALUATE A", "WHEN B", "EVALUATE A", "WHEN C", "MOVE X TO Y", "END-EVALUATE", "END-EVALUATE", "MOVE X TO W"]
    stmts = spark.createDataFrame([("P", 0, k, t.split()[0], t) for k, t in enumerate(texts)], "program string, sentence int, seq int, verb string, stmt string")
    got = sorted((r.seq, r.target, r.source) for r in L.conditional_sources(stmts, L.transforms(stmts)).collect())
    assert got == [(4, "Y", "A"), (4, "Y", "B"), (4, "Y", "C")]


def test_matches_are_counted_without_sorting_them(spark):
    """names kept beside a count had every match sorted in memory."""
    names = spark.createDataFrame([("AB1",), ("AB2",), ("CD1",), (None,)], "name string")
    templates = spark.createDataFrame([("AB*",), ("C*1",), ("*2",), ("CD1",), ("X*",), ("*",)], "template string")
    found = J.unique_matches(names, templates)
    assert sorted(map(tuple, found.collect())) == [("*2", "AB2"), ("C*1", "CD1"), ("CD1", "CD1")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate(key=[template" not in plan
    many = spark.range(2000).selectExpr("concat('D', id) name").distinct()
    few = spark.range(2000).selectExpr("concat('D', id % 40, '*') template").distinct()
    plan = J.unique_matches(many, few)._jdf.queryExecution().executedPlan().toString()
    assert "[kind_#" in plan and "Inner, BuildRight" in plan[plan.index("BroadcastHashJoin [kind_#") :].split("\n")[0]


def test_mart_moves_no_account_by_branch(spark):
    """totals of a few branches were joined by shuffling all accounts."""
    plan = QUERIES["unified_mart"][0](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join" in line and ("t_#" in line or "[branch#" in line) and "e_#" not in line]
    assert len(joins) == 2 and all("BroadcastHashJoin" in j for j in joins)
