"""The states of inferred edges, with a provider that answers from tables and counts what it is asked."""

import json

import pytest
from pyspark.sql import functions as F

from weftline.operators import inference as I

CONSTRUCTS = [(k, f"p{k}", "DYNAMIC_SQL", "/e/a", 7 * k, f"snippet {k}", "context") for k in range(1, 6)]
PROPOSALS = [
    (1, 0, "table:a", "Table", "File:b", "file", "WRITES_TO", [("X", "Y", None)], "why"),
    (1, 1, "A", "Table", "B", "file", "WRITES_TO", [("Q", "Q", None)], "the same once more"),
    (1, 2, "A", "Table", "unknown", None, "WRITES_TO", None, "no anchor"),
    (2, 0, "A", "Table", "C", None, None, None, "no columns yet"),
    (3, 0, "A", "Table", "C", None, "WRITES_TO", [("", "Y", None)], "no columns at all"),
    (4, 0, "S", "File", None, None, "READS_FROM", None, "read"),
    (4, 1, "S", "File", "T", None, "COPIES", None, "unknown type"),
    (5, 0, "A", None, "LOW", None, "WRITES_TO", [("X", "Y", None)], "low"),
    (5, 1, "A", None, "SILENT", None, "WRITES_TO", [("X", "Y", None)], "the judge says nothing"),
]


class Tables:
    name, model = "tables", "none"

    def __init__(self, spark):
        self.spark, self.seen = spark, {"judge": [], "columns": []}

    def propose(self, constructs):
        kind = f"construct_id long, pos int, source_entity string, source_kind string, target_entity string, target_kind string, edge_type string, mappings {I.MAPPINGS}, reasoning string"
        return self.spark.createDataFrame(PROPOSALS, kind).withColumn("self_confidence", F.lit(0.5))

    def judge(self, proposals):
        self.seen["judge"].append(proposals.count())
        return proposals.where("target_entity <> 'SILENT'").select(*I.KEY, F.when(F.col("target_entity") == "LOW", 0.3).otherwise(0.817).alias("confidence"), F.lit("fine").alias("rationale"))

    def columns(self, proposals):
        self.seen["columns"].append(proposals.count())
        return proposals.where("construct_id = 2").select(*I.KEY, F.array(F.struct(F.lit("M").alias("source_column"), F.lit("N").alias("target_column"), F.lit("M + 1").alias("transformation"))).alias("mappings"))


@pytest.fixture
def constructs(spark):
    return spark.createDataFrame(CONSTRUCTS, "construct_id long, program string, construct_type string, path string, line int, snippet string, context string")


def test_states_and_edges(spark, constructs):
    provider = Tables(spark)
    rows = I.infer(constructs, provider)
    assert {(r.construct_id, r.target_entity, r.state, r.asked) for r in rows.collect()} == {(1, "B", "EMITTED", False), (2, "C", "EMITTED", True), (3, "C", "EMITTED", True), (4, "", "EMITTED", False), (5, "LOW", "DROPPED", False), (5, "SILENT", "DROPPED", False)}
    assert provider.seen == {"judge": [6, 0, 0], "columns": [0, 2, 0]}
    edges, columns = I.emitted(rows, provider)
    got = {(r.source_id, r.target_id, r.edge_type): r for r in edges.collect()}
    assert set(got) == {("PROGRAM:P1", "FILE:B", "WRITES_TO"), ("PROGRAM:P2", "TABLE:C", "WRITES_TO"), ("PROGRAM:P3", "TABLE:C", "WRITES_TO"), ("FILE:S", "PROGRAM:P4", "READS_FROM")}
    one = got["PROGRAM:P1", "FILE:B", "WRITES_TO"]
    audit = json.loads(one.audit)
    assert (one.status, one.confidence, audit["judge_confidence"], audit["source"], audit["self_confidence"]) == ("PROVISIONAL", 0.82, 0.82, "/e/a:7", 0.5)
    assert {(r.program, r.source_column, r.target_column, r.transformation) for r in columns.collect()} == {("p1", "X", "Y", "inferred"), ("p2", "M", "N", "M + 1")}


def test_a_restart_asks_nothing_again(spark, constructs, tmp_path):
    folder = f"file://{tmp_path}/states"
    first = I.infer(constructs, Tables(spark), folder=folder).collect()
    again = Tables(spark)
    assert sorted(map(str, I.infer(constructs, again, folder=folder).collect())) == sorted(map(str, first))
    assert again.seen == {"judge": [], "columns": []}


def test_nothing_to_infer(spark, constructs):
    assert I.infer(constructs.limit(0), Tables(spark)).count() == 0
