"""Stored graphs: repeated loads, touched buckets, wipe, and the exported document."""

import glob
import json
import os

from weftline.operators import sink as K


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_upsert_replaces_and_repeats(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    first = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y"), (None, 1, "n"), ("a", 2, "later")], "id string, seq int, v string")
    assert rows(K.upsert(first, path, ["id"], ["seq"])) == [("a", 2, "later"), ("b", 1, "y"), (None, 1, "n")]
    before = {p: os.path.getmtime(p) for p in glob.glob(f"{tmp_path}/t/bucket=*/*.parquet")}
    second = spark.createDataFrame([("b", 9, "new"), (None, 9, "null again")], "id string, seq int, v string")
    for _ in range(2):
        assert rows(K.upsert(second, path, ["id"], ["seq"])) == [("a", 2, "later"), ("b", 9, "new"), (None, 9, "null again")]
    after = {p: os.path.getmtime(p) for p in glob.glob(f"{tmp_path}/t/bucket=*/*.parquet")}
    assert any(p in after and after[p] == t for p, t in before.items())  # the bucket of a is untouched
    assert rows(K.upsert(second.limit(0), path, ["id"])) == [("a", 2, "later"), ("b", 9, "new"), (None, 9, "null again")]


def test_graph_is_written_read_and_wiped(spark, tmp_path):
    folder = f"file://{tmp_path}/g"
    nodes = spark.createDataFrame([("TABLE:T", ["a", "b"]), ("PROGRAM:P", [])], "id string, columns array<string>")
    edges = spark.createDataFrame([("e1", "TABLE:T", "PROGRAM:P"), ("e2", "TABLE:T", "TABLE:GONE")], "edge_id string, source_id string, target_id string")
    columns = spark.createDataFrame([("TABLE:T|A", "FILE:F|C", "P", "direct")], "source_id string, target_id string, program string, transformation string")
    for _ in range(2):
        K.write_graph(folder, nodes, edges, columns)
    got = K.read_graph(spark, folder)
    assert rows(got["edges"]) == [("e1", "TABLE:T", "PROGRAM:P")]
    assert {r.id for r in got["columns"].collect()} == {"TABLE:T|A", "TABLE:T|B", "FILE:F|C"}
    assert {n: d.count() for n, d in got.items()} == {"nodes": 2, "columns": 3, "edges": 1, "column_edges": 1}
    K.wipe(spark, folder)
    K.wipe(spark, folder)
    assert not K.exists(spark, f"{folder}/nodes")


def test_export_is_one_document(spark, tmp_path):
    a = spark.range(50).selectExpr("cast(id as string) id", "array('x', null) c", "cast(null as string) n").repartition(7)
    K.export_json(f"file://{tmp_path}/x", nodes=a, edges=a.limit(0), unparsed=a.limit(1))
    text = "".join(open(p).read() for p in sorted(glob.glob(f"{tmp_path}/x/part-*")))
    got = json.loads(text)
    assert list(got) == ["nodes", "edges", "unparsed"] and got["edges"] == [] and len(got["unparsed"]) == 1
    assert sorted(int(x["id"]) for x in got["nodes"]) == list(range(50)) and got["nodes"][0]["n"] is None
