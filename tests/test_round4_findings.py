"""Faults found by review in round 4."""

import glob
import gzip
import json
import os

from weftline.operators import sink as K
from weftline.plans.catalogue import QUERIES
from weftline.session import settled, shared_dir


def plan_of_last_write(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    return runs.last().physicalPlanDescription()


def test_tables_that_pack_well_are_not_sent_through_the_driver(spark):
    held = settled(spark.range(60_000).selectExpr("id", "repeat(concat('NAME', id % 7), 60) as text"))  # 18 MB in a file of less than one
    before = {c: spark.conf.get(c, None) for c in ("spark.sql.sources.fileCompressionFactor", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    both = settled(held.join(held.selectExpr("id", "text as other"), "id"))
    assert "BroadcastHashJoin" not in plan_of_last_write(spark)
    assert both.count() == 60_000
    assert before == {c: spark.conf.get(c, None) for c in before}


def test_packed_files_join_to_the_packed_document(spark, tmp_path):
    a = spark.range(50).selectExpr("cast(id as string) id").repartition(7)
    K.export_json(f"file://{tmp_path}/x", "gzip", nodes=a, edges=a.limit(0))
    whole = gzip.decompress(b"".join(open(p, "rb").read() for p in sorted(glob.glob(f"{tmp_path}/x/part-*"))))
    assert sorted(int(x["id"]) for x in json.loads(whole)["nodes"]) == list(range(50))


def test_the_export_is_stored_packed(spark):
    folders = lambda: set(glob.glob(f"{shared_dir(spark).removeprefix('file://')}/weftline-export-*"))
    before = folders()
    text = QUERIES["graph_export"][0](spark, "/root/testdata/sf0.001").selectExpr("sum(length(entry))").first()[0]
    (new,) = folders() - before
    assert sum(os.path.getsize(p) for p in glob.glob(f"{new}/part-*")) < text / 3
