from pyspark.sql import functions as F

from weftline.operators import review as R
from weftline.session import session, settings
from weftline.streaming import events as S


def test_ingest_keeps_the_latest_row(spark, tmp_path):
    src, target, ck = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ck"
    schema = "id long, v string, seq long"
    for batch in ([(1, "a", 1), (2, "b", 1)], [(1, "c", 2)], [(2, "old", 0)]):
        spark.createDataFrame(batch, schema).write.mode("append").parquet(src)
        S.ingest(spark.readStream.schema(schema).parquet(src), target, ck, ["id"], "seq").awaitTermination()
    assert {(r.id, r.v) for r in S.current(spark, target, ["id"], "seq").collect()} == {(1, "c"), (2, "b")}


def test_windowed_counts_equal_a_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src = f"{tmp_path}/e"
    e.coalesce(1).write.parquet(src)
    q = S.windowed_counts(spark.readStream.schema(e.schema).parquet(src)).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    want = S.windowed_counts(e)
    assert spark.table("w").exceptAll(want).count() == 0 and spark.table("w").count() == want.count()


def test_offline_provider_gate_and_retry(spark):
    constructs = spark.createDataFrame([(1, "insert into t select a from s"), (2, "drop table x")], "construct_id long, snippet string")
    kept = R.gated(R.cleaned(R.OfflineProvider().propose(constructs)), 60)
    assert [(r.source, r.target, r.status) for r in kept.collect()] == [("S", "T", "PROVISIONAL")]
    accepted = spark.createDataFrame([(1, "WRITES_TO"), (2, "READS_FROM"), (3, "WRITES_TO")], "construct_id long, edge_type string")
    m = spark.createDataFrame([(3, "A", "B"), (3, "", "C")], "construct_id long, source_column string, target_column string")
    retry = spark.createDataFrame([(1, "X", "Y"), (2, "X", "Y"), (3, "X", "Y")], m.schema)
    assert {tuple(r) for r in R.with_columns(accepted, m, retry).collect()} == {(1, "X", "Y"), (3, "A", "B")}


def test_settings(tmp_path, monkeypatch):
    f = tmp_path / "s.yaml"
    f.write_text("model_threshold: 0.7\nother: 1\n# model_provider: x\n")
    monkeypatch.setenv("MODEL_ENABLED", "true")
    got = settings(str(f))
    assert got["model_threshold"] == "0.7" and got["model_enabled"] == "true" and got["model_provider"] == "offline"
    assert callable(session) and F is not None
