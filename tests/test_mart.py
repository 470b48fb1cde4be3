from weftline.operators.mart import group_ranks


def test_ranks_of_groups_with_ties_nulls_and_a_hot_group(spark):
    rows = [(1 if k % 3 else None if k % 2 else 2, None if k % 11 == 0 else k % 7, k) for k in range(300)]
    df = spark.createDataFrame(rows, "g long, v long, k long").repartition(7)
    got = {(r.g, r.v): r["rank"] for r in group_ranks(df, "g", "v", "k").collect()}
    want = {}
    for g in {r[0] for r in rows}:
        of = [r[1] for r in rows if r[0] == g]
        for v in set(of):
            want[g, v] = 1 + sum(x is not None and (v is None or x > v) for x in of)
    assert got == want
    assert group_ranks(df.limit(0), "g", "v", "k").count() == 0
