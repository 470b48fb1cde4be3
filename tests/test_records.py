import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import recordsort as R
from weftline.sources import fixed_width as X

CARD = "SORT FIELDS=(1,2,CH,A,3,2,PD,D,5,2,FI,A,7,2,ZD,D,9,1,BI,A)"


def test_order_of_typed_keys(spark):
    r = random.Random(5)
    rows = [(i, r.choice(["a", "B", "é"]), r.randint(-12, 12) * 11, r.randint(-300, 300), r.randint(-9, 9), r.randint(0, 255)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, t string, pd long, fi long, zd long, bi long").repartition(5)
    record = F.concat(F.rpad(F.col("t").cast("binary"), 2, F.lit(b" ")), X.packed(F.col("pd"), 2), X.binary_number(F.col("fi"), 2), X.zoned(F.col("zd"), 2).cast("binary"), X.binary_number(F.col("bi"), 1))
    got = {x.id: x.pos for x in R.sort_records(df.withColumn("record", record), "record", CARD, ["id"]).collect()}
    want = sorted(rows, key=lambda x: (x[1].encode().ljust(2), -x[2], x[3], -x[4], x[5], x[0]))
    assert got == {x[0]: k for k, x in enumerate(want, 1)}


def test_malformed_short_and_equal(spark):
    rows = [(1, b"12"), (2, b"1}"), (3, b"0}"), (4, b"00"), (5, b"xx"), (6, b"1"), (7, None), (8, b"12"), (9, b"9\xff"), (10, b"0{")]
    df = spark.createDataFrame(rows, "id long, record binary")
    order = lambda card: [x.id for x in R.sort_records(df, "record", card, ["id"]).orderBy("pos").collect()]
    assert order("SORT FIELDS=(1,2,ZD,A)") == [7, 6, 9, 5, 2, 3, 4, 10, 1, 8]
    assert order("SORT FIELDS=(1,2,A),FORMAT=CH") == [7, 4, 10, 3, 6, 1, 8, 2, 9, 5]
    packed = spark.createDataFrame([(1, b"\x1c"), (2, b"\x1d"), (3, b"\x0d"), (4, b"\x0c"), (5, b"\xaa"), (6, b"\x11"), (7, b"\x2f")], "id long, record binary")
    assert [x.id for x in R.sort_records(packed, "record", "SORT FIELDS=(1,1,PD,D)", ["id"]).orderBy("pos").collect()] == [7, 1, 3, 4, 2, 5, 6]


def test_empty_and_single_digit(spark):
    empty = spark.createDataFrame([], "id long, record binary")
    assert R.sort_records(empty, "record", "SORT FIELDS=(1,2,CH,A)", ["id"]).count() == 0
    one = spark.createDataFrame([(1, b"5"), (2, b"J"), (3, b"{")], "id long, record binary")
    assert [x.id for x in R.sort_records(one, "record", "MERGE FIELDS=(1,1,ZD,A)", ["id"]).orderBy("pos").collect()] == [2, 3, 1]


@pytest.mark.parametrize("card", ["SORT FIELDS=COPY", "SORT FIELDS=(1,2,A)", "SORT FIELDS=(1,2,XX,A)", "SORT FIELDS=(1,2,CH,A,3)", "SORT FIELDS=(0,2,CH,A)"])
def test_cards_that_cannot_be_read(card):
    with pytest.raises(ValueError):
        R.key_list(card)


def test_built(spark):
    assert spark.range(1).select(R.built(F.lit("ABCDEF"), [(5, 3), (1, 2)])).first()[0] == "EF AB"
