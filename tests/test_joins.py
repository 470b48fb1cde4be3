import re

from weftline.operators.joins import unique_matches

NAMES = ["PROD.CUST.D1", "PROD.CUST.D12", "PROD.ORD.DAT", "TEST.ORD.LOG", "ABCX", "AB", "X+Y.Z", "Q"]
TEMPLATES = ["PROD.CUST.D1*", "PROD.CUST.D12", "*.DAT", "*.LOG", "AB*X", "A*", "*", "**", "*CUST*", "*EST.O*", "*X+Y*", "*+*.Z", "Q", "Q*", "PROD.O*T", "*.ORD.*T", "ABC*BCX", "NONE*", "Z*.LOG", ""]


def test_every_shape_of_template_meets_its_names(spark):
    names, templates = (spark.createDataFrame([(x,) for x in xs], f"{c} string") for c, xs in (("name", NAMES), ("template", TEMPLATES)))
    want = {}
    for t in TEMPLATES:
        hits = [n for n in NAMES if re.fullmatch(".*".join(map(re.escape, t.split("*"))), n)]
        if len(hits) == 1:
            want[t] = hits[0]
    assert {"*.DAT", "AB*X", "*EST.O*"} <= want.keys()
    got = unique_matches(names, templates).collect()
    assert len(got) == len(want) and {r.template: r.name for r in got} == want
    one = unique_matches(names.where("name = 'Q'"), templates.where("template like '*%'")).collect()
    assert {(r.template, r.name) for r in one} == {("*", "Q"), ("**", "Q")}
