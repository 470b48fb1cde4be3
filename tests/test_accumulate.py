from weftline.operators import accumulate as A

SCHEMA = "id string, ord int, language string, path string, columns array<string>, attributes map<string,string>, extra int"


def test_first_wins_and_nulls_do_not(spark):
    rows = [("a", 2, "X", "/2", ["q", None], {"k": "late", "m": "1"}, 1), ("a", 1, None, "/1", ["p", "q"], {"k": "early", "n": None}, 1), ("b", 5, None, None, None, None, 1), ("a", 2, "W", "/0", [], {"m": "0"}, 1), (None, 1, "Z", None, ["c"], {}, 1)]
    got = {r.id: (r.language, r.path, r.columns, r.attributes) for r in A.merged_nodes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"a": ("W", "/1", ["p", "q"], {"k": "early", "m": "0"}), "b": (None, None, [], {}), None: ("Z", None, ["c"], {})}
    assert A.merged_nodes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_order_of_first_coming(spark):
    rows = [("t", 3, "B", "two"), ("t", 1, "C", "one"), ("t", 2, "B", "one"), ("t", 9, "A", None), ("t", 3, "AA", "two"), ("u", 1, None, None)]
    got = {r.target: (r.sources, r.logic) for r in A.accumulated(spark.createDataFrame(rows, "target string, seq int, source string, logic string"), ["target"]).collect()}
    assert got == {"t": (["C", "B", "AA", "A"], "one; two"), "u": ([], "")}
