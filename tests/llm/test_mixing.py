import math
import re

import pytest

import weftline.llm.mixing as M
from weftline.llm.mixing import cycling_weights, expected_copies, mix, mix_plan, mix_report, sample_sizes, targets


def make(spark, n=3000):
    rows = [(i, " ".join(["w"] * (i * 7919 % 97 + 1)), "hot" if i % 3 else f"s{i % 5}", 1) for i in range(n)]
    rows += [(None, "a b c", None, 1), (7, None, None, 1), (8, "", "tiny", 1), (9, "one two", "tiny", 1), (9, "one two", "tiny", 1), (10, "x " * 5000, "s1", 1)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, size int")


def test_targets_are_reshared_until_none_is_above():
    got = targets([100, 10, 1000], [1.0, 8.0, 1.0])
    assert got == [300.0, 30.0, 780.0]
    assert targets([0, 10], [1.0, 1.0]) == [0.0, 10.0]
    assert sum(targets([50, 70, 90], cycling_weights(["a", "b", None]))) == 210


def test_each_source_comes_near_its_target(spark):
    rows, df = make(spark)
    out = mix_report(df.repartition(7)).collect()
    assert len(out) == len(rows)
    size = {}
    for _, t, s, _ in rows:
        size[s] = size.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, targets([size[s] for s in names], cycling_weights(names)), strict=True))
    by_target = {}
    for r in out:
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        by_target.setdefault((r.source_size, round(r.target, 6)), []).append(r.taken)
    for s in names:
        taken = by_target[(size[s], round(want[s], 6))]
        if s in ("hot", "s0", "s1", "s2"):
            assert abs(sum(taken) - want[s]) <= 0.02 * want[s] + max(len((t or "").split()) for _, t, o, _ in rows if o == s) / 2
    again = mix_report(df.repartition(3)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken)
    assert sorted(map(key, out)) == sorted(map(key, again))


def test_copies_meet_the_target_and_the_most():
    classes = [(1.0, 100), (0.5, 300), (0.25, 50)]
    got = expected_copies(classes, 900, 3.0)
    assert got[0] == 3.0 and got[1] == 2 * got[2] and abs(sum(e * n for e, (_, n) in zip(got, classes, strict=True)) - 900) < 1e-9
    assert expected_copies(classes, 1350, 3.0) == [3.0] * 3 and expected_copies([(1.0, 0)], 0, 3.0) == [0.0]
    assert sample_sizes([(0.4, 400.0, 1, 1000), (10.0, 500.0, 40, 2000)]) == [0, 18]
    assert sample_sizes([(0.4, 400.0, 1, 1000), (10.0, 500.0, 11, 550)]) == [1, 0] and sample_sizes([(0.4, 400.0, 1, 1000), (19.0, 950.0, 20, 1000)]) == [1, 7]


@pytest.mark.parametrize(("bits", "most_sorted"), [(10, 1000), (2, 3)])
def test_samples_equal_plain_pareto_sampling(spark, monkeypatch, bits, most_sorted):
    monkeypatch.setattr(M, "RANGE_BITS", bits)
    monkeypatch.setattr(M, "COUNTS", 50 // bits)
    monkeypatch.setattr(M, "SORTED", most_sorted)
    rows, df = make(spark, 700)
    plan = mix_plan(df).collect()
    units = {}
    for d, t, s, _ in rows:
        units[d, s, t or ""] = units.get((d, s, t or ""), 0) + 1
    assert len(plan) == len(units) and sum(r.rows for r in plan) == len(rows)
    ps = sorted({round(r.p, 9) for r in plan if r.source == "hot"})
    assert len(ps) > 20  # inclusion is unequal
    by_source = {}
    for r in plan:
        by_source.setdefault(r.source, []).append(r)
    for own in by_source.values():
        classes = {}
        for r in own:
            k = math.floor(math.log(r["size"] * r["rows"] + 1) / math.log(2) * 16)
            classes.setdefault(k, []).append(r)
        ks = sorted(classes, reverse=True)
        copies = expected_copies([(2 ** (-k / 64), sum(r["size"] * r["rows"] for r in classes[k])) for k in ks], own[0].target, 3.0)
        strata = {}
        for k, e in zip(ks, copies, strict=True):
            for r in classes[k]:
                assert (r.whole, r.p) == (int(e + 1e-9), pytest.approx(max(0.0, e - int(e + 1e-9)), abs=2e-9))
                strata.setdefault(k // 4, []).append(r)
        sizes = sample_sizes([(sum(r.p for r in v), sum(r.p * r["size"] * r["rows"] for r in v), sum(r.p > 0 for r in v), sum(r["size"] * r["rows"] for r in v if r.p > 0)) for v in strata.values()])
        for v, n in zip(strata.values(), sizes, strict=True):
            ranked = sorted((r for r in v if r.p > 0), key=lambda r: r.u / (1 - r.u) * (1 - r.p) / r.p)
            assert [r.copies - r.whole for r in ranked] == [1] * n + [0] * (len(ranked) - n)
            assert all(r.copies == r.whole for r in v if r.p == 0)


def test_clashing_names_and_repeated_rows(spark):
    rows = [(1, "a b", "s", 5, "x"), (1, "a b", "s", 5, "y"), (2, "c", "s", 6, "z"), (3, "d e f", None, 7, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int, row string")
    out = mix(df)
    assert out.columns == df.columns
    counts = {(r.doc_id, r.row): r["count"] for r in out.groupBy("doc_id", "row").count().collect()}
    assert counts.get((1, "x")) == counts.get((1, "y"))


def test_mixed_rows_follow_the_plan(spark):
    rows, df = make(spark, 900)
    plan = mix_report(df).groupBy("doc_id").sum("copies").collect()
    got = mix(df).groupBy("doc_id").count().collect()
    assert mix(df).columns == df.columns
    assert {r[0]: r[1] for r in plan if r[1]} == {r[0]: r[1] for r in got}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix_report(df).count() == 0 and mix(df).count() == 0
