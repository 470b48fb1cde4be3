import numpy as np

import weftline.llm.ann as A


def brute(rows, every, k):
    rows = sorted({(i, tuple(v)) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)})
    x = np.array([v for _, v in rows], np.float32).astype(float)
    out = {}
    for q, (i, _) in enumerate(rows):
        if i % every == 0:
            s = [(-float(np.dot(x[r], x[q])), rows[r][0]) for r in range(len(rows)) if r != q]
            out[i] = [(j, -d) for d, j in sorted(s)[:k]]
    return out


def make(n):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, 8))
    x[n // 2 :] *= rng.uniform(0.5, 2, (n - n // 2, 1))
    x[7 : n // 5] = x[7]  # a common vector
    rows = [(k, [float(f) for f in np.float32(v)]) for k, v in enumerate(x)]
    return rows + [(n, None), (n + 1, [0.0] * 8), (n + 2, [1.0] * 7 + [float("nan")]), (n + 3, [1.0] * 7 + [None]), (n + 4, [float("inf")] * 8), (None, [1.0] * 8), (n + 5, [1.0] * 3), (11, rows[11][1])]


def answer(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 0.0) for r in rows], "vec_id long, embedding array<float>, score double")
    got = {}
    for r in A.nearest(df, **kw).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    return got


def test_one_block_is_exact(spark):
    rows = make(400)
    got, want = answer(spark, rows), brute(rows, 20, 20)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]] and np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=1e-12)


def test_recall_with_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(A, "BLOCK", 64)
    monkeypatch.setattr(A, "ORDERS", 4)
    rows = make(1500)
    got, want = answer(spark, rows, every=20, k=10), brute(rows, 20, 10)
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want]
    assert np.mean(hits) >= 0.9


def test_few_rows_and_none(spark):
    assert answer(spark, [(0, [1.0, 2.0]), (5, [3.0, 1.0])]) == {0: [(5, 5.0)]}
    assert answer(spark, [(0, [1.0, 2.0])]) == {}
    assert answer(spark, [(0, None)]) == {}


def recall(got, want):
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want])


def test_descent_and_search_go_on_until_nothing_changes(spark, monkeypatch):
    monkeypatch.setattr(A, "BLOCK", 16)
    monkeypatch.setattr(A, "ORDERS", 2)
    x = np.float32(np.random.default_rng(6).normal(size=(2000, 8)))
    rows = [(k, [float(f) for f in v]) for k, v in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))]
    assert recall(answer(spark, rows), brute(rows, 20, 20)) >= 0.99


def test_pools_grow_with_the_nodes():
    assert A.pool_size(1) == A.pool_size(A.POOL_NODES) == A.POOL
    assert A.pool_size(16 * A.POOL_NODES) == 4 * A.POOL


def test_tight_cluster_and_one_very_long_vector(spark, monkeypatch):
    monkeypatch.setattr(A, "BLOCK", 32)
    monkeypatch.setattr(A, "ORDERS", 3)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1600, 8))
    x[400:1200] = x[0] + rng.normal(size=(800, 8)) * 1e-3  # equal codes, many blocks
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[1599] *= 1000
    rows = [(k, [float(f) for f in v]) for k, v in enumerate(np.float32(x))]
    got, want = answer(spark, rows), brute(rows, 20, 20)
    assert recall(got, want) >= 0.97
    assert all(1599 in {i for i, _ in got[q]} for q in want if 1599 in {i for i, _ in want[q]})


def test_equal_codes_are_dealt_anew_in_every_order(spark, monkeypatch):
    monkeypatch.setattr(A, "BLOCK", 16)
    monkeypatch.setattr(A, "ORDERS", 4)
    x = np.ones((256, 8), np.float32)
    x[:, 0] += np.arange(256, dtype=np.float32) * 1e-6
    nodes = spark.createDataFrame([(k, bytearray(v.tobytes())) for k, v in enumerate(x)], "node long, vec binary")
    seen = [len(r.nbrs) for r in A._start(nodes, 256, 8, "<f4", [3.0]).collect()]
    assert np.mean(seen) > 24  # one cut in all orders would show each node 15 others, or few more


def test_a_search_writes_a_row_for_blocks_and_parts_not_for_each_candidate(spark, monkeypatch):
    rows = {}
    write = A.materialise

    def counted(df, name, *more):
        out = write(df, name, *more)
        rows[name] = max(rows.get(name, 0), out.count())
        return out

    monkeypatch.setattr(A, "materialise", counted)
    x = np.float32(np.random.default_rng(8).normal(size=(2000, 8)))
    assert len(answer(spark, [(k, [float(f) for f in v]) for k, v in enumerate(x)])) == 100
    assert max(n for name, n in rows.items() if name not in ("vectors", "nodes", "graph")) <= 100


def test_equals_of_the_last_rank_are_ordered_by_id(spark):
    x = np.zeros((31, 64), np.float32)
    x[0, 0] = 1
    x[np.arange(1, 31), 0] = 0.5
    x[np.arange(1, 31), np.arange(1, 31)] = 1  # 30 different vectors as near to the first
    assert [i for i, _ in answer(spark, [(k, [float(f) for f in v]) for k, v in enumerate(x)], every=100)[0]] == list(range(1, 21))


def test_blocks_of_queries_do_not_depend_on_the_partitions(spark):
    x = np.random.default_rng(9).normal(size=(640, 8)).astype(np.float32)
    nodes = spark.createDataFrame([(k, bytearray(v.tobytes())) for k, v in enumerate(x)], "node long, vec binary").repartition(37)
    rows = A._dealt(nodes.select("node"), nodes, 640, 8, "<f4", 4, 128).where("tag = 0").collect()
    sizes = [len(r.a) // 8 for r in rows]
    assert sum(sizes) == 640 and len(rows) == len({r.block for r in rows}) == 10 and max(sizes) <= 2 * A.SHARE
