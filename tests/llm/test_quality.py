import random

import numpy as np

from weftline.llm.quality import Constant, Discriminant, fit, keep_good, score, statistics, train


def make(n=400):
    pick = random.Random(2)
    vocab = ["".join(pick.choice("etaoinshr") for _ in range(pick.randrange(1, 9))) for _ in range(900)]
    rows = []
    for i in range(n):
        words = [pick.choice(vocab) for _ in range(pick.randrange(20, 200))]
        good = i % 4 != 0
        text = " ".join(words) + "." if good else [" ".join([words[0]] * 90), "!! ".join(w.upper() for w in words), "### ".join(words)][i // 4 % 3]
        rows.append((i, text, int(good), "x"))
    return rows


def test_log_densities_match_the_textbook_formula():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (200, 3)), rng.normal(2, 0.5, (200, 3))])
    y = np.repeat([0.0, 1.0], 200)
    m = Discriminant(x, y, 0.2, 0.02)
    z = (x - x.mean(0)) / (x.std(0) + 1e-6)
    covs = [np.cov(z[y == c], rowvar=False, bias=True) for c in (0, 1)]
    dens = []
    for c in (0, 1):
        s = 0.8 * covs[c] + 0.2 * (covs[0] + covs[1]) / 2
        s = 0.98 * s + 0.02 * np.trace(s) / 3 * np.eye(3)
        d = z - z[y == c].mean(0)
        dens.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) - 0.5 * np.linalg.slogdet(s)[1])
    assert np.allclose(m.difference(x), np.arcsinh((dens[1] - dens[0]) / 4))


def test_held_out_rows_are_separated(spark):
    rows = make()
    docs = spark.createDataFrame([(i, t, s) for i, t, _, s in rows] + [(900, None, "x"), (901, "", "x"), (None, "word " * 60000, "x"), (3, rows[3][1], "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, q) for i, _, q, _ in rows if i % 2] + [(1, 0) for _ in range(0)] + [(i, q) for i, _, q, _ in rows if i % 8 == 0] + [(5, 1), (None, 1), (7, None)], "doc_id long, quality int")
    model = train(docs, labels)
    got = score(docs, model).collect()
    assert len(got) == 404 and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r.score for r in got}
    right = [(by_id[i] >= 0.7) == q for i, _, q, _ in rows if i % 8 == 4 or i % 8 == 2]
    assert np.mean(right) > 0.95
    kept = keep_good(docs, model, 0.7)
    assert kept.columns == docs.columns and kept.count() == sum(r.score >= 0.7 for r in got)


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert score(docs, train(docs, labels)).first().score == 0.5
    assert isinstance(fit(np.zeros((3, 19)), np.ones(3)), Constant)
    assert score(docs.limit(0), Constant(0.5)).count() == 0
    assert len(statistics("")) == 19 and all(map(np.isfinite, statistics("")))


def test_thin_or_one_sided_labels(spark):
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in make(40)], "doc_id long, text string")
    for share in (0.0, 0.5, 1.0):
        assert keep_good(docs, Constant(share), 0.7).count() == 40
    rows = make()
    x, y = np.array([statistics(t) for _, t, _, _ in rows]), np.array([float(q) for _, _, q, _ in rows])
    for few in (2, 3, 7):
        pick = np.concatenate([np.flatnonzero(y == 0)[:few], np.flatnonzero(y == 1)[:few]])
        model = fit(x[pick], y[pick])
        assert isinstance(model, Discriminant)
        s = model.scores(x)
        assert np.isfinite(s).all() and (s[y == 1].mean() > s[y == 0].mean() + 0.1)
    assert np.isfinite(fit(np.zeros((4, 19)), np.array([0.0, 0, 1, 1])).scores(x)).all()
