import random

import numpy as np

from weftline.llm.toxicity import BUCKETS, Constant, Hashes, Net, language, LANGS, score, train, word_hashes


def make(n=600):
    pick = random.Random(4)
    vocab = ["".join(pick.choice("etaoinshr") for _ in range(pick.randrange(2, 8))) for _ in range(700)]
    rows = []
    for i in range(n):
        words = [pick.choice(vocab) for _ in range(pick.randrange(30, 120))] + ["the", "of"]
        toxic = i % 5 == 0
        if toxic:
            words[pick.randrange(len(words))] = pick.choice(["Grumwit,", "blorkhead", "zatface!"])
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_held_out_rows_are_separated(spark):
    rows = make()
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows] + [(900, None, 0.5), (901, "", 0.5), (None, "word " * 40000 + "blorkhead", 0.5), (5, rows[5][1], 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 3] + [(None, 1), (7, None), (4, 0)], "doc_id long, toxic int")
    model = train(docs, labels)
    got = score(docs, model).collect()
    assert len(got) == 604 and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r.score for r in got}
    right = [(by_id[i] >= 0.5) == y for i, _, y in rows if i % 3 == 0]
    assert np.mean(right) > 0.97
    assert by_id[None] >= 0.5 > by_id[900]


def test_pooling_equals_a_plain_convolution():
    net, known = Net(), Hashes()
    net.odds[:, :BUCKETS] = np.random.default_rng(1).normal(0, 1, (2, BUCKETS))
    texts = ["a b c d e", "", "x", "b c"]
    got = net.logits([word_hashes(t, known) for t in texts])
    for t, z in zip(texts, got, strict=True):
        h = word_hashes(t, known)
        a = np.concatenate([(h >> np.uint64(32)).astype(int), [BUCKETS] * 3])
        b = np.concatenate([(h & np.uint64(0xFFFFFFFF)).astype(int), [BUCKETS] * 3])
        x = net.embed(a, b)
        pooled = []
        for f, bias in zip(net.filters, net.bias, strict=True):
            acts = [sum(f[j] @ x[:, p + j] for j in range(len(f))) for p in range(len(h) + 1)]
            pooled.append(np.maximum(np.max(acts, axis=0) + bias, 0))
        assert np.isclose(np.concatenate(pooled) @ net.out + net.shift[0], z, atol=1e-4)


def test_languages_and_missing_labels(spark):
    assert [LANGS[language(t)] for t in ("The cat of", "der Hund und", "le chat et", "el gato y", "xyz", "")] == ["en", "de", "fr", "es", "other", "other"]
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert score(docs, train(docs, spark.createDataFrame([], "doc_id long, toxic int"))).first().score == 0.0
    assert score(docs.limit(0), Constant(0.1)).count() == 0
