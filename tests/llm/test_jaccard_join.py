import random
from collections import Counter

import numpy as np
import pytest

import weftline.llm.jaccard_join as J
from weftline.llm.components import components


def brute(rows, size, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
                root[find(a)] = find(b)
    least = {}
    for k, (d, _) in enumerate(rows):
        r = find(k)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(d, least[r])
    return sorted(((d is None, d or 0), len(s), least[find(k)] is None, least[find(k)] or 0) for k, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def make(seed, near=40):
    pick = random.Random(seed)
    vocab = [f"w{k}" for k in range(300)] + ["The", "the", "of", "É"]
    passage = [pick.choice(vocab) for _ in range(60)]
    rows = []
    for i in range(60):
        words = [pick.choice(vocab) for _ in range(pick.randrange(0, 160))]
        if i % 3 == 0:
            words += passage
        rows.append((i * 5 + 3, words))
        for _ in range(pick.randrange(0, 4)):
            other = list(words)
            for _ in range(pick.randrange(0, 5)):
                if other:
                    other[pick.randrange(len(other))] = pick.choice(vocab)
            rows.append((pick.randrange(10_000), other))
    base = [pick.choice(vocab) for _ in range(150)]
    for k in range(near):
        other = list(base)
        for _ in range(pick.randrange(0, 4)):
            other[pick.randrange(150)] = pick.choice(vocab)
        rows.append((20_000 + k, other))
    out = [(d, pick.choice([" ", "\n", "\t"]).join(w)) for d, w in rows]
    return out + [(1, None), (2, ""), (2, ""), (None, out[0][1]), (None, "lonely null id"), (4, "two words"), (6, "TWO words"), (8, "two"), (9, "x " * 30_000), (10, "x " * 29_000), (3, out[0][1])]


@pytest.mark.parametrize(("size", "percent", "pairwise", "block", "leaders", "rounds"), [(3, 90, 48, 200, 6, 4), (5, 80, 3, 7, 2, 2), (2, 60, 2, 5, 1, 1), (3, 70, 2, 4, 1, 0)])
def test_components_equal_brute_force(spark, monkeypatch, size, percent, pairwise, block, leaders, rounds):
    monkeypatch.setattr(J, "PAIRWISE", pairwise)
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "LEADERS", leaders)
    monkeypatch.setattr(J, "LEAD_ROUNDS", rounds)
    rows = make(size)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_shingles int").repartition(4)
    got = J.jaccard_components(docs, size, percent).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.n_shingles, r.component_id is None, r.component_id or 0) for r in got) == brute(rows, size, percent)


def test_tree_search_equals_brute_force():
    rng = np.random.default_rng(6)
    for percent in (50, 80, 90):
        base = [np.unique(rng.integers(0, 60, rng.integers(1, 40))) for _ in range(60)]
        sets = {s.tobytes(): s for b in base for s in (b, b[: len(b) // 2 + 1], b[:-1] if len(b) > 1 else b)}
        sets = list(sets.values())
        trie = J.Trie(sets)
        mask = np.zeros(100, bool)
        for q in sets:
            mask[q] = True
            got = sorted(trie.order[k] for k in trie.search(q, mask, np.ones(len(sets), bool), percent))
            mask[q] = False
            want = [k for k, s in enumerate(sets) if 100 * len(np.intersect1d(s, q)) >= percent * len(np.union1d(s, q))]
            assert got == want


def test_components_of_paths_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 130)}, 200: 200, 201: 200}
    assert components(df.limit(0)).count() == 0


def test_empty_table(spark):
    assert J.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_row_of_each_component_stays(spark):
    rows = [(None if d is None else k * 7 % 1009, t) for k, (d, t) in enumerate(make(9))]
    rows.append(rows[0])
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_chars long")
    kept = J.keep_one(docs, 5, 80)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    comps = {(c[2], c[3]) for c in brute(rows, 5, 80) if c[1]}
    empty = [(d is None, d or 0) for d, t in rows if not (t or "").split()]
    assert len(got) == len(comps) + len(empty)
    assert set(got) == comps | set(empty)


def test_rounds_of_leaders_merge_as_components_do(spark):
    """Two rounds of links to few leaders a group, against union-find; a group that is one component goes."""
    rng = np.random.default_rng(5)
    names = {g: [f"{g}n{k}" for k in range(30)] for g in range(4)}
    open_ = spark.createDataFrame([(g, n, n, False) for g, own in names.items() for n in own], "group long, name string, known string, main boolean")
    parent = {n: n for own in names.values() for n in own}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for _ in range(2):
        links = []
        for g, own in names.items():
            leaders = rng.choice(own, 4, replace=False).tolist()
            linked = own if g == 0 else rng.choice(own, 12, replace=False).tolist()
            links += [(m, leaders[0] if g == 0 else leaders[rng.integers(4)]) for m in linked]
        links = [(a, b) for a, b in links if root(a) != root(b)]
        open_ = J._merged(open_, spark.createDataFrame(links, "a string, b string"))
        for a, b in links:
            parent[root(a)] = root(b)
        names = {g: own for g, own in names.items() if len({root(n) for n in own}) > 1}
        assert 0 not in names and names
        rows = open_.collect()
        assert sorted(r["name"] for r in rows) == sorted(n for own in names.values() for n in own)
        pairs = {(r["known"], root(r["name"])) for r in rows}
        assert len(pairs) == len({k for k, _ in pairs}) == len({r for _, r in pairs})
        for g, own in names.items():
            sizes = Counter(root(n) for n in own)
            main = {root(r["name"]) for r in rows if r["group"] == g and r["main"]}
            assert len(main) == 1 and sizes[main.pop()] == max(sizes.values())
