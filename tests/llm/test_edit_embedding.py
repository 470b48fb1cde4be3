import hashlib
import random

import numpy as np

from weftline.llm.edit_embedding import CLASSES, EMPTY, LEAVE, PERIOD, RECORDS, SLOTS, Print, codes, edit_fingerprints, fingerprint, likeness, near_links, walk


def plain_fingerprint(text):
    """The walk one step at a time, with the whole output written down."""
    if not text:
        return EMPTY
    step, output = 0, []
    for c in text:
        cls = (ord(c) * 2654435761 % (1 << 32)) >> 24
        leave = int(LEAVE[cls * PERIOD + step])
        output += [c] * ((leave - step) % PERIOD)
        step = leave
    out = []
    for k in range(SLOTS):
        pos = max(int(p) for p in RECORDS[k] if p < len(output))
        h = (ord(output[pos]) * 0x9E3779B97F4A7C15 ^ pos * 0xC2B2AE3D27D4EB4F) & ((1 << 64) - 1)
        h = ((h ^ h >> 29) * 0xBF58476D1CE4E5B9) & ((1 << 64) - 1)
        out.append(f"{h >> 56:02x}")
    return "".join(out)


def test_walk_equals_the_step_by_step_form():
    pick = random.Random(1)
    texts = ["".join(pick.choice("abc déf漢😀\n") for _ in range(pick.randrange(0, 300))) for _ in range(60)] + ["", "x"]
    prints = [Print(t) for t in texts]
    Print.all(prints)
    assert [p.bytes.hex() for p in prints] == [plain_fingerprint(t) for t in texts]
    assert LEAVE.shape == (CLASSES * PERIOD,)


def test_few_edits_keep_most_slots():
    pick = random.Random(2)
    kept, apart = [], []
    for _ in range(40):
        t = "".join(pick.choice("etaoin shrdlu") for _ in range(1500))
        at = pick.randrange(1400)
        edited = t[:at] + "Q" + t[at + 1 :]
        other = "".join(pick.choice("etaoin shrdlu") for _ in range(1500))
        a, b, c = (fingerprint(codes(x), walk([codes(x)], np.zeros(1))[0]) for x in (t, edited, other))
        kept.append(likeness(a, b))
        apart.append(likeness(a, c))
    assert np.mean(kept) > 0.8 and np.mean(apart) < 0.25


def test_rows_equal_a_plain_pass(spark):
    pick = random.Random(3)
    rows = [(i * 2, "".join(pick.choice("abc déf漢😀\n") for _ in range(pick.randrange(0, 200))), 1.0) for i in range(150)]
    rows += [(7, None, 1.0), (9, "", 1.0), (None, "first of all", 1.0), (11, "long " * 20000, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, near_next double").repartition(6)
    got = {r.doc_id: r for r in edit_fingerprints(docs).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(got) == len(rows)
    for k, (i, t, _) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 2
        edited = t[: len(t) - cut] + nxt[:cut]
        a, b, c = map(plain_fingerprint, (t, edited, nxt))
        same = lambda x, y: sum(x[j : j + 2] == y[j : j + 2] for j in range(0, 2 * SLOTS, 2)) / SLOTS
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b)
        assert (r.near_edited, r.near_next) == (same(a, b), same(a, c))


def test_repeated_rows_one_row_and_none(spark):
    docs = spark.createDataFrame([(1, "same")] * 5, "doc_id long, text string")
    out = edit_fingerprints(docs).collect()
    assert len(out) == 5 and {r.near_next for r in out} == {1.0}
    one = edit_fingerprints(docs.limit(1)).first()
    assert one.edited_sha256 == hashlib.sha256(b"sasa").hexdigest()
    assert edit_fingerprints(docs.limit(0)).count() == 0


def test_links_are_verified(spark):
    pick = random.Random(5)
    base = "".join(pick.choice("etaoin shrdlu") for _ in range(2000))
    texts = [base, base[:1990] + "xyz", base[:1980] + "QQ" + base[1982:], "".join(pick.choice("etaoin shrdlu") for _ in range(2000))]
    prints = edit_fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    links = near_links(prints).collect()
    fps = {r.doc_id: r.fingerprint for r in prints.collect()}
    near = {frozenset((r.class_a, r.class_b)) for r in links}
    assert frozenset((fps[0], fps[1])) in near or fps[0] == fps[1]
    assert not any(fps[3] in p for p in near)


def test_a_hot_band_is_compared_fully(spark, monkeypatch):
    import weftline.llm.edit_embedding as E

    monkeypatch.setattr(E, "BAND_BLOCK", 32, raising=False)
    pick = random.Random(6)
    common = [pick.randrange(256) for _ in range(SLOTS)]
    rows = []
    for _ in range(300):
        own = [pick.randrange(256) if k < 4 or pick.random() < 0.15 else x for k, x in enumerate(common)]
        own[4:8] = common[4:8]  # one band that all share, after a first slot that differs
        rows.append(bytes(own))
    want = {(min(a, b).hex(), max(a, b).hex()) for a in rows for b in rows if a < b and likeness(a, b) >= 0.72}
    got = [(r.class_a, r.class_b) for r in near_links(spark.createDataFrame([(k, x.hex()) for k, x in enumerate(rows)], "doc_id long, fingerprint string"), at_least=0.72).collect()]
    assert len(want) > 500 and len(got) == len(set(got)) and set(got) == want
