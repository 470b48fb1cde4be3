import random
import re
from collections import Counter

import numpy as np
import pytest

from weftline.llm import collocations as C


def plain_form(rows, longest=5, least=3, top=2000):
    """Counts every phrase of every piece, then scores and covers candidate by candidate."""
    out = []
    for lang in {lang or "und" for lang, _ in rows}:
        f, n = Counter(), 0
        for own, text in rows:
            if (own or "und") != lang:
                continue
            lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
                words = re.findall(r"[^\x20\x09]+", piece)
                n += len(words)
                f.update(tuple(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
        f = {p: a for p, a in f.items() if a >= least}
        kept = []
        for p, a in f.items():
            if len(p) < 2:
                continue
            if any(len(q) > len(p) and f[q] >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q in f):
                continue
            score, _, left, right = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            kept.append((" ".join(p), a, left, right, n, score))
        kept.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        out += [(lang, rank, *x) for rank, x in enumerate(kept[:top], 1)]
    return sorted(out)


def made_rows(seed=1, n=120):
    pick = random.Random(seed)
    vocabulary = ["the", "cat", "Sat", "on", "mat", "é", "漢", "x\x1c", "ünder", "a-b", "\x85", "İ"]
    rows = []
    for _ in range(n):
        words = [pick.choice(vocabulary[: pick.randrange(2, 13)]) for _ in range(pick.randrange(0, 30))]
        rows.append((pick.choice(["en", "en", "de", None]), "".join(w + pick.choice([" ", " ", " ", "\t ", ". ", "\n", ";x"]) for w in words)))
    return [*rows, ("en", None), ("en", ""), (None, " . \n"), ("en", "the cat sat on the mat " * 200), ("en", "the the the the the the the"), ("fr", "la vie " * 3)]


@pytest.mark.parametrize("block_bytes", [C.BLOCK_BYTES, 64, 7])
def test_equals_the_plain_form(spark, block_bytes):
    rows = made_rows()
    docs = spark.createDataFrame([(k, lang, text, 1, "clash") for k, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string, a int, phrase string")
    got = C.collocations(docs, least=3, block_bytes=block_bytes)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain_form(rows)


def test_ties_and_the_report_s_length(spark):
    rows = [("en", "b a. d c. f e. h g." * 5)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, C.collocations(docs, least=5, top=2).collect())) == plain_form(rows, least=5, top=2)


def test_empty_tables_and_texts(spark):
    docs = spark.createDataFrame([("en", None), (None, "")], "lang string, text string")
    assert C.collocations(docs).count() == 0
    assert C.collocations(docs.limit(0)).count() == 0


def test_words_of_one_hash_are_told_apart():
    keys, checks = np.array([5, 5, 5, 2, 5], np.uint64), np.array([1, 2, 1, 9, 2], np.uint64)
    first, counts = C.grouped(keys, checks, None)
    assert sorted(zip(keys[first].tolist(), checks[first].tolist(), counts.tolist(), strict=True)) == [(2, 9, 1), (5, 1, 2), (5, 2, 2)]


def test_hashes_do_not_depend_on_where_a_word_stands(monkeypatch):
    text = b"ab cd \xff ab  abcdefghijklmnopqrstuvwxyz cd abcdefghijklmnopqrstuvwxyz"
    whole = C.words_of(text)
    monkeypatch.setattr(C, "STRETCH_BYTES", 7)
    cut = C.words_of(text)
    for a, b in zip(whole, cut, strict=True):
        assert a.tolist() == b.tolist()
    words = [text[a:b] for a, b in zip(whole.start, whole.end, strict=True)]
    assert words == text.replace(b"\xff", b" ").split()
    assert len(set(zip(words, whole.hash.tolist(), whole.check.tolist(), strict=True))) == len(set(words))


def test_a_full_bitmap_changes_no_result(spark, monkeypatch):
    monkeypatch.setattr(C, "MOST_BITS", 1 << 10)
    rows = made_rows(2)
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, C.collocations(docs, least=3).collect())) == plain_form(rows)


def test_products_beyond_64_bits(spark):
    frequent = spark.createDataFrame([("en", "a b", 2, 4 * 10**12), ("en", "a", 1, 5 * 10**12), ("en", "b", 1, 6 * 10**12)], "lang string, phrase string, k int, a long")
    n = spark.createDataFrame([("en", 3 * 10**16)], "lang string, n long")
    assert C.cut_scores(frequent, n).first()["score"] == 1000 * 4 * 10**12 * 3 * 10**16 // (5 * 10**12 * 6 * 10**12)


def test_levels_emit_only_phrases_that_may_be_frequent(spark, monkeypatch):
    """All pairs of words are frequent, all but one of the phrases of three words are not."""
    words = [f"w{i}" for i in range(12)]
    rows = [("en", f"{a} {b} {c}.") for a in words for b in words for c in words] + [("en", "w0 w1 w2. " * 30)]
    texts = spark.createDataFrame([(lang, t.encode(), 1) for lang, t in rows], "lang string, data binary, a long")
    pairs = spark.createDataFrame([("en", f"{a} {b}") for a in words for b in words], "lang string, phrase string")
    bitmap = C.bitmap_of(pairs, 2)
    likely = C.likely_phrases(texts, 3, bitmap, 20)
    folded = b"\xff".join(t.encode().translate(C._FOLD) for _, t in rows)
    assert len(C.count_block(folded, "en", 3, bitmap)[0]) == 12**3
    assert C.count_block(folded, "en", 3, bitmap, None, likely)[0] == [b"w0 w1 w2"]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, C.collocations(docs, least=20).collect())) == plain_form(rows, least=20)


@pytest.mark.parametrize("least", [3, 300])
def test_a_full_sketch_changes_no_result(spark, monkeypatch, least):
    monkeypatch.setattr(C, "SKETCH_BITS", 6)
    monkeypatch.setattr(C, "SKETCH_ROW_BITS", 4)
    rows = made_rows(3) + [("en", "one two three four. " * 400)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, C.collocations(docs, least=least, block_bytes=64).collect())) == plain_form(rows, least=least)
