import hashlib
import re

from weftline.llm.fill_in_middle import fill_in_middle, restore, transform, unit_ends


def plain_form(row_id, text):
    """Cuts by joining lists of units."""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{row_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = min(h[0] % (len(units) + 1), h[1] % (len(units) + 1)), max(h[0] % (len(units) + 1), h[1] % (len(units) + 1))
    if text == "" or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return text, len(units), "plain", None, None
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return f"<S>{s}<P>{p}<M>{m}", len(units), "spm", len(p), len(m)
    return f"<P>{p}<S>{s}<M>{m}", len(units), "psm", len(p), len(m)


TEXTS = ["", " ", "one", " a  b\n", "é 漢字 🙂 end", "a <P> b", "x<S", "y <M>", "S> a < P> <", "  \x1c\x85 z", "w " * 5000]


def test_transform_matches_the_plain_form():
    forms = set()
    for k in range(400):
        text = TEXTS[k % len(TEXTS)]
        made = transform(str(k), text)
        assert made == plain_form(str(k), text)
        assert restore(made[0], made[2]) == text
        forms.add(made[2])
    assert forms == {"plain", "psm", "spm"}


def test_unit_ends_of_a_very_long_text():
    text = "ab " * 3_000_000
    ends = unit_ends(text)
    assert len(ends) == 3_000_001 and ends.itemsize == 4 and ends[-1] == len(text)


def test_rows_of_every_kind(spark):
    rows = [(k, TEXTS[k % len(TEXTS)], "clash", 7) for k in range(60)] + [(None, "a b c", None, None), (3, None, None, None), (3, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, n long")
    got = sorted(fill_in_middle(docs, keep_text=True).collect(), key=str)
    want = []
    for row_id, text, *_ in rows:
        out, n, form, p, m = plain_form("" if row_id is None else row_id, text or "")
        want.append((row_id, n, form, p, m, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest(), out))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert fill_in_middle(docs.limit(0)).count() == 0


def test_the_udf_runs_once(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = fill_in_middle(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
