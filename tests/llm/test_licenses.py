import random
import re

import pytest

from weftline.llm.licenses import PHRASES, TEMPLATES, Automaton, scan_licenses

AUTOMATON = Automaton(PHRASES, TEMPLATES)


def words_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def as_pattern(template):
    """A template as a regular expression over words that each end in a space."""
    out = re.sub(r"[^\s\[\]()|<>]+|<[^>]*>", lambda m: m[0] if m[0][0] == "<" else m[0] + "_", template)
    out = re.sub(r"\s+", "", out)
    out = out.replace("[", "(?:").replace("]", ")?").replace("(?:?:", "(?:")
    out = re.sub(r"\((?!\?)", "(?:", out)
    return re.compile("(?<!\\S)" + re.sub(r"<(\d+)-(\d+)>", r"(?:[^ ]+ ){\1,\2}", out.replace("_", " ")))


def plain_form(text):
    words = words_of(text)
    places = [(i, label) for phrase, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    base = {label for _, label in places}
    joined = "".join(w + " " for w in words)
    labels = base | {label for label, texts in TEMPLATES.items() for t in texts if as_pattern(t).search(joined)}
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels))


def scanned(text):
    n, starts, base, labels, score = AUTOMATON.scan(text.encode())
    assert 0 <= score <= 1 and (score == 1) == bool(labels)
    return n, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels))


def fill(template, pick):
    """A text that the template accepts."""
    def one(m):
        low, high = map(int, m.groups())
        return " ".join(pick.choice(["the", "gnu", "x", "Ünder"]) for _ in range(pick.randrange(low, high + 1)))

    text = re.sub(r"<(\d+)-(\d+)>", one, template)
    while m := re.search(r"\(([^()\[\]]*)\)|\[([^()\[\]]*)\]", text):
        options = (m[1] if m[1] is not None else m[2]).split("|") + [""] * (m[2] is not None)
        text = text[: m.start()] + pick.choice(options) + text[m.end() :]
    return text


TEXTS = ["", "...", "Released under the MIT License.", "under the mit license under the mit license", "Licensed under the Apache License, Version 2.0", "Licensed under CC BY-NC 4.0.", "cc by nc cc by cc by-nc", "underK the mit license", "éunder the mit license", "under the MIT licenses", "the terms of the GNU General Public License as published by the FSF, either Version 3", "under the gnu general public license version version 3"]


@pytest.mark.parametrize("text", TEXTS)
def test_texts_match_the_plain_form(text):
    assert scanned(text) == plain_form(text)


def test_every_template_accepts_its_fillings_and_nothing_less():
    pick = random.Random(4)
    for label, texts in TEMPLATES.items():
        for template in texts:
            for _ in range(8):
                words = fill(template, pick).split()
                text = "so " + " , ".join(words).upper() + " end"
                got = scanned(text)
                assert label in got[5].split(",") and got == plain_form(text)
                gone = pick.randrange(len(words))
                broken = " ".join(words[:gone] + words[gone + 1 :])
                assert scanned(broken) == plain_form(broken)


def test_random_words_of_templates_match_the_plain_form():
    pick = random.Random(9)
    vocabulary = "under the mit license licensed gnu general public version 2 3 0 cc by nc sa apache terms of a creative commons attribution x".split()
    for _ in range(300):
        text = " ".join(pick.choice(vocabulary) for _ in range(60))
        assert scanned(text) == plain_form(text)


def test_score_is_the_share_of_mandatory_words():
    automaton = Automaton({"a b c d": "x"}, {"y": ["q [z] r <0-2> (s|t u) v w"]})
    assert automaton.scan(b"a b c e")[4] == 0.75
    assert automaton.scan(b"a x b c d")[4] == 0
    assert automaton.scan(b"q r 1 2 t u v nothing")[4] == 4 / 5
    assert automaton.scan(b"q z r s v w")[2:] == (set(), {"y"}, 1.0)


def test_bad_markup_fails():
    for template in ("a [b", "a b]", "a (b]", "a <b c"):
        with pytest.raises(ValueError):
            Automaton({}, {"x": [template]})


def test_long_texts_are_read_in_stretches():
    text = ("é" * 300_000 + " released UNDER the MIT license ") * 6
    assert scanned(text)[:5] == (36, 6, 2, 32, "mit")


def test_rows_of_every_kind(spark):
    rows = [(k, t, 1, "clash") for k, t in enumerate(TEXTS)] + [(None, "cc by nc", 1, ""), (2, None, None, None), (2, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, labels string")
    got = scan_licenses(docs)
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert sorted((tuple(r)[:7] for r in got.collect()), key=str) == sorted(((r[0], *plain_form(r[1] or "")) for r in rows), key=str)
    assert scan_licenses(docs.limit(0)).count() == 0
