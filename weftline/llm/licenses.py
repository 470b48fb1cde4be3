"""License scans: templates with optional and replaceable regions, matched as token automata.

A template is the wording of a notice with markup: ``[words]`` may be left out, ``<m-n>`` stands for
m to n words of any kind, and ``(this|that)`` for one of several wordings; all other words are
mandatory. Templates and the base phrases are compiled into one automaton over words, and a place of
a text is accepted where the template's mandatory words stand there exactly. States are sets of places
in the templates, worked out when a task first needs them.

A task turns a text into a compact array of word codes, finds all places where two words in a row can
begin a template at once in numpy, and runs the automaton from these only; so a text's other words cost
a look-up each. Texts are read in stretches, so a word list never stands for a whole text.

The score is the largest share of a template's mandatory words that stand in the text from the
template's beginning on, where at least two words do; 1 where a template or a phrase is accepted.

Defined cases: a null or empty text has no words, no labels and score 0; rows with repeated or null ids
are each scanned; texts of any length take four bytes a word beside themselves; other columns are
ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import map_batches

#: The base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Notices of common licenses, as templates.
TEMPLATES = {
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [the software] to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        "(licensed|released|distributed|available) under the [terms of the] (mit|expat) license",
    ],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "(licensed|released|distributed|available) under the [terms of the] [new|modified|simplified|revised] [2 clause|3 clause] bsd license",
    ],
    "bsd-3": ["neither the name of <1-12> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "apache-2": [
        "licensed under the apache license [version] 2 [0]",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at [http|https] [www] apache org licenses license 2 0",
    ],
    "gpl-2": ["(under|of) the [terms of the] gnu general public license <0-8> version 2"],
    "gpl-3": ["(under|of) the [terms of the] gnu general public license <0-8> version 3", "licensed under [the] (gpl|gplv3) [version|v] 3"],
    "lgpl": ["(under|of) the [terms of the] gnu (lesser|library) general public license"],
    "agpl-3": ["(under|of) the [terms of the] gnu affero general public license <0-8> version 3"],
    "mpl-2": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "zlib": ["this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"],
    "cc-by": ["licensed under [a|the] creative commons attribution [(1|2|3|4) 0] [international|unported] license", "licensed under cc by (1|2|3|4) 0"],
    "cc-by-sa": ["licensed under [a|the] creative commons attribution (share alike|sharealike) [(1|2|3|4) 0] [international|unported] license", "licensed under cc by sa (1|2|3|4) 0"],
    "cc-by-nc": ["licensed under [a|the] creative commons attribution (non commercial|noncommercial) [(1|2|3|4) 0] [international|unported] license", "licensed under cc by nc (1|2|3|4) 0"],
    "cc0": ["to the extent possible under law <1-12> has waived all copyright and related or neighboring rights to"],
}

#: Bytes of a text that are cut into words at once; kept states of an automaton before it starts afresh.
STRETCH_BYTES, KEPT_STATES = 1 << 20, 1 << 16

# words of a lower-cased text, over its UTF-8 bytes: all bytes of other signs are from \x80
_word = re.compile(rb"[0-9a-z\x80-\xff]+")
_between = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
_markup = re.compile(r"<(\d+)-(\d+)>|([\[\]()|])|([^\s\[\]()|<>]+)|(\S)")

ANY, UNKNOWN = -1, 0


class Builder:
    """Places of all templates: word steps, free steps, and how many mandatory words lead to a place."""

    def __init__(self):
        self.codes: dict[bytes, int] = {}
        self.steps: list[list[tuple[int, int]]] = []
        self.free: list[list[int]] = []
        self.done: list[int] = []  # mandatory words before a place
        self.owner: list[int] = []
        self.accepts: dict[int, int] = {}
        self.begins: list[int] = []
        self.total: list[int] = []

    def place(self, done: int) -> int:
        self.steps.append([])
        self.free.append([])
        self.done.append(done)
        self.owner.append(len(self.total))
        return len(self.steps) - 1

    def word(self, at: int, word: str, mandatory: bool) -> int:
        to = self.place(self.done[at] + mandatory)
        self.steps[at].append((self.codes.setdefault(word.encode(), len(self.codes) + 1), to))
        return to

    def template(self, text: str) -> int:
        """Compile one template; returns its number."""
        parts = list(_markup.finditer(text))
        if bad := next((m for m in parts if m[5]), None):
            raise ValueError(f"not markup: {bad[0]!r} in {text!r}")
        first = self.place(0)
        end, rest = self.sequence(first, parts, True)
        if rest:
            raise ValueError(f"unbalanced markup in {text!r}")
        number = len(self.total)
        self.total.append(max(1, self.done[end]))
        self.begins.append(first)
        self.accepts[end] = number
        return number

    def sequence(self, at: int, parts: list[re.Match], mandatory: bool) -> tuple[int, list[re.Match]]:
        """Compile up to what closes the region; returns the last place and what is left, the closing sign first."""
        while parts and parts[0][3] not in ("]", ")", "|"):
            m, parts = parts[0], parts[1:]
            if m[4]:
                at = self.word(at, m[4], mandatory)
            elif m[1] is not None:
                low, high = int(m[1]), int(m[2])
                last = self.place(self.done[at])
                for k in range(high + 1):
                    if k >= low:
                        self.free[at].append(last)
                    if k < high:
                        to = self.place(self.done[at])
                        self.steps[at].append((ANY, to))
                        at = to
                at = last
            else:
                closing, ends, begun = {"[": "]", "(": ")"}[m[3]], [], len(self.done)
                while True:
                    entry = self.place(self.done[at])
                    self.free[at].append(entry)
                    end, parts = self.sequence(entry, parts, mandatory and m[3] == "(")
                    ends.append(end)
                    if not parts:
                        raise ValueError("unbalanced markup")
                    sign, parts = parts[0][3], parts[1:]
                    if sign != "|":
                        break
                if sign != closing:
                    raise ValueError("unbalanced markup")
                # of several wordings, as many words are mandatory as the shortest has
                shortest = min(self.done[e] for e in ends)
                self.done[begun:] = [min(d, shortest) for d in self.done[begun:]]
                last = self.place(shortest)
                for end in ends:
                    self.free[end].append(last)
                if m[3] == "[":
                    self.free[at].append(last)
                at = last
        return at, parts


class Automaton:
    """All templates as one automaton; states are sets of places, numbered as they are met."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, list[str]]):
        b = self.builder = Builder()
        self.labels, self.is_base = [], []
        for label, texts, base in [*((v, [k], True) for k, v in phrases.items()), *((k, v, False) for k, v in templates.items())]:
            for text in texts:
                b.template(text)
                self.labels.append(label)
                self.is_base.append(base)
        self.codes = b.codes
        self._forget()
        # words that can stand first, and pairs that can stand first and second
        n = len(self.codes) + 1
        self.begins = np.zeros((n, n), bool)
        for first in range(n):
            if (state := self.step(0, first)) is not None:
                self.begins[first] = [self.step(state, second) is not None for second in range(n)]

    def _forget(self) -> None:
        self.numbers: dict[frozenset[int], int] = {}
        self.places: list[frozenset[int]] = []
        self.moves: dict[tuple[int, int], int | None] = {}
        self.found: list[tuple[int, ...]] = []
        self.share: list[float] = []
        self._state(self.closure(self.builder.begins))

    def closure(self, places: Iterable[int]) -> frozenset[int]:
        seen, todo = set(), list(places)
        while todo:
            at = todo.pop()
            if at not in seen:
                seen.add(at)
                todo += self.builder.free[at]
        return frozenset(seen)

    def _state(self, places: frozenset[int]) -> int:
        if places not in self.numbers:
            b = self.builder
            self.numbers[places] = len(self.places)
            self.places.append(places)
            self.found.append(tuple(sorted(b.accepts[p] for p in places if p in b.accepts)))
            # all mandatory words are there once the template accepts
            self.share.append(max((1.0 if p in b.accepts else min(b.done[p], b.total[b.owner[p]] - 1) / b.total[b.owner[p]] for p in places), default=0.0))
        return self.numbers[places]

    def step(self, state: int, code: int) -> int | None:
        key = (state, code)
        if key not in self.moves:
            reached = {to for p in self.places[state] for c, to in self.builder.steps[p] if c in (code, ANY)}
            self.moves[key] = self._state(self.closure(reached)) if reached else None
        return self.moves[key]

    def word_codes(self, text: bytes) -> np.ndarray:
        """A code for each word of a text, UNKNOWN for words of no template."""
        parts, at, get = [], 0, self.codes.get
        while at < len(text):
            stop = len(text)
            if stop - at > STRETCH_BYTES and (m := _between.search(text, at + STRETCH_BYTES)):
                stop = m.start()
            words = _word.findall(text[at:stop].lower())
            parts.append(np.fromiter((get(w, UNKNOWN) for w in words), np.int32, len(words)))
            at = stop
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def scan(self, text: bytes) -> tuple[int, list[int], set[str], set[str], float]:
        """Of a text: number of words, starts of base phrases, their labels, all labels, score."""
        codes = self.word_codes(text)
        starts, base, labels, score = [], set(), set(), 0.0
        if len(self.places) > KEPT_STATES:
            self._forget()
        for at in np.flatnonzero(self.begins[codes[:-1], codes[1:]]).tolist():
            state, here = 0, at
            while here < len(codes) and (state := self.step(state, int(codes[here]))) is not None:
                here += 1
                for number in self.found[state]:
                    labels.add(self.labels[number])
                    score = 1.0
                    if self.is_base[number]:
                        starts.append(at)
                        base.add(self.labels[number])
                score = max(score, self.share[state])
        return len(codes), starts, base, labels, score


@functools.lru_cache(maxsize=2)
def compiled() -> Automaton:
    return Automaton(PHRASES, TEMPLATES)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] | None = None) -> DataFrame:
    """Every row's id, n_words, n_base, first_word, last_word, base_labels, labels, score; ``templates`` take the place of TEMPLATES."""

    def make():
        automaton = compiled() if templates is None else Automaton(PHRASES, templates)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for text in batch.column(1).to_pylist():
                n, starts, base, labels, score = automaton.scan(text or b"")
                rows.append((n, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(),) * 4 + (pa.string(),) * 2 + (pa.float64(),), strict=True)]
            return pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

        return step

    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return map_batches(docs.select(id_col, F.col(text_col).cast("string").cast("binary").alias("text_")), make, schema)
