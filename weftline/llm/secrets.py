"""Secret scans: exact rules, and a character convolutional network over every other candidate.

The base rules (assignments, access keys, long hexadecimal runs) always count. Further
candidates are runs of 16 or more key characters outside base findings, also what a base
finding leaves of a longer run; each is scored by a small convolutional network, written in numpy, from
its characters and those around it. The network is trained on labelled findings: the tables
hold none, so they come from a seeded generator of secrets and of look-alikes in varied
surroundings. Scores are calibrated on a validation part, and the threshold is the highest
one that keeps ``RECALL`` of its secrets.

Defined cases: a null or empty text has no findings; rows with repeated ids are each scanned;
a very long candidate is scored in windows that overlap by half, by its largest score; other
columns are ignored. Offsets count code points.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import map_batches

KINDS = ("assign", "access", "hex", "model")
# Letters of the names are ASCII in either case; ignoring case would also match signs that fold to them.
_NAMES = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
SHORTEST = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{SHORTEST},}}")

Span = tuple[int, int, int]  # start, position in KINDS, end

#: Characters before, of and after a candidate that the network sees.
BEFORE, INSIDE, AFTER = 24, 48, 8
WINDOW = BEFORE + INSIDE + AFTER
FILTERS, WIDTH, DIM = 24, 5, 8
TRAIN, EPOCHS, RECALL = 4000, 8, 0.98


def base_spans(text: str) -> list[Span]:
    """Findings of the rules, leftmost and non-overlapping by kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Key-like runs outside base findings; a run that findings touch is cut into the pieces between them."""
    out, at = [], 0
    for start, end in sorted((a, b) for a, _, b in base):
        if start - at >= SHORTEST:
            out += [m.span() for m in CANDIDATE.finditer(text, at, start)]
        at = max(at, end)
    return out + [m.span() for m in CANDIDATE.finditer(text, at)]


# --- labelled findings -----------------------------------------------------------------


def labelled_findings(n: int = TRAIN, seed: int = 11) -> list[tuple[str, int, int, int]]:
    """Texts with one candidate each: text, start, end and whether it is a secret."""
    pick = random.Random(seed)
    letters, alnum = string.ascii_lowercase, string.ascii_letters + string.digits

    def word(lo=2, hi=9):
        return "".join(pick.choice(letters) for _ in range(pick.randrange(lo, hi)))

    def chars(alphabet, lo, hi):
        return "".join(pick.choice(alphabet) for _ in range(pick.randrange(lo, hi)))

    def secret():
        shape = pick.randrange(6)
        if shape == 5:
            return pick.choice(["ghp_", "sk_live_", "", ""]) + chars(string.ascii_letters, 20, 44)
        if shape == 0:
            return pick.choice(["ghp_", "xoxb-", "sk_live_", "pk-", "glpat-", ""]) + chars(alnum, 20, 44)
        if shape == 1:
            return "eyJ" + chars(alnum + "_-", 30, 80)
        if shape == 2:
            return chars(alnum + "+/", 28, 60) + pick.choice(["", "=", "=="])
        if shape == 3:
            return chars(string.ascii_uppercase + string.digits, 20, 40)
        return chars(string.ascii_lowercase + string.digits, 24, 48)

    def plain():
        shape = pick.randrange(13)
        if shape == 0:
            return "-".join([word(3, 9) for _ in range(pick.randrange(3, 6))] + [str(pick.randrange(2030))])
        if shape == 1:
            return f"{pick.randrange(1990, 2030)}-{pick.randrange(10, 13)}-{pick.randrange(10, 29)}T{pick.randrange(10, 24)}{pick.randrange(10, 60)}{pick.randrange(10, 60)}Z"
        if shape == 2:
            return "/".join([word(3, 9) for _ in range(pick.randrange(3, 6))] + [f"v{pick.randrange(99)}"])
        if shape == 3:
            return word(6, 14).capitalize() + word(6, 14).capitalize() + str(pick.randrange(1000))
        if shape == 4:
            return "_".join([word(3, 9) for _ in range(3)] + [str(pick.randrange(10**6))])
        if shape == 5:
            return pick.choice(["ISBN", "DOC", "no", "ref"]) + "-".join(str(pick.randrange(10 ** pick.randrange(2, 6))) for _ in range(pick.randrange(4, 6))) + "-x"
        if shape == 6:
            return (word(2, 5) * 8)[: pick.randrange(16, 40)] + str(pick.randrange(10))
        # without a digit, or without a letter
        if shape == 7:
            return pick.choice("-_/").join(word(3, 9) for _ in range(pick.randrange(3, 7)))
        if shape == 8:
            return word(2, 12) + "".join(word(3, 12).capitalize() for _ in range(pick.randrange(2, 5)))
        if shape == 9:
            return pick.choice("-=_+/") * pick.randrange(16, 80)
        if shape == 10:
            return word(16, 24)
        if shape == 11:
            return chars(string.digits, 16, 30)
        return (word(2, 5) * 12)[: pick.randrange(16, 60)]

    out = []
    while len(out) < n:
        is_secret = len(out) % 2
        value = secret() if is_secret else plain()
        if not CANDIDATE.fullmatch(value) or ACCESS.search(value) or HEX.search(value):
            continue
        lead = pick.choice(["key ", "Authorization: Bearer ", "credentials ", "auth=", "access ", "", "", "", "see ", "file "] if is_secret else ["see ", "file ", "path ", "id ", "", "", "", "key ", "page "])
        before = " ".join(word() for _ in range(pick.randrange(0, 6))) + pick.choice([" ", "\n", ' "'])
        after = pick.choice([" ", "\n", '" ', ". "]) + " ".join(word() for _ in range(pick.randrange(0, 3)))
        start = len(before) + len(lead)
        out.append((before + lead + value + after, start, start + len(value), is_secret))
    return out


# --- network ---------------------------------------------------------------------------


def windows(text: str, start: int, end: int) -> list[np.ndarray]:
    """Codes of the characters before, in and after a candidate; one window for each half INSIDE of a long one."""
    out = []
    for at in range(start, max(start + 1, end - INSIDE // 2), INSIDE // 2):
        stop = min(end, at + INSIDE)
        parts = (text[max(0, at - BEFORE) : at].rjust(BEFORE, "\0"), text[at:stop].ljust(INSIDE, "\0"), text[stop : stop + AFTER].ljust(AFTER, "\0"))
        out.append(np.minimum(np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4"), 128).astype(np.int64))
    return out


class CharNet:
    """Character embeddings, filters max-pooled apart over the candidate and its surroundings, and an output layer."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.emb = rng.normal(0, 0.3, (129, DIM))
        self.kernel = rng.normal(0, 0.2, (WIDTH * DIM, FILTERS))
        self.bias = np.zeros(FILTERS)
        self.out = rng.normal(0, 0.2, 4 * FILTERS)
        self.shift = np.zeros(1)
        self.slope, self.offset, self.threshold = 1.0, 0.0, 0.5
        self.inside = np.zeros(WINDOW - WIDTH + 1, bool)
        self.inside[BEFORE : BEFORE + INSIDE - WIDTH + 1] = True

    def _forward(self, codes: np.ndarray):
        x = self.emb[codes]
        cols = np.concatenate([x[:, k : k + WINDOW - WIDTH + 1] for k in range(WIDTH)], axis=2)
        h = np.maximum(cols @ self.kernel + self.bias, 0)
        real = (codes[:, : WINDOW - WIDTH + 1] > 0)[:, :, None]
        parts, at = [], []
        for mask in (self.inside, ~self.inside):
            own = np.where(mask[None, :, None], h, 0)
            at.append(own.argmax(1))
            parts.append(own.max(1))
            n = np.maximum((real & mask[None, :, None]).sum(1), 1)
            parts.append((own * real).sum(1) / n)  # the mean tells random runs from words
        return cols, h, real, np.concatenate(parts, axis=1), at

    def logits(self, codes: np.ndarray) -> np.ndarray:
        return self._forward(codes)[3] @ self.out + self.shift[0]

    def scores(self, codes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(codes) + self.offset, -30, 30)))

    def step(self, codes: np.ndarray, y: np.ndarray, state: dict, rate: float) -> None:
        cols, h, real, pooled, at = self._forward(codes)
        p = 1 / (1 + np.exp(-np.clip(pooled @ self.out + self.shift[0], -30, 30)))
        e = (p - y) / len(y)
        back = e[:, None] * self.out
        gh = np.zeros_like(h)
        rows, fs = np.arange(len(y))[:, None], np.arange(FILTERS)[None]
        for k, mask in enumerate((self.inside, ~self.inside)):
            np.add.at(gh, (rows, at[k], fs), back[:, 2 * k * FILTERS : (2 * k + 1) * FILTERS])
            own = real & mask[None, :, None]
            gh += own * (back[:, (2 * k + 1) * FILTERS : (2 * k + 2) * FILTERS] / np.maximum(own.sum(1), 1))[:, None, :]
        gh *= h > 0
        gcols = gh @ self.kernel.T
        gemb = np.zeros_like(self.emb)
        for k in range(WIDTH):
            np.add.at(gemb, codes[:, k : k + WINDOW - WIDTH + 1], gcols[:, :, k * DIM : (k + 1) * DIM])
        for name, grad in (("out", pooled.T @ e), ("shift", e.sum(keepdims=True)), ("kernel", np.einsum("npc,npf->cf", cols, gh)), ("bias", gh.sum((0, 1))), ("emb", gemb)):
            m, v, t = state.get(name, (0.0, 0.0, 0))
            m, v, t = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad, t + 1
            state[name] = (m, v, t)
            setattr(self, name, getattr(self, name) - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8))


@functools.lru_cache(maxsize=2)
def trained(n: int = TRAIN, seed: int = 11, recall: float = RECALL) -> CharNet:
    """A network fitted to three quarters of the labelled findings; calibration and threshold come from the rest."""
    rows = labelled_findings(n, seed)
    codes = np.stack([windows(t, a, b)[0] for t, a, b, _ in rows])
    y = np.array([r[3] for r in rows], float)
    own = np.arange(len(y)) % 8 < 6
    net, state, rng = CharNet(), {}, np.random.default_rng(seed)
    train = np.flatnonzero(own)
    for epoch in range(EPOCHS):
        for part in np.array_split(rng.permutation(train), max(1, len(train) // 64)):
            net.step(codes[part], y[part], state, 0.01 if epoch < EPOCHS - 2 else 0.003)
    z, held = net.logits(codes[~own]), y[~own]
    w, a = np.array([1.0, 0.0]), np.stack([z, np.ones_like(z)], 1)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(2), a.T @ (p - held) + 0.1 * (w - [1, 0]))
    net.slope, net.offset = float(w[0]), float(w[1])
    scores = np.sort(net.scores(codes[~own])[held == 1])
    net.threshold = float(min(0.9, scores[int((1 - recall) * len(scores))]))
    return net


# --- Spark jobs ------------------------------------------------------------------------


def find_all(texts: list[str], net: CharNet) -> list[list[Span]]:
    """Base and model findings of each text, by start and kind."""
    found, codes, owner = [], [], []
    for k, text in enumerate(texts):
        spans = base_spans(text)
        for start, end in candidates(text, spans):
            w = windows(text, start, end)
            codes += w
            owner += [(k, start, end)] * len(w)
        found.append(spans)
    for lo in range(0, len(codes), 512):
        for (k, start, end), s in zip(owner[lo : lo + 512], net.scores(np.stack(codes[lo : lo + 512])), strict=True):
            if s >= net.threshold and (start, 3, end) not in found[k][-1:]:
                found[k].append((start, 3, end))
    return [sorted(set(spans)) for spans in found]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Findings of every row: the id, n_assign, n_access, n_hex, base_sha256, spans, n_model."""
    sent = docs.sparkSession.sparkContext.broadcast(trained())

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows: list[list] = [[] for _ in range(6)]
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for spans in find_all(texts, sent.value):
                base = [s for s in spans if s[1] < 3]
                counts = [sum(s[1] == k for s in spans) for k in range(4)]
                for r, x in zip(rows, (*counts[:3], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), counts[3]), strict=True):
                    r.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(r, t) for r, t in zip(rows, kinds, strict=True))], [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_model"])

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_model long"
    return map_batches(docs.select(id_col, F.col(text_col).cast("string").alias("text_")), make, schema)


def redact(text: str, spans: list[Span], by: str = "[SECRET]") -> str:
    """The text with each stretch of findings replaced."""
    out, at, end = [], 0, -1
    for a, _, b in spans:
        if a >= end:
            out += [text[at:a], by]
        end = max(end, b)
        at = end
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with their findings replaced in the text; a null text stays null."""
    sent = docs.sparkSession.sparkContext.broadcast(trained())
    at = docs.columns.index(text_col)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(at).to_pylist()
            found = find_all([t or "" for t in texts], sent.value)
            new = [redact(t, s) if s else t for t, s in zip(texts, found, strict=True)]
            return batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

        return step

    return map_batches(docs, make, docs.schema)
