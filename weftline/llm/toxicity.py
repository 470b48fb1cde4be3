"""Convolutional toxicity classifier over hashed word embeddings, trained in numpy.

A word has two hashed embeddings, laid side by side, so that two words are confused only if
both hashes meet. The first coordinate of each is the smoothed log-odds of the bucket's
document frequency by label; the others are learnt. Filters of one, two and three words run
over the whole text, are rectified and max-pooled over all positions, and a logistic layer
makes the score. While the filters are trained, the log-odds of a document come from the
other folds, so that its own words don't give it away. On rows held back from that, the score
is calibrated and a threshold is chosen for each language, told from the text itself; scores
are shifted so that the threshold is 0.5 everywhere.

Defined cases: a null text counts as empty and is scored as such; rows with repeated ids are
each scored; without enough labels of both kinds every score is the share of label 1 (0
without labels); other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import map_batches

#: Labelled rows that the classifier is fitted to at most, by label, in the order of a hash of their id.
TRAIN_ROWS = (5000, 3000)
BUCKETS = 1 << 18
SIDE = 4  # coordinates of each of the two embeddings
FILTERS = 4
WIDTHS = (1, 2, 3)
EPOCHS = 6
FOLDS = 4
PSEUDO = 4.0  # pseudo-documents in the log-odds
#: Words of one batch of documents in memory, about.
BATCH_WORDS = 120_000
REMEMBERED = 600_000
#: Common words by which a text's language is told.
COMMON = {"en": ("the", "of", "and", "to"), "de": ("der", "die", "und", "ist"), "fr": ("le", "les", "et", "du"), "es": ("el", "los", "y", "una")}
LANGS = [*COMMON, "other"]


class Hashes(dict):
    """Word to two bucket numbers in one integer."""

    def __missing__(self, word: str) -> int:
        w = word.strip(".,;:!?\"'()[]*#$%&|-").lower().encode("utf-8", "surrogatepass")
        h = (zlib.crc32(w) % BUCKETS) << 32 | (zlib.crc32(b"#" + w) % BUCKETS)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h
        return h


def word_hashes(text: str, known: Hashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, text.split()), np.uint64)


def language(text: str) -> int:
    """The position in LANGS of the language whose common words are the most frequent."""
    low = f" {text.lower()} "
    counts = [sum(low.count(f" {w} ") for w in ws) for ws in COMMON.values()]
    most = max(counts)
    return counts.index(most) if most else len(COMMON)


def _pack(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both bucket numbers of all words of some documents, with BUCKETS as padding behind each; starts and ends."""
    pad = max(WIDTHS)
    lengths = np.array([len(d) + pad for d in docs])
    ends = np.cumsum(lengths)
    starts = ends - lengths
    flat = np.full(int(ends[-1]), np.uint64(BUCKETS << 32 | BUCKETS))
    for d, s in zip(docs, starts.tolist(), strict=True):
        flat[s : s + len(d)] = d
    return (flat >> np.uint64(32)).astype(np.int64), (flat & np.uint64(0xFFFFFFFF)).astype(np.int64), starts, ends


class Net:
    """Embeddings, filters and output layer. Activations are laid out by coordinate, then position."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.odds = np.zeros((2, BUCKETS + 1), np.float32)
        self.own = rng.normal(0, 0.05, (2, SIDE - 1, BUCKETS + 1)).astype(np.float32)
        self.own[:, :, BUCKETS] = 0
        self.filters = [rng.normal(0, 0.1, (w, FILTERS, 2 * SIDE)).astype(np.float32) for w in WIDTHS]
        for f in self.filters:  # begin by reading the log-odds
            f[0][:, [0, SIDE]] += 0.3
        self.bias = [np.full(FILTERS, -0.2, np.float32) for _ in WIDTHS]
        self.out = np.full(FILTERS * len(WIDTHS), 0.2, np.float32)
        self.shift = np.full(1, -2, np.float32)
        self.slope, self.offset, self.thresholds = 1.0, 0.0, np.zeros(len(LANGS))

    def embed(self, a: np.ndarray, b: np.ndarray, odds: np.ndarray | None = None) -> np.ndarray:
        odds = self.odds if odds is None else odds
        x = np.empty((2 * SIDE, len(a)), np.float32)
        for side, bucket in enumerate((a, b)):
            np.take(odds[side], bucket, out=x[side * SIDE])
            for k in range(SIDE - 1):
                np.take(self.own[side, k], bucket, out=x[side * SIDE + 1 + k])
        return x

    def pooled(self, x: np.ndarray, starts: np.ndarray, ends: np.ndarray, where: bool = False):
        """Max-pooled activations by document and filter and, on demand, the positions of the maxima."""
        most, at = [], []
        last = ends - 1
        h_all = np.concatenate([f.reshape(-1, 2 * SIDE) for f in self.filters]) @ x
        row = 0
        for f, bias in zip(self.filters, self.bias, strict=True):
            h = h_all[row : row + FILTERS]
            for k in range(1, len(f)):
                h[:, :-k] += h_all[row + k * FILTERS : row + (k + 1) * FILTERS, k:]
            row += len(f) * FILTERS
            for k in range(max(WIDTHS) - 1):  # no window holds words of two texts
                h[:, last - k] = -1e9
            most.append(np.maximum(np.maximum.reduceat(h, starts, axis=1).T + bias, 0))
            if where:
                at.append(np.stack([s + h[:, s:e].argmax(1) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]))
        return np.concatenate(most, axis=1), at

    def logits(self, docs: list[np.ndarray], odds: np.ndarray | None = None) -> np.ndarray:
        a, b, starts, ends = _pack(docs)
        return self.pooled(self.embed(a, b, odds), starts, ends)[0] @ self.out + self.shift[0]

    def scores(self, texts: list[str], known: Hashes | None = None) -> np.ndarray:
        known = Hashes() if known is None else known
        out = [self.logits(part) for part in batches_of([word_hashes(t, known) for t in texts])]
        z = self.slope * np.concatenate(out) + self.offset if out else np.zeros(0)
        return _sigmoid(z - self.thresholds[[language(t) for t in texts]])


class Constant:
    def __init__(self, score: float):
        self.score = score

    def scores(self, texts: list[str], known: Hashes | None = None) -> np.ndarray:
        return np.full(len(texts), self.score)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def batches_of(docs: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    part, n = [], 0
    for d in docs:
        part.append(d)
        n += len(d) + max(WIDTHS)
        if n >= BATCH_WORDS:
            yield part
            part, n = [], 0
    if part:
        yield part


def log_odds(docs: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Smoothed log-odds of label 1 given a bucket's presence, less those of the label alone, for both hashes."""
    counts = np.zeros((2, 2, BUCKETS + 1), np.float32)
    for d, label in zip(docs, y.astype(int).tolist(), strict=True):
        counts[0, label, np.unique((d >> np.uint64(32)).astype(np.int64))] += 1
        counts[1, label, np.unique((d & np.uint64(0xFFFFFFFF)).astype(np.int64))] += 1
    share = float(y.mean())
    odds = np.log(counts[:, 1] + PSEUDO * share) - np.log(counts[:, 0] + PSEUDO * (1 - share)) - np.log(share / (1 - share))
    odds[:, BUCKETS] = 0
    return odds.astype(np.float32)


class Adam:
    def __init__(self, rate: float):
        self.rate, self.state = rate, {}

    def __call__(self, name, value: np.ndarray, grad: np.ndarray, decay: float = 1e-4) -> None:
        m, v, t = self.state.get(name, (np.zeros_like(value), np.zeros_like(value), 0))
        grad = grad + decay * value
        m, v, t = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad, t + 1
        self.state[name] = (m, v, t)
        value -= self.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)


def _step(net: Net, adam: Adam, docs: list[np.ndarray], y: np.ndarray, odds: np.ndarray, rate: float = 0.02) -> None:
    a, b, starts, ends = _pack(docs)
    x = net.embed(a, b, odds)
    hidden, at = net.pooled(x, starts, ends, where=True)
    error = ((_sigmoid(hidden @ net.out + net.shift[0]) - y) / len(y)).astype(np.float32)
    back = error[:, None] * net.out * (hidden > 0)
    moved, grads = [], []
    for k, f in enumerate(net.filters):
        g, where = back[:, k * FILTERS : (k + 1) * FILTERS], at[k]
        gf = np.zeros_like(f)
        for j in range(len(f)):
            gf[j] = np.einsum("dnf,nf->fd", x[:, where + j], g)
            moved.append((where + j).ravel())
            grads.append((g[:, :, None] * f[j][None]).reshape(-1, 2 * SIDE))
        adam(("f", k), f, gf)
        adam(("b", k), net.bias[k], g.sum(0))
    adam("out", net.out, hidden.T @ error)
    adam("shift", net.shift, error.sum(keepdims=True), 0)
    pos, grad = np.concatenate(moved), np.concatenate(grads)  # only the words at the maxima move
    for side, bucket in enumerate((a[pos], b[pos])):
        real = bucket < BUCKETS
        for k in range(SIDE - 1):
            np.subtract.at(net.own[side, k], bucket[real], rate * len(y) / 8 * grad[real, side * SIDE + 1 + k])


def fit(docs: list[np.ndarray], langs: np.ndarray, y: np.ndarray, share: float | None = None, seed: int = 3) -> Net | Constant:
    """Train on four fifths, calibrate on the rest; ``share`` is the share of label 1 where rows were sampled by label."""
    if (y == 1).sum() < 10 or (y == 0).sum() < 10:
        return Constant(float(y.mean()) if len(y) else 0.0)
    rng = np.random.default_rng(seed)
    fold = rng.permutation(len(y)) % (FOLDS + 1)
    rest = np.flatnonzero(fold < FOLDS)
    net, adam = Net(seed), Adam(0.02)
    odds = [log_odds([docs[i] for i in rest if fold[i] != k], y[[i for i in rest if fold[i] != k]]) for k in range(FOLDS)]
    for _ in range(EPOCHS):
        for k in rng.permutation(FOLDS):
            own = rng.permutation([i for i in rest if fold[i] == k])
            for lo in range(0, len(own), 64):
                part = own[lo : lo + 64]
                _step(net, adam, [docs[i] for i in part], y[part], odds[k])
    net.odds = log_odds([docs[i] for i in rest], y[rest])
    held = np.flatnonzero(fold == FOLDS)
    z = np.concatenate([net.logits(p) for p in batches_of([docs[i] for i in held])])
    weight = np.ones(len(held))
    if share is not None and 0 < share < 1:
        weight = np.where(y[held] == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    net.slope, net.offset = _calibrate(z, y[held], weight)
    z = net.slope * z + net.offset
    pooled = _threshold(z, y[held], weight)
    for k in range(len(LANGS)):
        own = langs[held] == k
        net.thresholds[k] = _threshold(z[own], y[held][own], weight[own]) if min((y[held][own] == 1).sum(), (y[held][own] == 0).sum()) >= 20 else pooled
    net.odds = log_odds(docs, y)
    return net


def _calibrate(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    w, a = np.array([1.0, 0.0]), np.stack([z, np.ones_like(z)], 1).astype(float)
    for _ in range(40):
        p = _sigmoid(a @ w)
        grad = a.T @ (weight * (p - y)) + 0.05 * (w - [1.0, 0.0])
        w -= np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + 0.05 * np.eye(2), grad)
    return (float(w[0]), float(w[1])) if w[0] > 0.05 else (1.0, 0.0)


def _threshold(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The middle of the range of thresholds with the best F1, kept within odds of 9."""
    order = np.argsort(-z)
    hit, taken = np.cumsum((weight * y)[order]), np.cumsum(weight[order])
    f1 = 2 * hit / (taken + (weight * y).sum() + 1e-9)
    k = int(f1.argmax())
    low = z[order][k + 1] if k + 1 < len(z) else z[order][k] - 1
    return float(np.clip((z[order][k] + low) / 2, -2.2, 2.2))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", limits: tuple[int, int] = TRAIN_ROWS) -> Net | Constant:
    """Fit to at most ``limits`` labelled documents by label; of an id with several labels the largest counts.

    The sample is of labels, so its ids (bounded) are broadcast and texts are not shuffled.
    """
    marks = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id_")).agg(F.max(label_col).cast("int").alias("y_"))
    share = marks.agg(F.avg("y_")).first()[0]
    if share is None:
        return Constant(0.0)
    picked = [marks.where(F.col("y_") == k).orderBy(F.xxhash64("id_"), "id_").limit(limits[k]) for k in (0, 1)]
    rows = docs.select(F.col(id_col).alias("id_"), F.col(text_col).cast("string").alias("text_")).join(F.broadcast(picked[0].unionByName(picked[1])), "id_").select("y_", "text_")

    def make():
        known = Hashes()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            hashes = [word_hashes(t, known).tobytes() for t in texts]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([language(t) for t in texts], pa.int32()), pa.array(hashes, pa.binary())], ["y", "lang", "words"])

        return step

    found = map_batches(rows, make, "y int, lang int, words binary").limit(2 * sum(limits)).toArrow().to_pylist()
    found.sort(key=lambda r: (r["y"], zlib.crc32(r["words"]), r["words"]))  # the fit does not depend on the order in which tasks ended
    return fit([np.frombuffer(r["words"], np.uint64) for r in found], np.array([r["lang"] for r in found], int), np.array([r["y"] for r in found], float), float(share))


def score(docs: DataFrame, model: Net | Constant, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's id and score (0 to 1, higher: label 1 likelier; 0.5 is the threshold of its language)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        known = Hashes()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            scores = np.concatenate([sent.value.scores(texts[i : i + 256], known) for i in range(0, len(texts), 256)])
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores.astype(float))], [id_col, "score"])

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, F.col(text_col).cast("string").alias("text_")), make, f"`{id_col}` {kind}, score double")
