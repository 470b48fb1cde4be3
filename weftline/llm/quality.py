"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each whole text becomes a vector of statistics (lengths, repetition, compressibility, shares
of character classes), shares by their logit and counts by their log. Each class has a mean
and a covariance shrunk towards the pooled one and towards a multiple of the identity; its
Cholesky factor is kept, so a score is a difference of Mahalanobis log-densities, turned into
a probability by a logistic fit to scores of held-back training rows.

Defined cases: a null text counts as empty and is scored like any other; rows with repeated
ids are each scored; a label table with fewer than two rows of a class gives the share of
class 1 as every score (0.5 without any labels), and then ``keep_good`` keeps all rows, as
nothing tells them apart; few labels of a class are fitted with stronger shrinkage; other
columns are ignored.
"""

from __future__ import annotations

import operator
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import map_batches

#: Labelled rows that the classifier is fitted to at most, in the order of a hash of their id.
TRAIN_ROWS = 20_000
FEATURES = 19
_CLASS = np.zeros((9, 256))
for _b in range(256):
    _c = chr(_b)
    _CLASS[0, _b] = _b < 128 and _c.islower()
    _CLASS[1, _b] = _b < 128 and _c.isupper()
    _CLASS[2, _b] = _b < 128 and _c.isdigit()
    _CLASS[3, _b] = _c == " "
    _CLASS[4, _b] = _c == "\n"
    _CLASS[5, _b] = _c in ".,;:"
    _CLASS[6, _b] = _c in "!?"
    _CLASS[7, _b] = 32 < _b < 128 and not _c.isalnum() and _c not in ".,;:!?"
    _CLASS[8, _b] = _b >= 128


def _logit(x: float, n: float) -> float:
    """Logit of a share of ``n``, kept finite."""
    k = x * n
    return float(np.log((k + 0.5) / (n - k + 0.5)))


def statistics(text: str) -> list[float]:
    """The transformed statistics of one text."""
    data = text.encode("utf-8", "surrogatepass")
    words = text.split()
    n, size = len(words), len(data)
    bins = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    classes = (_CLASS @ bins).tolist()
    used = bins[bins > 0] / max(size, 1)
    counts = Counter(words)
    again = sum(map(operator.eq, words, words[1:]))
    lines = text.split("\n")
    line_counts = Counter(lines)
    repeated = sum(len(x) * (k - 1) for x, k in line_counts.items())
    return [
        np.log1p(n),
        np.log1p(size / max(n, 1)),
        np.log1p(len(counts)) - 0.85 * np.log1p(n),
        _logit(max(counts.values(), default=0) / max(n, 1), max(n, 1)),
        _logit(again / max(n, 1), max(n, 1)),
        np.log1p(len(lines)) - 0.8 * np.log1p(n),
        _logit(repeated / max(len(text), 1), max(len(text), 1)),
        np.log((len(zlib.compress(data, 1)) + 20) / (size + 20)),
        _logit(sum(map((4).__gt__, map(len, words))) / max(n, 1), max(n, 1)),
        float(-(used * np.log(used)).sum()),
        *(_logit(c / max(size, 1), max(size, 1)) for c in classes),
    ]


def _vectors(texts: list[str | None]) -> np.ndarray:
    return np.array([statistics(t or "") for t in texts], float).reshape(len(texts), FEATURES)


class Discriminant:
    """Two shrunk Gaussians and the logistic map of their log-density difference."""

    def __init__(self, x: np.ndarray, y: np.ndarray, shrink: float, ridge: float):
        self.scale = (x.mean(0), x.std(0) + 1e-6)
        z = self._scaled(x)
        means = [z[y == c].mean(0) for c in (0, 1)]
        covs = [np.cov(z[y == c], rowvar=False, bias=True) for c in (0, 1)]
        pooled = sum(c * (y == k).mean() for k, c in enumerate(covs))
        self.parts = []
        for mean, cov in zip(means, covs, strict=True):
            cov = (1 - shrink) * cov + shrink * pooled
            cov = (1 - ridge) * cov + ridge * max(np.trace(cov) / len(cov), 1e-6) * np.eye(len(cov))
            factor = np.linalg.cholesky(cov)
            self.parts.append((mean, np.linalg.inv(factor), float(np.log(np.diag(factor)).sum())))
        self.slope, self.shift = 1.0, 0.0

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.scale[0]) / self.scale[1], -8, 8)

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log-density of class 1 less that of class 0."""
        z = self._scaled(x)
        d = [-0.5 * (((z - mean) @ inverse.T) ** 2).sum(1) - logdet for mean, inverse, logdet in self.parts]
        return np.arcsinh((d[1] - d[0]) / 4)  # far tails count less

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(x) + self.shift, -30, 30)))


class Constant:
    def __init__(self, score: float):
        self.score = score

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.score)


def _logistic(d: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton steps with a small ridge."""
    w, a = np.zeros(2), np.stack([d, np.ones_like(d)], 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + 1e-3 * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        w -= np.linalg.solve(hess, grad)
    return float(w[0]), float(w[1])


def fit(x: np.ndarray, y: np.ndarray, folds: int = 4) -> Discriminant | Constant:
    """Choose the shrinkage by the held-back log-loss of folds, calibrate on the held-back scores, and fit to all rows."""
    fewest = min((y == 0).sum(), (y == 1).sum())
    if fewest < 2:
        return Constant(float(y.mean()) if len(y) else 0.5)
    order = np.random.default_rng(7).permutation(len(y)) % folds
    shrinks, ridges, few = (0.05, 0.2, 0.5), (0.001, 0.02, 0.1), fewest < 2 * folds
    if few:  # every fold leaves rows of both classes, and little is told from a class's own covariance
        folds = min(folds, int(fewest))
        for c in (0, 1):
            order[y == c] = np.arange((y == c).sum()) % folds
        shrinks, ridges = (0.9, 1.0), (0.1, 0.5, 0.9)
    best: tuple | None = None
    for shrink in shrinks:
        for ridge in ridges:
            held = np.zeros(len(y))
            for k in range(folds):
                held[order == k] = Discriminant(x[order != k], y[order != k], shrink, ridge).difference(x[order == k])
            slope, shift = (1.0, 0.0) if few else _logistic(held, y)  # too few scores to calibrate by
            p = 1 / (1 + np.exp(-np.clip(slope * held + shift, -30, 30)))
            loss = -np.mean(np.log(np.where(y == 1, p, 1 - p) + 1e-9))
            if best is None or loss < best[0]:
                best = (loss, shrink, ridge, slope, shift)
    model = Discriminant(x, y, best[1], best[2])
    model.slope, model.shift = best[3], best[4]
    return model


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", limit: int = TRAIN_ROWS) -> Discriminant | Constant:
    """Fit to at most ``limit`` labelled documents; of an id with several labels the smallest counts.

    The sample is of labels, so its ids (bounded) are broadcast and texts are not shuffled.
    """
    marks = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id_")).agg(F.min(label_col).cast("int").alias("y_"))
    marks = marks.orderBy(F.xxhash64("id_"), "id_").limit(limit)
    rows = docs.select(F.col(id_col).alias("id_"), F.col(text_col).cast("string").alias("text_")).join(F.broadcast(marks), "id_").select("y_", "text_")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = _vectors(batch.column(1).to_pylist())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])

        return step

    # ids repeated among the documents could exceed the bound, so the vectors are cut to it as well
    found = map_batches(rows, make, "y int, x array<double>").limit(2 * limit).toArrow()
    if not found.num_rows:
        return Constant(0.5)
    x = np.array(found.column("x").to_pylist(), float)
    y = np.array(found.column("y").to_pylist(), float)
    order = np.lexsort([*x.T, y])  # the fit does not depend on the order in which tasks ended
    return fit(x[order], y[order])


def score(docs: DataFrame, model: Discriminant | Constant, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's id and score (0 to 1, higher: label 1 likelier)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.scores(_vectors(batch.column(1).to_pylist())))], [id_col, "score"])

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, F.col(text_col).cast("string").alias("text_")), make, f"`{id_col}` {kind}, score double")


def keep_good(docs: DataFrame, model: Discriminant | Constant, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows whose text scores at least ``threshold``, with all their columns; all rows if the model is a Constant."""
    if isinstance(model, Constant):
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pa.array(sent.value.scores(_vectors(batch.column(at).to_pylist())) >= threshold))

        return step

    return map_batches(docs, make, docs.schema)
