"""Toxicity by cumulative-link ordinal regression on sparse text features.

Features: which words, and which beginnings of words, a text has (hashed).
Grades: 0 for clean rows; toxic rows are graded 1 to 3 by how many marks of
toxicity they carry, cut at the terciles. The marks that grade a row are
chosen on the other folds of the sample, never on the row itself, so grades
don't restate what the model was given. One weight vector is shared by the
three ordered thresholds: P(grade > k) = sigmoid(w.x - t_k). The result is
the expected grade.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import text_of
from .common import SAMPLE_BYTES, labelled_sample, sampled_texts

SAMPLE_ROWS = 6000
FEATURES = 1500
BUCKET_BITS = 20
PREFIXES = range(3, 9)
LEAST_ROWS = 5
LEAST_ODDS = 1.5  # log odds ratio: words that merely come with long texts don't count
GRADES = 4
FOLDS = 4  # of the sample, for the marks that grade
RIDGE = 1e-4
REMEMBERED = 400_000
_WORD = re.compile(r"[^\W\d_]+")
_PART = 1_000_000


def _words(text: str) -> Iterator[list[str]]:
    text = text.lower()
    if len(text) <= _PART:
        yield _WORD.findall(text)
        return
    found = (m.group() for m in _WORD.finditer(text))
    while part := list(islice(found, _PART // 4)):
        yield part


def word_features(word: str) -> list[int]:
    """Buckets of the word itself and of its beginnings."""
    mask = (1 << BUCKET_BITS) - 1
    parts = [f"{word} ", *(word[:k] for k in PREFIXES if len(word) > k)]
    return [xxhash.xxh32_intdigest(p) & mask for p in parts]


class _Words(dict):
    """A number for each word, and per number the active features."""

    def __init__(self, active: dict[int, int]):
        super().__init__()
        self.active, self.flat, self.starts = active, [], [0]

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.flat.extend(a for f in word_features(word) if (a := self.active.get(f)) is not None)
        self.starts.append(len(self.flat))
        return number


class Features:
    """The active features present in a text."""

    def __init__(self, active: np.ndarray, limit: int = REMEMBERED):
        self.active, self.limit = {int(b): i for i, b in enumerate(active)}, limit
        self.words = _Words(self.active)

    def present(self, text: str) -> np.ndarray:
        if len(self.words) > self.limit:
            self.words = _Words(self.active)
        number, flat, starts = self.words.__getitem__, self.words.flat, self.words.starts
        out: set[int] = set()
        for words in _words(text):
            for i in set(map(number, words)):
                out.update(flat[starts[i] : starts[i + 1]])
        return np.fromiter(out, np.int64, len(out))


@dataclass
class Model:
    active: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.full(GRADES - 1, 40.0))

    def above(self, margins: np.ndarray) -> np.ndarray:
        """(rows, thresholds): P(grade > k)."""
        return 1 / (1 + np.exp(-np.clip(margins[:, None] - self.thresholds, -40, 40)))


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, n: int, width: int, grade: np.ndarray, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Cumulative-link logistic fit by Adam; rows and cols are the places of the ones.

    A grade that no row has leaves the two thresholds about it as close as they get.
    """
    over = (grade[:, None] > np.arange(GRADES - 1)).astype(float)
    base = np.log((n - over.sum(0) + 1) / (over.sum(0) + 1))
    w, first, gaps = np.zeros(width), base[0], np.log(np.maximum(np.diff(base), 0.05))
    state = [np.zeros(width + GRADES - 1) for _ in range(2)]
    for step in range(1, steps + 1):
        t = np.concatenate(([first], first + np.cumsum(np.exp(gaps))))
        margin = np.bincount(rows, w[cols], n)
        error = 1 / (1 + np.exp(-np.clip(margin[:, None] - t, -40, 40))) - over
        by_row = error.sum(1) / n
        d_t = -error.sum(0) / n
        d_gap = np.exp(gaps) * np.array([d_t[k + 1 :].sum() for k in range(GRADES - 2)])
        gradient = np.concatenate((np.bincount(cols, by_row[rows], width) + RIDGE * w, [d_t.sum()], d_gap))
        state[0] = 0.9 * state[0] + 0.1 * gradient
        state[1] = 0.99 * state[1] + 0.01 * gradient**2
        move = 0.05 * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
        w, first, gaps = w - move[:width], first - move[width], gaps - move[width + 1 :]
    return w, np.concatenate(([first], first + np.cumsum(np.exp(gaps))))


def _evidence(own: list[np.ndarray], y: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Per bucket how surely it goes with toxic rows: log odds ratio over its standard error, of these rows."""
    seen = np.zeros((2, 1 << BUCKET_BITS))
    for i in rows:
        seen[y[i], own[i]] += 1
    bad, good, toxic = seen[1], seen[0], y[rows].sum()
    clean = len(rows) - toxic
    odds = np.log((bad + 0.5) / (toxic - bad + 0.5)) - np.log((good + 0.5) / (clean - good + 0.5))
    spread = np.sqrt(1 / (bad + 0.5) + 1 / (good + 0.5) + 1 / (toxic - bad + 0.5) + 1 / (clean - good + 0.5))
    return np.where((bad + good >= LEAST_ROWS) & (np.abs(odds) >= LEAST_ODDS), odds / spread, 0)


def grades(own: list[np.ndarray], y: np.ndarray, folds: int = FOLDS) -> np.ndarray:
    """0 for clean rows, 1 to 3 for toxic ones by the marks they carry, chosen on the rows of the other folds.

    Rows with equal counts get equal grades: a tie lies below the cut, and
    where terciles coincide the grade between them stays empty.
    """
    n = len(y)
    place = np.empty(n, np.int64)
    for label in (0, 1):  # the folds hold both classes alike
        rows = np.flatnonzero(y == label)
        place[rows] = np.arange(len(rows)) % folds
    carried = np.zeros(n, np.int64)
    for k in range(folds):
        marks = _evidence(own, y, np.flatnonzero(place != k)) > 4
        for i in np.flatnonzero((place == k) & (y == 1)):
            carried[i] = marks[own[i]].sum()
    low, high = np.quantile(carried[y == 1], [1 / 3, 2 / 3])
    return np.where(y == 1, 1 + (carried > low) + (carried > high), 0)


def fit_texts(texts: list[str], toxic: list[int], features: int = FEATURES) -> Model:
    """Without rows of both classes every text is clean."""
    y = np.array(toxic, int)
    n = len(y)
    if n == 0 or y.min() == y.max():
        return Model()
    known: dict[str, list[int]] = {}
    own = []
    for text in texts:
        words = {w for part in _words(text) for w in part}
        for w in words:
            if w not in known:
                known[w] = word_features(w)
        own.append(np.unique(np.fromiter((f for w in words for f in known[w]), np.int64)))
    z = _evidence(own, y, np.arange(n))
    active = np.sort(np.argsort(-np.abs(z), kind="stable")[:features])
    active = active[np.abs(z[active]) > 2]
    if not len(active):
        return Model()
    at = np.full(1 << BUCKET_BITS, -1)
    at[active] = np.arange(len(active))
    cols = [c[c >= 0] for c in (at[f] for f in own)]
    rows = np.repeat(np.arange(n), [len(c) for c in cols])
    w, thresholds = fit_ordinal(rows, np.concatenate(cols), n, len(active), grades(own, y))
    return Model(active, w, thresholds)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on at most sample_rows labelled documents and sample_bytes of text outside the held-out fold.

    Repeated labels of a document count as their maximum, and of rows that share
    an id the smallest text; null labels, ids and texts don't count. Without
    rows of both classes, or from empty tables, every text is clean.
    """
    chosen = labelled_sample(labels, id_col, label_col, sample_rows)
    found = sampled_texts(docs, chosen, id_col, text_col, sample_bytes)
    return fit_texts([r[2] for r in found], [int(r[1] > 0) for r in found])


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    fitted = model.value
    features = Features(fitted.active)
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            margins = np.array([fitted.weights[features.present(text_of(x.as_py()))].sum() for x in batch.column(1).cast(pa.binary())])
            above = fitted.above(margins)
            columns = [batch.column(0), pa.array(above.sum(1)), pa.array((above >= 0.5).sum(1).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "severity", "grade"])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, severity, grade): expected grade, and the highest grade at least as likely as not.

    One row per row of docs, whatever ids are null or repeat and whatever other
    columns there are; null and empty texts have the features of no words, long
    ones are read whole, in parts. A probability of exactly one half counts as
    reached. An empty table gives an empty one.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES weights
    return rows.mapInArrow(partial(_score, model=shared), f"id {dict(rows.dtypes)['id']}, severity double, grade int")
