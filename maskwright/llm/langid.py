"""Language identification with string kernels.

A text is the set of its letter n-grams of lengths 1 to 3 (the blended
spectrum, presence only); the kernel of two texts is the number of n-grams
they share over the geometric mean of their sizes. Letters of every script
count, each by itself; what isn't a letter counts as one blank. Nystroem
landmarks from every language map texts to finitely many features,
one-versus-rest kernel ridge regression weighs them, and documents are scored
in batches by matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import grouped
from .common import HELD_OUT, SAMPLE_BYTES, bounded_sample, fold, sampled_texts

SAMPLE_ROWS = 3000
LANDMARKS = 128
LANDMARK_LETTERS = 8192  # a longer text is a landmark only where its language has no other
RIDGE = 1e-2
SHARPNESS = 4.0
UNKNOWN = "und"
_BATCH = 256
_CELLS = 8_000_000  # of the batch's matrix of presence
_PART = 1 << 20  # letters of a text handled at once
_NONE = 0x1FFFFF  # stands for no letter where a gram has fewer than three; beyond Unicode


@lru_cache
def _is_letter() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)


def grams_of(points: np.ndarray) -> np.ndarray:
    """The distinct 1- to 3-grams of a text as sorted keys of 21 bits a letter; a blank is 0, the first letter highest."""
    out = np.zeros(0, np.int64)
    for at in range(0, len(points), _PART):
        n = points[max(0, at - 2) : at + _PART]
        n = np.where(_is_letter()[n], n, 0).astype(np.int64)
        two = (n[:-1] << 21) | n[1:]
        three = (two[:-1] << 21) | n[2:]
        part = np.concatenate((n | _NONE << 42 | _NONE << 21, two | _NONE << 42, three))
        out = np.unique(np.concatenate((out, part)) if len(out) else part)
    return out


@dataclass
class Model:
    languages: list[str]
    grams: np.ndarray  # the n-grams of the landmarks, sorted
    landmarks: np.ndarray  # (grams, landmarks), presence over the root of the landmark's size
    weights: np.ndarray  # (landmarks, languages): Nystroem map and ridge weights in one

    def kernels(self, texts: list[np.ndarray]) -> np.ndarray:
        """(texts, landmarks) kernel values, by one matrix product."""
        out = np.zeros((len(texts), self.landmarks.shape[1]), np.float32)
        rows = max(1, min(_BATCH, _CELLS // max(1, len(self.grams))))
        for first in range(0, len(texts), rows):
            batch = texts[first : first + rows]
            x = np.zeros((len(batch), len(self.grams)), np.float32)
            for i, points in enumerate(batch):
                own = grams_of(points)
                at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
                x[i, at[self.grams[at] == own]] = 1 / np.sqrt(max(1, len(own)))
            out[first : first + rows] = x @ self.landmarks
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Languages and scores from 0 to 1; a text without a letter is UNKNOWN with score 0."""
        points = [code_points(t) for t in texts]
        lettered = np.array([bool(_is_letter()[p].any()) for p in points], bool)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        margins = SHARPNESS * (self.kernels(points).astype(float) @ self.weights)
        best = margins.argmax(axis=1) if len(texts) else np.zeros(0, int)
        share = np.exp(margins - margins.max(axis=1, keepdims=True)) if len(texts) else np.zeros((0, 1))
        score = np.where(lettered, 1 / share.sum(axis=1), 0.0)
        return [self.languages[b] if has else UNKNOWN for b, has in zip(best, lettered, strict=True)], score


def fit_texts(texts: list[str], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """The landmarks of a language are its first texts, so texts come in an order that says nothing about them.

    Of at most LANDMARK_LETTERS letters if it has such, else the shortest.
    """
    points = [code_points(t) for t in texts]
    usable = [i for i, p in enumerate(points) if _is_letter()[p].any()]
    points, langs = [points[i] for i in usable], [langs[i] for i in usable]
    languages = sorted(set(langs))
    if not languages:
        return Model([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32), np.zeros((0, 0)))
    of_lang = {k: [i for i, x in enumerate(langs) if x == k] for k in languages}
    share = max(1, landmarks // len(languages))
    usual = {k: [i for i in of_lang[k] if len(points[i]) <= LANDMARK_LETTERS] or [min(of_lang[k], key=lambda i: len(points[i]))] for k in languages}
    chosen = [i for k in languages for i in usual[k][:share]]
    rows = [grams_of(points[i]) for i in chosen]
    grams = np.unique(np.concatenate(rows))
    marks = np.zeros((len(grams), len(chosen)), np.float32)
    for j, own in enumerate(rows):
        marks[np.searchsorted(grams, own), j] = 1 / np.sqrt(len(own))
    model = Model(languages, grams, marks, np.zeros((len(chosen), len(languages))))
    values, vectors = np.linalg.eigh((marks.T @ marks).astype(float))
    good = values > 1e-6 * values.max()
    to_features = vectors[:, good] / np.sqrt(values[good])
    kernels = np.concatenate([model.kernels(points[i : i + _BATCH]) for i in range(0, len(points), _BATCH)])
    phi = kernels.astype(float) @ to_features
    target = np.where(np.array(langs)[:, None] == np.array(languages), 1.0, -1.0)
    # every language weighs the same, however many rows it has
    row_weight = np.array([len(langs) / (len(languages) * len(of_lang[x])) for x in langs])[:, None]
    gram = phi.T @ (row_weight * phi) + ridge * len(langs) * np.eye(phi.shape[1]) / len(chosen)
    model.weights = to_features @ np.linalg.solve(gram, phi.T @ (row_weight * target))
    return model


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on at most sample_rows documents of known language and sample_bytes of text outside the held-out fold.

    They come in the order of their ids' hashes, which also picks the landmarks.
    Of rows that share an id the smallest text and the largest language count.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    known = rows.where(F.col("_lang").isNotNull() & F.col("_id").isNotNull() & (fold("_id") != HELD_OUT))
    ids = bounded_sample(known, "_id", sample_rows)
    chosen = known.select("_id", "_lang").join(F.broadcast(ids), F.col("_id") == F.col("_sample_id")).groupBy("_sample_id").agg(F.max("_lang").alias("_label"))
    found = sampled_texts(known, chosen, "_id", "_text", sample_bytes)
    return fit_texts([r[2] for r in found], [r[1] for r in found])


def _predict(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, scores = [], [np.zeros(0)]
        for group in grouped(batch.column(1).cast(pa.binary()), rows=_BATCH):
            found, score = model.value.predict(group)
            langs += found
            scores.append(score)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(np.concatenate(scores))], ["id", "lang_pred", "score"])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score): one row per row of docs; null, empty and letterless texts are ``und`` with score 0.

    Of languages with equal margins the first in alphabetical order is
    predicted. Texts are read whole, long ones in parts; ids may be null or
    repeat, and other columns don't matter. An empty table gives an empty one.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by the landmarks' n-grams, and so by SAMPLE_BYTES
    return rows.mapInArrow(partial(_predict, model=shared), f"id {dict(rows.dtypes)['id']}, lang_pred string, score double")
