"""Quality classifier: a sparse rule ensemble over text statistics.

The statistics are column expressions. Small boosted trees are grown on a
bounded labelled sample; the paths to their nodes become conjunctive rules;
a lasso logistic regression keeps few of them; these are compiled back into
column expressions, so that scoring is a projection without any Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample

SAMPLE_ROWS = 8000
TREES = 24
DEPTH = 3
RATE = 0.3
PENALTY = 0.002
THRESHOLD = 0.7

#: Statistics of a text t with words w and lines l.
STATS = {
    "chars": "cast(length(t) as double)",
    "words": "cast(size(w) as double)",
    "word_length": "length(t) / greatest(1, size(w))",
    "distinct_words": "size(array_distinct(w)) / greatest(1, size(w))",
    "distinct_lines": "size(array_distinct(l)) / greatest(1, size(l))",
    "line_words": "size(w) / greatest(1, size(l))",
    "capitals": r"regexp_count(t, r'\p{Lu}') / greatest(1, length(t))",
    "symbols": r"regexp_count(t, r'[^\p{L}\p{N}\s.,;:!?()-]') / greatest(1, size(w))",
    "loud": "regexp_count(t, '[!?]') / greatest(1, size(w))",
    "stops": "regexp_count(t, '[.,;:]') / greatest(1, size(w))",
    "digits": "regexp_count(t, '[0-9]') / greatest(1, length(t))",
}


def with_statistics(docs: DataFrame, text_col: str, into: str) -> DataFrame:
    """docs with a struct of the statistics; null is empty.

    The struct comes out of a generator of one row, below which no filter on
    it is moved: else every rule of a filter would compute its statistics anew.
    """
    name = "_quality_parts"
    while name in docs.columns:
        name += "_"
    t = F.coalesce(F.col(text_col), F.lit(""))
    parts = docs.withColumns({f"{name}t": t, f"{name}w": F.array_remove(F.split(t, r"\s+"), ""), f"{name}l": F.split(t, "\n")})
    own = {"t": f"{name}t", "w": f"{name}w", "l": f"{name}l"}

    def renamed(sql: str) -> Column:
        for short, long in own.items():
            sql = sql.replace(f"({short})", f"({long})").replace(f"({short},", f"({long},")
        return F.expr(sql)

    stats = F.struct(*[renamed(sql).alias(k) for k, sql in STATS.items()])
    return parts.select(*[f"`{c}`" for c in docs.columns], F.explode(F.array(stats)).alias(into))


@dataclass(frozen=True)
class Rule:
    """All conditions (statistic, is it at most, bound) hold."""

    conditions: tuple[tuple[str, bool, float], ...]

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = None
        for name, at_most, bound in self.conditions:
            now = (x[name] <= bound) == at_most
            out = now if out is None else out & now
        return out

    def column(self, stats: Column) -> Column:
        out = F.lit(True)
        for name, at_most, bound in self.conditions:
            out = out & ((stats[name] <= bound) if at_most else (stats[name] > bound))
        return out


@dataclass(frozen=True)
class Model:
    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self, stats: Column) -> Column:
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(stats), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _grow(x: np.ndarray, bounds: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray, rows: np.ndarray, path: tuple, paths: list, values: np.ndarray) -> None:
    """One regression tree by second-order gain; notes every node's path, adds its leaves to values."""
    g, h = gradient[rows].sum(), hessian[rows].sum()
    if path:
        paths.append(path)
    best = (1e-3, None, None, None)
    if len(path) < DEPTH and len(rows) >= 20:
        for j, cuts in enumerate(bounds):
            if not len(cuts):
                continue
            slot = np.searchsorted(cuts, x[rows, j], "left")
            gs, hs, ns = (np.cumsum(np.bincount(slot, v, len(cuts) + 1))[:-1] for v in (gradient[rows], hessian[rows], np.ones(len(rows))))
            gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
            gain[(ns < 5) | (len(rows) - ns < 5)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], j, cuts[k], x[rows, j] <= cuts[k])
    if best[1] is None:
        values[rows] += -RATE * g / (h + 1)
        return
    _, j, cut, left = best
    for side, own in ((True, left), (False, ~left)):
        _grow(x, bounds, gradient, hessian, rows[own], (*path, (j, side, float(cut))), paths, values)


def fit_rows(stats: dict[str, np.ndarray], label: np.ndarray, trees: int = TREES, penalty: float = PENALTY) -> Model:
    """Fit on arrays. Without rows, or with one class only, the score is the smoothed base rate."""
    n, good = len(label), float(label.sum())
    base = float(np.log((good + 1) / (n - good + 1)))
    if not n or good in (0, n):
        return Model(base, ())
    names = list(stats)
    x = np.column_stack([stats[k] for k in names]).astype(float)
    # bounds lie midway between seen values
    bounds = []
    for j in range(x.shape[1]):
        seen = np.unique(x[:, j])
        middle = (seen[1:] + seen[:-1]) / 2
        bounds.append(middle if len(middle) <= 64 else np.unique(middle[np.linspace(0, len(middle) - 1, 64).astype(int)]))
        if len(middle) > 64:  # and between the quantiles
            q = np.quantile(x[:, j], np.linspace(0.005, 0.995, 64))
            bounds[-1] = np.unique(np.concatenate((bounds[-1], q)))
    margin, paths = np.full(n, base), []
    for _ in range(trees):
        p = _sigmoid(margin)
        _grow(x, bounds, p - label, p * (1 - p), np.arange(n), (), paths, margin)
    rules = list(dict.fromkeys(Rule(tuple((names[j], side, cut) for j, side, cut in path)) for path in paths))
    columns = [r.holds(stats).astype(float) for r in rules]
    keep, kept_columns, seen_columns = [], [], set()
    for r, c in zip(rules, columns, strict=True):
        if (key := c.tobytes()) not in seen_columns and 0 < c.sum() < n:
            seen_columns.add(key)
            keep.append(r)
            kept_columns.append(c)
    if not keep:
        return Model(base, ())
    r = np.column_stack(kept_columns)
    weight, bias = np.zeros(r.shape[1]), base
    step = 4 * n / (np.linalg.norm(r, 2) ** 2 + n)
    ahead, ahead_bias, t = weight.copy(), bias, 1.0
    for _ in range(1500):  # accelerated proximal gradient
        error = _sigmoid(ahead_bias + r @ ahead) - label
        new = ahead - step * (r.T @ error) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_bias = ahead_bias - step * error.mean()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_bias = new + (t - 1) / t_new * (new - weight), new_bias + (t - 1) / t_new * (new_bias - bias)
        weight, bias, t = new, new_bias, t_new
    chosen = np.flatnonzero(np.abs(weight) > 1e-4)
    return Model(float(bias), tuple((keep[i], float(weight[i])) for i in chosen))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most sample_rows labelled documents outside the held-out fold; only numbers reach the driver.

    Repeated labels of a document count as their maximum, and of rows that share
    an id the smallest text; null labels and ids don't count, null texts are
    empty. Without rows, or with one class only, the score is the base rate.
    """
    chosen = labelled_sample(labels, id_col, label_col, sample_rows)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(F.broadcast(chosen), F.col("_id") == F.col("_sample_id"))
    one = rows.groupBy("_id").agg(F.min("_text").alias("_text"), F.max("_label").alias("_label"))
    found = with_statistics(one, "_text", "_stats").select("_id", "_label", "_stats.*").toPandas().sort_values("_id")
    return fit_rows({k: found[k].to_numpy(float) for k in STATS}, found["_label"].to_numpy(float))


def with_score(docs: DataFrame, model: Model, text_col: str = "text", into: str = "score") -> DataFrame:
    """docs with a score from 0 to 1, higher: label 1 likelier.

    Null texts score as empty ones; every row is kept, repeated ones and those
    without id too, and every other column but one named ``into``, which the
    score replaces. A statistic equal to a rule's bound counts as at most it.
    An empty table gives an empty one.
    """
    name = "_quality_stats"
    while name in docs.columns:
        name += "_"
    return with_statistics(docs, text_col, name).withColumn(into, model.score(F.col(name))).drop(name)
