"""Quality classifier: naive Bayes support vectors over byte n-grams.

Features are indicators of hashed byte n-grams of the whole text. Each is scaled by its log-count ratio between the
classes, the vector is brought to length one, and a linear hinge-loss model is fitted by dual coordinate descent. A
logistic curve, fitted on labelled rows left out of that, turns margins into scores between 0 and 1.

Null and empty texts have no features; their score comes from the intercept alone. Very long texts are hashed whole, part by
part. Repeated rows and ties get equal scores. With no usable labels, or labels of one class only, every score is the share
of label 1 (0.5 without labels). Of several labels or texts of one id the smallest is learned from. Other columns of
documents and labels, whatever their names, are not looked at. An empty table has an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.llm.common import col, field, labelled_sample, text_map

#: Lengths of the byte n-grams and the bits of their hashes.
GRAMS, BITS = (2, 3, 4), 18
#: Bytes hashed at a time; grams never span less than a whole text, the parts overlap.
PART = 1 << 20


def features(text: str | None) -> np.ndarray:
    """Sorted distinct hashed n-grams of the whole text."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    flags = np.zeros(1 << BITS, bool) if len(raw) > 20_000 else None
    found = []
    for at in range(0, max(1, len(raw)), PART):
        part = raw[at : at + PART + max(GRAMS) - 1].astype(np.uint32)
        for n in GRAMS:
            m = len(part) - n + 1
            if m <= 0:
                continue
            key = np.full(m, n, np.uint32)
            for j in range(n):
                key = key * np.uint32(0x01000193) + part[j : j + m]
            key = (key * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
            if flags is None:
                found.append(key)
            else:
                flags[key] = True
    if flags is not None:
        return np.flatnonzero(flags).astype(np.int32)
    return np.unique(np.concatenate(found)).astype(np.int32) if found else np.zeros(0, np.int32)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # log-count ratio times weight, for each hashed n-gram
    bias: float
    slope: float
    shift: float
    ratio: np.ndarray

    def margin(self, f: np.ndarray) -> float:
        length = np.sqrt(np.square(self.ratio[f], dtype=np.float64).sum())
        return float(self.weights[f].sum(dtype=np.float64) / length if length > 0 else 0.0) + self.bias

    def score(self, f: np.ndarray) -> float:
        z = np.clip(self.slope * self.margin(f) + self.shift, -30, 30)
        return float(1 / (1 + np.exp(-z)))


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    counts = [np.full(1 << BITS, alpha), np.full(1 << BITS, alpha)]
    for f, label in zip(rows, y, strict=True):
        counts[int(label > 0)][f] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_coordinate_descent(rows: list[np.ndarray], ratio: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int = 20, seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights of the L2-regularised hinge loss over rows ratio[f] of length one, and the intercept; y holds -1 and 1.

    The weights come multiplied with ``ratio``, as only these products are used: the margin of a row is their sum over its
    features divided by its length, so that no row's values are stored.
    """
    rng = np.random.default_rng(seed)
    square = np.square(ratio)
    length = np.array([max(np.sqrt(square[f].sum()), 1e-12) for f in rows])
    norm = np.array([1 + square[f].sum() / n**2 for f, n in zip(rows, length, strict=True)])
    u, bias, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(rows))
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            f = rows[i]
            gradient = y[i] * (u[f].sum() / length[i] + bias) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            if (step := (new - alpha[i]) * y[i]) != 0.0:
                u[f] += step / length[i] * square[f]
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return u, bias


def logistic_curve(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton steps on smoothed targets (Platt)."""
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margins, np.ones_like(margins)], axis=1)
    beta = np.array([1.0, np.log((n1 + 1) / (n0 + 1))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (target - p))
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(beta[0], 0.0)), float(beta[1])


def train(rows: list[np.ndarray], y: np.ndarray, cost: float = 1.0, seed: int = 3) -> Model:
    """Three quarters of the rows fit the weights, the rest the logistic curve."""
    size = 1 << BITS
    share = float((y > 0).mean()) if len(y) else 0.5
    flat = Model(np.zeros(size), 0.0, 0.0, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))), np.zeros(size))
    if len(y) < 8 or share in (0.0, 1.0):
        return flat
    held = np.arange(len(y)) % 4 == 3
    if len(set(y[~held] > 0)) < 2 or len(set(y[held] > 0)) < 2:
        held = np.zeros(len(y), bool)
    part = [r for r, h in zip(rows, held, strict=True) if not h]
    sign = np.where(y > 0, 1.0, -1.0)
    ratio = log_count_ratio(part, y[~held])
    own = sign[~held]
    balance = np.where(own > 0, len(own) / (2 * max(1, (own > 0).sum())), len(own) / (2 * max(1, (own < 0).sum())))
    weights, bias = dual_coordinate_descent(part, ratio, own, cost * balance, seed=seed)
    raw = Model(weights, bias, 1.0, 0.0, ratio)
    seen = held if held.any() else ~held
    slope, shift = logistic_curve(np.array([raw.margin(r) for r, h in zip(rows, seen, strict=True) if h]), y[seen])
    return Model(raw.weights.astype(np.float32), raw.bias, slope, shift, ratio.astype(np.float32))


def is_held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds, is 0; an id that is null is not held out."""
    return F.coalesce(F.crc32(col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = 6000, seed: int = 5) -> Model:
    """Learns from at most ``sample`` labelled documents (a bound on what the driver gets), none of them held out."""
    rows = labelled_sample(docs, labels.where(~is_held_out()), label_col, sample, seed)
    got = text_map(rows, "text", ["id", "y"], [field("f", "array<int>")], lambda texts: [[features(t) for t in texts]]).toArrow()
    order = np.argsort(got["id"].to_numpy(), kind="stable")
    found: list[np.ndarray] = []  # views of the table's own memory
    for chunk in got["f"].chunks:
        values, ends = chunk.values.to_numpy(), chunk.offsets.to_numpy()
        found += [values[ends[i] : ends[i + 1]] for i in range(len(chunk))]
    model = train([found[i] for i in order], got["y"].to_numpy()[order], seed=seed)
    del found, got
    pa.default_memory_pool().release_unused()
    return model


def scored(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and score, from the text alone."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    return text_map(docs, text_col, list(keep), [field("score", "double")], lambda texts: [[shipped.value.score(features(t)) for t in texts]])


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score and predicted for each row."""
    out = scored(docs, fit(docs, labels, **options))
    return out.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
