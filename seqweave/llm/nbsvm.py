"""Quality classifier: Naive Bayes support vectors.

Features are indicators of hashed n-grams: bytes 1 to 4 long (white space folded) and words and word pairs. Each present
feature has the value of its class log-count ratio; a text's vector has unit length; a linear hinge-loss model is fitted
by dual coordinate descent in numpy, and Platt's sigmoid on rows left out of the fit turns margins into probabilities.

The fit takes at most `most_rows` labelled rows (those with the smallest md5 of their id), gathered as feature numbers,
never texts; of an id that repeats with different texts one, of the smallest hash, is learnt from. Scoring reads every whole text in one pass without a shuffle.

Defined results: a null or empty text has no features and scores by the bias alone; unlabelled and null-labelled rows are
not learnt from; without both classes the score is the share of label 1 (0.5 without labels); repeated rows score alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K

BITS = 16
ORDERS = (1, 2, 3, 4)


def features(array: pa.Array):
    """Sorted feature numbers of each text."""
    for i, j in K.chunks(array):
        words = K.Words(array.slice(i, j - i))
        data, at, first = words.data, words.at, words.first
        grams = [K.byte_ngrams(data, n, BITS, 77 * n) for n in ORDERS]
        top = K.U(64 - BITS)
        single = (words.hash >> top).astype(np.int64)
        pair = (K.windows_hash(words.hash, 2) >> top).astype(np.int64)
        seen = np.zeros(1 << BITS, dtype=bool)
        for d in range(j - i):
            a, b = at[d], at[d + 1]
            for n, g in zip(ORDERS, grams, strict=True):
                seen[g[a : max(a, b - n + 1)]] = True
            a, b = first[d], first[d + 1]
            seen[single[a:b]] = True
            seen[pair[a : max(a, b - 1)]] = True
            found = np.flatnonzero(seen)
            seen[found] = False
            yield found.astype(np.int32)


@dataclass
class Model:
    weight: np.ndarray  # per feature: hinge weight times log-count ratio
    square: np.ndarray  # per feature: squared log-count ratio
    bias: float
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        norm = self.square[found].sum() if len(found) else 0.0
        return float(self.weight[found].sum() / np.sqrt(norm)) + self.bias if norm > 0 else self.bias

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.shift, -35, 35))))


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    one, zero = np.full(1 << BITS, smooth), np.full(1 << BITS, smooth)
    for found, label in zip(rows, y, strict=True):
        (one if label > 0 else zero)[found] += 1
    return np.log((one / one.sum()) / (zero / zero.sum()))


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, sweeps: int = 12, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias of the L1-loss linear SVM: each step solves one dual variable in its box exactly."""
    w, bias, alpha = np.zeros(1 << BITS), 0.0, np.zeros(len(rows))
    norm = np.array([float(v @ v) + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(sweeps):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            found, v = rows[i], values[i]
            gradient = y[i] * (w[found] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            if (step := (new - alpha[i]) * y[i]) != 0.0:
                w[found] += step * v
                bias += step
                alpha[i] = new
                worst = max(worst, abs(step))
        if worst < 1e-3:
            break
    return w, bias


def platt(margins: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and shift of the sigmoid, by Newton steps on the smoothed likelihood."""
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -35, 35)))
        g, h = p - t, np.maximum(p * (1 - p), 1e-9)
        hess = np.array([[h @ margins**2 + 1e-3, h @ margins], [h @ margins, h.sum() + 1e-3]])
        step = np.linalg.solve(hess, np.array([g @ margins, g.sum()]))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-7:
            break
    return float(max(a, 1e-3)), float(b)


def fit(rows: list[np.ndarray], labels: np.ndarray, c: float = 4.0) -> Model:
    n = 1 << BITS
    y = np.where(np.asarray(labels) > 0, 1.0, -1.0)
    share = float((y > 0).mean()) if len(y) else 0.5
    if len(y) < 10 or share in (0.0, 1.0):
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(n), np.zeros(n), 0.0, 1.0, float(np.log(share / (1 - share))))
    ratio = log_count_ratio(rows, y)

    def unit(found: np.ndarray) -> np.ndarray:
        v = ratio[found]
        length = np.sqrt(v @ v)
        return v / length if length > 0 else v

    values = [unit(found) for found in rows]
    cost = np.where(y > 0, c * 0.5 / share, c * 0.5 / (1 - share))
    held = np.arange(len(y)) % 5 == 4
    learn = np.flatnonzero(~held)
    w, bias = dual_coordinate_descent([rows[i] for i in learn], [values[i] for i in learn], y[learn], cost[learn])
    margins = np.array([w[rows[i]] @ values[i] + bias for i in np.flatnonzero(held)])
    slope, shift = platt(margins, y[held])
    w, bias = dual_coordinate_descent(rows, values, y, cost)
    return Model(w * ratio, ratio**2, bias, slope, shift)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most_rows: int = 4000) -> Model:
    """labels: (doc_id, label), at most most_rows of them are used. docs: (doc_id, text)."""
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("_y"))
    chosen = chosen.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(most_rows).withColumnRenamed("doc_id", "_id")
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("_y").cast("int").alias("y"))

    def extract(batches):
        for batch in batches:
            text = K.as_strings(batch.column("text"))
            found = [f.astype(np.uint16).tobytes() for f in features(text)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(found, pa.binary())], names=["doc_id", "y", "found"])

    got = sample.mapInArrow(K.lean(extract), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, y int, found binary").toArrow().sort_by([("doc_id", "ascending"), ("found", "ascending")])
    rows = [np.frombuffer(x.as_buffer(), dtype=np.uint16) for x in got.column("found")]
    model = fit(rows, got.column("y").to_numpy())
    del got, rows
    K.give_back()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs without text, with `score`: the probability of label 1 of every whole text."""
    others = [c for c in docs.columns if c not in ("text", "score")]
    weight, square = model.weight.astype(np.float32), model.square.astype(np.float32)
    bias, slope, shift = model.bias, model.slope, model.shift

    def scored(batches):
        m = Model(weight, square, bias, slope, shift)
        for batch in batches:
            text = K.as_strings(batch.column("text"))
            s = pa.array([m.score(f) for f in features(text)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in others] + [s], names=[*others, "score"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others)
    return docs.select(*others, "text").mapInArrow(K.lean(scored), schema + ", score double")
