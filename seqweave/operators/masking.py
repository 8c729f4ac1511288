"""Masking of repeats and low complexity, in Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqweave.functions import scores


def tandem_probability(seq: np.ndarray, period: int = 15, repeat: float = 0.005, end: float = 0.05, decay: float = 0.9, m: np.ndarray | None = None) -> np.ndarray:
    """Posterior probability of each letter to lie in a tandem repeat, by forward and backward passes over a hidden Markov
    model with a background state and one state per repeat offset (Frith, 2011)."""
    n = len(seq)
    if not n:
        return np.zeros(0)
    ratio = np.exp(scores.LAMBDA_UNGAPPED * (scores.blosum62() if m is None else m))
    weight = decay ** np.arange(period)
    weight = repeat * weight / weight.sum()
    emit = np.ones((n, period))
    for k in range(1, period + 1):
        if k < n:
            emit[k:, k - 1] = ratio[seq[k:], seq[:-k]]
            emit[:k, k - 1] = 0
        else:
            emit[:, k - 1] = 0
    fb, fr, scale = np.zeros(n), np.zeros((n, period)), np.zeros(n)
    b, r = 1.0, np.zeros(period)
    for i in range(n):
        b, r = b * (1 - repeat) + r.sum() * end, (b * weight + r * (1 - end)) * emit[i]
        scale[i] = b + r.sum()
        b, r = b / scale[i], r / scale[i]
        fb[i], fr[i] = b, r
    out = np.zeros(n)
    bb, br = 1.0, np.ones(period)
    for i in range(n - 1, -1, -1):
        total = fb[i] * bb + (fr[i] * br).sum()
        out[i] = (fr[i] * br).sum() / total if total > 0 else 0.0
        e = emit[i] * br
        bb, br = (bb * (1 - repeat) + (weight * e).sum()) / scale[i], (bb * end + e * (1 - end)) / scale[i]
    return out


def low_entropy(seq: np.ndarray, window: int = 10, low: float = 1.8, high: float = 2.1) -> np.ndarray:
    """Letters in windows of entropy at most `low` bits, extended while windows stay at most `high` (Wootton and Federhen)."""
    n = len(seq)
    mask = np.zeros(n, dtype=bool)
    if n < window:
        return mask
    one = np.zeros((n + 1, 26), dtype=np.int32)
    one[np.arange(1, n + 1), seq] = 1
    c = one.cumsum(axis=0)
    p = (c[window:] - c[:-window]) / window
    with np.errstate(divide="ignore", invalid="ignore"):
        h = -np.where(p > 0, p * np.log2(p), 0).sum(axis=1)
    seed, wide = h <= low, h <= high
    run = np.flatnonzero(np.diff(np.concatenate(([0], wide.astype(np.int8), [0]))))
    for a, b in zip(run[::2], run[1::2], strict=True):
        if seed[a:b].any():
            mask[a : b + window - 1] = True
    return mask


def mask(seqs: DataFrame, algorithm: str = "tantan", least: float = 0.9, motifs: list[str] | None = None) -> DataFrame:
    """seqs with `seq` hard-masked by X: algorithm tantan, seg, or motif (8-mers of a list the caller supplies)."""
    names = seqs.columns
    at = names.index("seq")
    table = set(motifs or [])

    def masked(batches):
        for batch in batches:
            out = []
            for s in batch.column("seq").to_pylist():
                if not s:
                    out.append(s)
                    continue
                code = scores.encode(s)
                if algorithm == "tantan":
                    hide = tandem_probability(code) >= least
                elif algorithm == "seg":
                    hide = low_entropy(code)
                else:
                    hide = np.zeros(len(s), dtype=bool)
                    for i in range(len(s) - 7):
                        if s[i : i + 8] in table:
                            hide[i : i + 8] = True
                letters = np.frombuffer(s.encode(), dtype=np.uint8).copy()
                letters[hide] = ord("X")
                out.append(letters.tobytes().decode())
            columns = [batch.column(c) for c in names]
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return seqs.mapInArrow(masked, seqs.schema)


def soft_mask(seqs: DataFrame, **options) -> DataFrame:
    """seqs with `masked_seq` for seeding; `seq` keeps its letters for alignment."""
    return mask(seqs.withColumn("_keep", F.col("seq")), **options).withColumnRenamed("seq", "masked_seq").withColumnRenamed("_keep", "seq")


def composition(seqs: DataFrame) -> DataFrame:
    """(oid, residue, n, frequency) over the 20 true residues."""
    counts = F.map_from_arrays(F.array(*[F.lit(r) for r in scores.RESIDUES]), F.array(*[F.length("seq") - F.length(F.replace("seq", F.lit(r), F.lit(""))) for r in scores.RESIDUES]))
    out = seqs.select("oid", F.explode(counts).alias("residue", "n")).where("n > 0")
    total = F.length(F.regexp_replace("seq", f"[^{scores.RESIDUES}]", ""))
    return out.join(seqs.select("oid", total.alias("_t")), "oid").select("oid", "residue", "n", (F.col("n") / F.col("_t")).alias("frequency"))


def expected_entropy() -> float:
    p = scores.background()
    return float(-(p * np.log(p)).sum() / math.log(2))
