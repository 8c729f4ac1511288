"""Substitution scores and alignment statistics."""

from __future__ import annotations

import math
from functools import cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

RESIDUES = "ARNDCQEGHILKMFPSTWYV"
LETTERS = "ARNDCQEGHILKMFPSTWYVBJZX*_"

# BLOSUM62, lower triangle, residues in the order of RESIDUES.
BLOSUM62 = """
4
-1 5
-2 0 6
-2 -2 1 6
0 -3 -3 -3 9
-1 1 0 0 -3 5
-1 0 0 2 -4 2 5
0 -2 0 -1 -3 -2 -2 6
-2 0 1 -1 -3 0 0 -2 8
-1 -3 -3 -3 -1 -3 -3 -4 -3 4
-1 -2 -3 -4 -1 -2 -3 -4 -3 2 4
-1 2 0 -1 -3 1 1 -2 -1 -3 -2 5
-1 -1 -2 -3 -1 0 -2 -3 -2 1 2 -1 5
-2 -3 -3 -3 -2 -3 -3 -3 -1 0 0 -3 0 6
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4 7
1 -1 1 0 -1 0 0 0 -1 -2 -2 0 -1 -2 -1 4
0 -1 0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1 1 5
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1 1 -4 -3 -2 11
-2 -2 -2 -3 -2 -1 -2 -3 2 -1 -1 -2 -1 3 -3 -2 -2 2 7
0 -3 -3 -3 -1 -2 -2 -3 -3 3 1 -2 1 -1 -2 -2 0 -3 -1 4
"""

# BLOSUM62 statistics by (gap open, gap extend): lambda, K, alpha, alpha_v, sigma; None is ungapped.
BLOSUM62_STATISTICS = {
    None: (0.3176, 0.134, 0.7916, 4.964660, 4.964660),
    (11, 2): (0.297, 0.082, 1.1, 12.673800, 12.757600),
    (10, 2): (0.291, 0.075, 1.3, 16.474000, 16.602600),
    (9, 2): (0.279, 0.058, 1.5, 22.751900, 22.950000),
    (8, 2): (0.264, 0.045, 1.8, 35.483800, 35.821300),
    (7, 2): (0.239, 0.027, 2.5, 61.238300, 61.886000),
    (6, 2): (0.201, 0.012, 3.3, 140.417000, 141.882000),
    (13, 1): (0.292, 0.071, 1.2, 19.506300, 19.893100),
    (12, 1): (0.283, 0.059, 1.5, 27.856200, 28.469900),
    (11, 1): (0.267, 0.041, 1.9, 42.602800, 43.636200),
    (10, 1): (0.243, 0.024, 2.5, 83.178700, 85.065600),
    (9, 1): (0.206, 0.010, 4.0, 210.333000, 214.842000),
}

#: Residue frequencies behind BLOSUM62 scores, solved from the matrix where no table is given.
LAMBDA_UNGAPPED = BLOSUM62_STATISTICS[None][0]


def parse_matrix(text: str) -> np.ndarray:
    """26 x 26 scores from a matrix file: a line of letters, then a line per letter."""
    rows = [x.split() for x in text.splitlines() if x.strip() and not x.startswith("#")]
    heads, m = rows[0], full_matrix(np.full((20, 20), -1))
    for row in rows[1:]:
        for c, v in zip(heads, row[1:], strict=False):
            if row[0] in LETTERS and c in LETTERS:
                m[LETTERS.index(row[0]), LETTERS.index(c)] = int(v)
    return m


def full_matrix(core: np.ndarray) -> np.ndarray:
    """26 x 26 scores from 20 x 20: ambiguous letters score the mean of what they stand for, X -1, stops -4."""
    m = np.full((26, 26), -1, dtype=np.int32)
    m[:20, :20] = core
    for letter, (a, b) in {20: (2, 3), 21: (9, 10), 22: (5, 6)}.items():
        mean = np.floor((core[a] + core[b]) / 2 + 0.5).astype(np.int32)
        m[letter, :20], m[:20, letter] = mean, mean
        m[letter, letter] = int((core[a, a] + core[b, b] + 2 * core[a, b]) / 4 + 0.5)
    m[24, :], m[:, 24], m[24, 24] = -4, -4, 1
    m[25, :], m[:, 25] = -100, -100
    return m


@cache
def blosum62() -> np.ndarray:
    core = np.zeros((20, 20), dtype=np.int32)
    for i, line in enumerate(BLOSUM62.split("\n")[1:21]):
        core[i, : i + 1] = core[: i + 1, i] = [int(x) for x in line.split()]
    return full_matrix(core)


CODE = np.full(256, 23, dtype=np.int8)
for _i, _c in enumerate(LETTERS):
    CODE[ord(_c)] = _i
    CODE[ord(_c.lower())] = _i
CODE[ord("_")] = 25


def encode(seq: str) -> np.ndarray:
    return CODE[np.frombuffer(seq.encode(), dtype=np.uint8)]


@cache
def statistics(gap_open: int = 11, gap_extend: int = 1) -> dict:
    """Parameters of the finite-size e-value: lambda, K, and slopes and offsets of the lengths' mean and variance."""
    lam, k, alpha, alpha_v, sigma = BLOSUM62_STATISTICS[(gap_open, gap_extend)]
    _, _, u_alpha, u_alpha_v, _ = BLOSUM62_STATISTICS[None]
    g = gap_open + gap_extend
    return {"lambda": lam, "K": k, "a": alpha, "b": 2 * g * (u_alpha - alpha), "v": alpha_v, "vb": 2 * g * (u_alpha_v - alpha_v), "s": sigma, "sb": 2 * g * (u_alpha_v - sigma)}


def area(score: np.ndarray, query_len: np.ndarray, target_len: np.ndarray, gap_open: int = 11, gap_extend: int = 1) -> np.ndarray:
    """Finite-size corrected search area: expected product of the lengths left after an alignment's own extent."""
    p = statistics(gap_open, gap_extend)
    score, query_len, target_len = (np.asarray(x, dtype=np.float64) for x in (score, query_len, target_len))
    variance = np.maximum(2 * p["v"] / p["lambda"], p["v"] * score + p["vb"])
    covariance = np.maximum(2 * p["s"] / p["lambda"], p["s"] * score + p["sb"])
    erfc = np.vectorize(math.erfc, otypes=[np.float64])

    def left(m):
        rest = m - (p["a"] * score + p["b"])
        f = rest / np.sqrt(variance)
        phi = 0.5 * erfc(-f / math.sqrt(2))
        return rest * phi + np.sqrt(variance) * np.exp(-f * f / 2) / math.sqrt(2 * math.pi), phi

    pq, fq = left(query_len)
    pt, ft = left(target_len)
    return np.maximum(pq * pt + covariance * fq * ft, 0.0)


def evalue(score, query_len, target_len, db_letters, gap_open: int = 11, gap_extend: int = 1) -> np.ndarray:
    p = statistics(gap_open, gap_extend)
    return area(score, query_len, target_len, gap_open, gap_extend) * p["K"] * np.exp(-p["lambda"] * np.asarray(score, dtype=np.float64)) * np.asarray(db_letters, dtype=np.float64) / np.asarray(target_len, dtype=np.float64)


def bitscore_corrected(score, query_len, target_len, gap_open: int = 11, gap_extend: int = 1) -> np.ndarray:
    p = statistics(gap_open, gap_extend)
    return (p["lambda"] * np.asarray(score) - math.log(p["K"]) - np.log(np.maximum(area(score, query_len, target_len, gap_open, gap_extend), 1e-300))) / math.log(2)


def bitscore(score: Column, gap_open: int = 11, gap_extend: int = 1) -> Column:
    p = statistics(gap_open, gap_extend)
    return (F.lit(p["lambda"]) * score - F.lit(math.log(p["K"]))) / F.lit(math.log(2))


def raw_score(bits: Column, gap_open: int = 11, gap_extend: int = 1) -> Column:
    p = statistics(gap_open, gap_extend)
    return F.ceil((bits * math.log(2) + math.log(p["K"])) / p["lambda"])


def evalue_simple(bits: Column, query_len: Column) -> Column:
    """Against a data base of 1e9 letters, without length correction."""
    return F.lit(1e9) * query_len * F.pow(F.lit(2.0), -bits)


def approx_identity(score: Column, query_range: Column, target_range: Column) -> Column:
    estimate = F.lit(16.56) * score / F.greatest(query_range, target_range) + F.lit(11.41)
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), estimate))


def coverage(begin: Column, end: Column, length: Column) -> Column:
    return (end - begin) * 100.0 / length


def band_width(length: Column, slow: bool = False) -> Column:
    # Band by query length.
    steps = [(50, 15), (100, 20), (150, 30), (200, 50), (250, 60), (350, 100), (500, 120)] if slow else [(50, 12), (100, 16), (250, 30), (350, 40)]
    c = F.lit(150 if slow else 64)
    for below, width in reversed(steps):
        c = F.when(length < below, F.lit(width)).otherwise(c)
    return c


@cache
def background() -> np.ndarray:
    """Residue frequencies implied by the matrix: the p with sum_j p_j exp(lambda s_ij) = 1 for every i, normalised."""
    m = np.exp(LAMBDA_UNGAPPED * blosum62()[:20, :20].astype(np.float64))
    p = np.clip(np.linalg.solve(m, np.ones(20)), 1e-4, None)
    return p / p.sum()


def composition_bias(seq: np.ndarray, window: int = 40) -> np.ndarray:
    """Per-position correction: background score of a residue less its mean score in the window around it, rounded."""
    n = len(seq)
    if n < 2:
        return np.zeros(n, dtype=np.int32)
    m = blosum62()
    base = m[:20, :20] @ background()
    known = np.minimum(seq, 23)
    one = np.zeros((n, 26), dtype=np.int32)
    one[np.arange(n), known] = 1
    total = np.concatenate((np.zeros((1, 26), dtype=np.int32), one.cumsum(axis=0)))
    half = min(window // 2, n - 1)
    lo, hi = np.maximum(np.arange(n) - half, 0), np.minimum(np.arange(n) + half + 1, n)
    around = total[hi] - total[lo] - one
    count = np.maximum(hi - lo - 1, 1)
    mean = (around * m[known]).sum(axis=1) / count
    bias = np.where(seq < 20, base[np.minimum(known, 19)] - mean, 0.0)
    return np.trunc(bias + np.where(bias < 0, -0.5, 0.5)).astype(np.int32)
