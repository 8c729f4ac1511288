"""Composition adjustment of substitution scores."""

from __future__ import annotations

from functools import cache

import numpy as np

from seqweave.functions import scores


@cache
def joint() -> np.ndarray:
    """Pair frequencies behind the matrix: p_i p_j exp(lambda s_ij), normalised."""
    p = scores.background()
    q = np.outer(p, p) * np.exp(scores.LAMBDA_UNGAPPED * scores.blosum62()[:20, :20])
    return q / q.sum()


def composition(seq: np.ndarray, pseudo: float = 20.0) -> np.ndarray:
    """Residue frequencies of a sequence with `pseudo` letters of background."""
    n = np.bincount(seq[seq < 20], minlength=20)[:20]
    return (n + pseudo * scores.background()) / (n.sum() + pseudo)


def adjusted_pairs(row: np.ndarray, column: np.ndarray, rounds: int = 200, tolerance: float = 1e-9) -> np.ndarray:
    """Pair frequencies closest to the matrix's in relative entropy with the given margins, by proportional fitting."""
    q = joint().copy()
    for _ in range(rounds):
        q *= (row / q.sum(axis=1))[:, None]
        q *= (column / q.sum(axis=0))[None, :]
        if np.abs(q.sum(axis=1) - row).max() < tolerance:
            break
    return q


def adjusted_matrix(query: np.ndarray, target: np.ndarray) -> np.ndarray:
    """26 x 26 integer scores for the compositions of a query and a target."""
    row, column = composition(query), composition(target)
    s = np.log(adjusted_pairs(row, column) / np.outer(row, column)) / scores.LAMBDA_UNGAPPED
    m = scores.blosum62().copy()
    m[:20, :20] = np.floor(s + 0.5)
    return m


def angle(a: np.ndarray, b: np.ndarray) -> float:
    """Degrees between two compositions' departures from the background."""
    x, y = a - scores.background(), b - scores.background()
    n = np.linalg.norm(x) * np.linalg.norm(y)
    return float(np.degrees(np.arccos(np.clip(x @ y / n, -1, 1)))) if n > 0 else 0.0


def conditional_matrix(query: np.ndarray, target: np.ndarray, most_ratio: float = 3.0, most_angle: float = 70.0) -> np.ndarray:
    """The adjusted matrix, unless lengths differ much and compositions point apart: then scores are only rescaled."""
    ratio = max(len(query), len(target)) / max(1, min(len(query), len(target)))
    if ratio > most_ratio and angle(composition(query), composition(target)) > most_angle:
        return rescaled_matrix(query, target)
    return adjusted_matrix(query, target)


def rescaled_matrix(query: np.ndarray, target: np.ndarray) -> np.ndarray:
    """BLOSUM62 scaled so that its lambda for the two compositions is the standard one; never scaled up."""
    p, m = np.outer(composition(query), composition(target)), scores.blosum62()
    s = m[:20, :20].astype(np.float64)
    low, high = 1e-4, 2.0
    if (p * s).sum() >= 0:
        return m
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(mid * s)).sum() < 1 else (low, mid)
    out = m.copy()
    out[:20, :20] = np.floor(s * min(1.0, low / scores.LAMBDA_UNGAPPED) + 0.5)
    return out
