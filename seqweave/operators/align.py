"""Alignment kernels: ungapped windows, x-drop extension and local dynamic programming, batched over pairs in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqweave.functions import scores

HSP = "score int, qstart int, qend int, sstart int, send int, length int, nident int, mismatch int, positive int, gapopen int, gaps int, cigar string, btop string"


def window_score(q: np.ndarray, t: np.ndarray, i: int, j: int, window: int = 48, m: np.ndarray | None = None) -> int:
    """Best local score on the diagonal of (i, j), at most `window` letters away."""
    m = scores.blosum62() if m is None else m
    back, ahead = min(window, i, j), min(window, len(q) - i, len(t) - j)
    s = m[q[i - back : i + ahead], t[j - back : j + ahead]]
    total = np.concatenate(([0], s.cumsum()))
    return int((total - np.minimum.accumulate(total)).max())


def xdrop_ungapped(q: np.ndarray, t: np.ndarray, i: int, j: int, drop: int = 27, m: np.ndarray | None = None) -> tuple[int, int, int, int, int]:
    """(i, j, length, score, identities) of the ungapped extension of (i, j) both ways until it falls `drop` below its best."""
    m = scores.blosum62() if m is None else m

    def arm(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
        n = min(len(a), len(b))
        if not n:
            return 0, 0
        total = m[a[:n], b[:n]].cumsum()
        best = np.maximum.accumulate(np.maximum(total, 0))
        stop = np.flatnonzero(best - total >= drop)
        end = int(stop[0]) if len(stop) else n
        if not end or total[:end].max() <= 0:
            return 0, 0
        k = int(total[:end].argmax())
        return k + 1, int(total[k])

    right, sr = arm(q[i:], t[j:])
    left, sl = arm(q[:i][::-1], t[:j][::-1])
    a, b, n = i - left, j - left, left + right
    return a, b, n, sl + sr, int((q[a : a + n] == t[b : b + n]).sum())


def self_score(q: np.ndarray, m: np.ndarray | None = None) -> int:
    m = scores.blosum62() if m is None else m
    total = np.concatenate(([0], m[q, q].cumsum()))
    return int((total - np.minimum.accumulate(total)).max())


#: Bytes of traces that are filled at once.
TRACES = 1 << 26
#: Bits of a trace: a score above 0, reached on the diagonal, by a gap in the query; gaps in the query or the target begin here.
ABOVE, DIAGONAL, DELETED, DELETION, INSERTION = 1, 2, 4, 8, 16


def padded(codes: list[np.ndarray], width: int, fill: int = 25) -> np.ndarray:
    out = np.full((len(codes), width), fill, dtype=np.int32)
    for row, code in zip(out, codes, strict=True):
        row[: len(code)] = code
    return out


def fill_traces(queries: list, targets: list, biases: list, gap_open: int, gap_extend: int, m: np.ndarray):
    """Affine local alignment of pairs side by side, along anti-diagonals: (trace, score, i, j), trace[i + j, pair, i] in bits.

    Shorter sequences end in delimiters, which match nothing, so no best score lies there. Of equal scores the smallest j,
    then the smallest i is the end.
    """
    n, k, pairs = max(map(len, queries)), max(map(len, targets)), len(queries)
    rows, columns = padded(queries, n) * m.shape[1], padded(targets, k)[:, ::-1].copy()
    bias, flat, low = padded(biases, n, 0), m.astype(np.int32).ravel(), -(10**6)
    trace = np.zeros((n + k + 1, pairs, n + 1), dtype=np.uint8)
    best, best_i, best_j = (np.zeros(pairs, dtype=np.int64) for _ in range(3))
    h1, h2 = (np.zeros((pairs, n + 1), dtype=np.int32) for _ in range(2))
    e1, f1 = (np.full((pairs, n + 1), low, dtype=np.int32) for _ in range(2))
    every = np.arange(pairs)
    for d in range(2, n + k + 1):
        lo, hi = max(1, d - k), min(n, d - 1)
        here, left = slice(lo, hi + 1), slice(lo - 1, hi)
        h, e, f = np.zeros_like(h1), np.full_like(e1, low), np.full_like(f1, low)
        open_e, open_f = h1[:, here] - gap_open, h1[:, left] - gap_open
        e[:, here] = np.maximum(open_e, e1[:, here]) - gap_extend  # gap in the query
        f[:, here] = np.maximum(open_f, f1[:, left]) - gap_extend  # gap in the target
        diagonal = h2[:, left] + flat.take(rows[:, left] + columns[:, k - d + lo : k - d + hi + 1]) + bias[:, left]
        score = np.maximum(np.maximum(diagonal, 0), np.maximum(e[:, here], f[:, here]))
        h[:, here] = score
        bits = (score > 0) * np.uint8(ABOVE)
        for bit, where in ((DIAGONAL, score == diagonal), (DELETED, score == e[:, here]), (DELETION, open_e >= e1[:, here]), (INSERTION, open_f >= f1[:, left])):
            bits |= where * np.uint8(bit)
        trace[d, :, here] = bits
        i = hi - score[:, ::-1].argmax(axis=1)
        top = score[every, i - lo]
        better = (top > best) | ((top == best) & (d - i < best_j))  # one j has one i on a diagonal, and a smaller i comes earlier
        best, best_i, best_j = np.where(better, top, best), np.where(better, i, best_i), np.where(better, d - i, best_j)
        h2, h1, e1, f1 = h1, h, e, f
    return trace, best, best_i, best_j


def fill_scores(q: np.ndarray, targets: list, bias: np.ndarray, gap_open: int, gap_extend: int, m: np.ndarray) -> np.ndarray:
    """Best scores of fill_traces for one query and targets side by side, without traces: arrays of [query position, target]."""
    n, k, lanes = len(q), max(map(len, targets)), len(targets)
    kind = np.int16 if (n + 1) * (int(np.abs(m).max()) + int(np.abs(bias).max(initial=0))) < 30000 else np.int32
    text = np.full((k, lanes), 25, dtype=np.uint8)
    for x, t in enumerate(targets):
        text[: len(t), x] = t
    letters, of = np.unique(np.stack((q.astype(np.int64), bias.astype(np.int64))), axis=1, return_inverse=True)
    profile = np.concatenate([(m[a] + b).astype(kind).take(text) for a, b in letters.T])
    at = of.ravel() * k - np.arange(n) - 2  # row of the profile of query position i - 1 and target position d - i - 1, less d
    h, h1, h2, best, cells, opened = (np.zeros((n + 1, lanes), dtype=kind) for _ in range(6))
    e, f, f1 = (np.full((n + 1, lanes), -10000, dtype=kind) for _ in range(3))
    for d in range(2, n + k + 1):
        lo, hi = max(1, d - k), min(n, d - 1)
        here, left, s = slice(lo, hi + 1), slice(lo - 1, hi), cells[: hi - lo + 1]
        o = np.subtract(h1[lo - 1 : hi + 1], gap_open, out=opened[: hi - lo + 2])
        np.maximum(o[1:], e[here], out=e[here])
        e[here] -= gap_extend
        np.maximum(o[:-1], f1[left], out=f[here])
        f[here] -= gap_extend
        profile.take(at[lo - 1 : hi] + d, axis=0, out=s, mode="clip")
        s += h2[left]
        np.maximum(s, e[here], out=s)
        np.maximum(s, f[here], out=s)
        np.maximum(s, 0, out=h[here])
        np.maximum(best[here], h[here], out=best[here])
        h, h1, h2, f, f1 = h2, h, h1, f1, f
    return best.max(axis=0)


#: Query positions times targets that are filled side by side, and bytes of a profile.
SIDE, PROFILE = 1 << 14, 1 << 25


def local_scores(queries: list, targets: list, gap_open: int = 11, gap_extend: int = 1, biases: list | None = None, m: np.ndarray | None = None) -> np.ndarray:
    """Scores of local_alignments, 0 where nothing scores. Targets of one query are filled together."""
    m = scores.blosum62() if m is None else m
    out = np.zeros(len(queries), dtype=np.int64)
    groups: dict = {}
    for r, q in enumerate(queries):
        if len(q) and len(targets[r]):
            groups.setdefault((q.tobytes(), None if biases is None or biases[r] is None else biases[r].tobytes()), []).append(r)
    for rows in groups.values():
        q = queries[rows[0]]
        bias = np.zeros(len(q), dtype=np.int32) if biases is None or biases[rows[0]] is None else biases[rows[0]]
        rows.sort(key=lambda r: len(targets[r]))
        while rows:
            lanes = max(1, min(SIDE // len(q), PROFILE // (2 * min(len(q), 64) * len(targets[rows[-1]]))))
            least = len(targets[rows[-1]]) * 3 // 4 - 16  # shorter ones would be filled up with delimiters
            part = [r for r in rows[-lanes:] if len(targets[r]) >= least]
            rows = rows[: -len(part)]
            out[part] = fill_scores(q, [targets[r] for r in part], bias, gap_open, gap_extend, m)
    return out


def operations(q: np.ndarray, t: np.ndarray, trace: np.ndarray, i: int, j: int) -> tuple[int, int, str]:
    """(i, j, operations) of the way back from (i, j); ties prefer the diagonal, then a gap in the query."""
    ops = []
    while i and j and trace[i + j, i] & ABOVE:
        bits = trace[i + j, i]
        if bits & DIAGONAL:
            ops.append("=" if q[i - 1] == t[j - 1] else "X")
            i, j = i - 1, j - 1
            continue
        by_target, opening = (True, DELETION) if bits & DELETED else (False, INSERTION)
        while True:
            ops.append("D" if by_target else "I")
            opened = trace[i + j, i] & opening
            i, j = (i, j - 1) if by_target else (i - 1, j)
            if opened:
                break
    ops.reverse()
    return i, j, "".join(ops)


def local_alignments(queries: list, targets: list, gap_open: int = 11, gap_extend: int = 1, m: np.ndarray | None = None, biases: list | None = None) -> list[dict | None]:
    """Best local alignment of each pair with its operations; None if nothing scores. Pairs of like size are filled together."""
    m = scores.blosum62() if m is None else m
    found: list[dict | None] = [None] * len(queries)
    biases = biases or [None] * len(queries)
    cells = lambda n, k: (n + k + 1) * (n + 1)
    left = sorted((r for r in range(len(queries)) if len(queries[r]) and len(targets[r])), key=lambda r: (len(queries[r]), len(targets[r])))
    while left:
        part = [left.pop()]  # the longest first
        n, k = len(queries[part[0]]), len(targets[part[0]])
        while left and (len(part) + 1) * cells(n, max(k, len(targets[left[-1]]))) <= TRACES:
            part.append(left.pop())
            k = max(k, len(targets[part[-1]]))
        own = [biases[r] if biases[r] is not None else np.zeros(0, dtype=np.int32) for r in part]
        trace, best, i, j = fill_traces([queries[r] for r in part], [targets[r] for r in part], own, gap_open, gap_extend, m)
        for x, r in enumerate(part):
            if best[x] > 0:
                qbegin, sbegin, ops = operations(queries[r], targets[r], trace[:, x], int(i[x]), int(j[x]))
                found[r] = {"score": int(best[x]), "qbegin": qbegin, "qend": int(i[x]), "sbegin": sbegin, "send": int(j[x]), "ops": ops}
    return found


def local_alignment(q: np.ndarray, t: np.ndarray, gap_open: int = 11, gap_extend: int = 1, m: np.ndarray | None = None, bias: np.ndarray | None = None) -> dict | None:
    return local_alignments([q], [t], gap_open, gap_extend, m, [bias])[0]


def describe(a: dict, q: np.ndarray, t: np.ndarray, m: np.ndarray | None = None) -> tuple:
    """HSP columns of an alignment; coordinates count from 1."""
    m = scores.blosum62() if m is None else m
    ops, letters = a["ops"], scores.LETTERS
    i, j, positive, cigar, btop, run = a["qbegin"], a["sbegin"], 0, [], [], 0
    for op in ops:
        kind = "M" if op in "=X" else op
        if cigar and cigar[-1][1] == kind:
            cigar[-1][0] += 1
        else:
            cigar.append([1, kind])
        if op == "=":
            run += 1
        else:
            if run:
                btop.append(str(run))
                run = 0
            btop.append((letters[q[i]] if op != "D" else "-") + (letters[t[j]] if op != "I" else "-"))
        if op in "=X":
            positive += int(m[q[i], t[j]] > 0)
        i += op != "D"
        j += op != "I"
    if run:
        btop.append(str(run))
    gaps = ops.count("I") + ops.count("D")
    opens = sum(k in "ID" for _, k in cigar)
    return (a["score"], a["qbegin"] + 1, a["qend"], a["sbegin"] + 1, a["send"], len(ops), ops.count("="), ops.count("X"), positive, opens, gaps, "".join(f"{n}{k}" for n, k in cigar), "".join(btop))


def align_pairs(pairs: DataFrame, gap_open: int = 11, gap_extend: int = 1, bias: bool = True, max_hsps: int = 1, margin: int = 0, min_score: int = 1) -> DataFrame:
    """HSPs of pairs (.., qseq, tseq): local alignment of each pair, beside the other columns.

    max_hsps > 1 aligns again with the subject ranges found so far masked. With margin > 0 and hit columns i and j, only the
    target within query length + margin of the hit's diagonal is aligned; with columns lo and hi, only the target between
    them, and the two are not returned. bias applies composition correction to the query.
    """
    ranged = "lo" in pairs.columns and "hi" in pairs.columns
    others = [c for c in pairs.columns if c not in ("qseq", "tseq", *(("lo", "hi") if ranged else ()))]
    names = [x.split()[0] for x in HSP.split(", ")]
    kinds = [pa.int32()] * 11 + [pa.string()] * 2

    def aligned(batches):
        for batch in batches:
            rows, where = [], []
            corrected: dict[str, np.ndarray] = {}
            queries, targets, biases, lows = [], [], [], []
            for r in range(batch.num_rows):
                text = batch.column("qseq")[r].as_py() or ""
                q, t = scores.encode(text), scores.encode(batch.column("tseq")[r].as_py() or "")
                if bias and text not in corrected:
                    if len(corrected) > 1000:
                        corrected.clear()
                    corrected[text] = scores.composition_bias(q)
                lo = 0
                if ranged:
                    lo = batch.column("lo")[r].as_py()
                    t = t[lo : batch.column("hi")[r].as_py()]
                elif margin:
                    diagonal = batch.column("j")[r].as_py() - batch.column("i")[r].as_py()
                    lo = max(0, diagonal - margin)
                    t = t[lo : max(lo, diagonal + len(q) + margin)]
                queries.append(q)
                targets.append(t)
                biases.append(corrected.get(text))
                lows.append(lo)
            masked, left = list(targets), list(range(batch.num_rows))
            for again in range(max_hsps):
                found = local_alignments([queries[r] for r in left], [masked[r] for r in left], gap_open, gap_extend, None, [biases[r] for r in left])
                kept = [(r, a) for r, a in zip(left, found, strict=True) if a is not None and a["score"] >= min_score]
                left = [r for r, _ in kept]
                for r, a in kept:
                    row = list(describe(a, queries[r], targets[r]))
                    row[3] += lows[r]
                    row[4] += lows[r]
                    rows.append(row)
                    where.append(r)
                    if again + 1 < max_hsps:
                        masked[r] = masked[r].copy()
                        masked[r][a["sbegin"] : a["send"]] = 25
            take = pa.array(where, pa.int32())
            columns = [pa.array(list(v), k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(c).take(take) for c in others] + columns, names=[*others, *names])

    schema = "".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}, " for c in others)
    return pairs.mapInArrow(aligned, schema + HSP)


def score_hits(hits: DataFrame, window: int = 48) -> DataFrame:
    """Hits (.., qseq, tseq, i, j) with `score`, the ungapped window score."""
    others = [c for c in hits.columns if c not in ("qseq", "tseq", "score")]

    def scored(batches):
        for batch in batches:
            known: dict[str, np.ndarray] = {}

            def code(s: str) -> np.ndarray:
                if s not in known:
                    if len(known) > 2000:
                        known.clear()
                    known[s] = scores.encode(s)
                return known[s]

            cells = zip(*(batch.column(c).to_pylist() for c in ("qseq", "tseq", "i", "j")), strict=True)
            s = pa.array([window_score(code(q), code(t), i, j, window) for q, t, i, j in cells], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in others] + [s], names=[*others, "score"])

    schema = "".join(f"`{c}` {hits.schema[c].dataType.simpleString()}, " for c in others)
    return hits.mapInArrow(scored, schema + "score int")


def evalues(db_letters: int, gap_open: int = 11, gap_extend: int = 1):
    """The e-value of columns score, qlen and slen."""

    @F.pandas_udf("double")
    def ev(score, qlen, slen):
        import pandas as pd

        return pd.Series(scores.evalue(score.to_numpy(), qlen.to_numpy(), slen.to_numpy(), db_letters, gap_open, gap_extend))

    return ev("score", "qlen", "slen")


def with_statistics(hsps: DataFrame, db_letters: int, gap_open: int = 11, gap_extend: int = 1) -> DataFrame:
    """HSPs (score, qlen, slen, ranges) with evalue, bitscore, identities in percent and coverages."""
    h = hsps.withColumn("evalue", evalues(db_letters, gap_open, gap_extend)).withColumn("bitscore", scores.bitscore(F.col("score"), gap_open, gap_extend))
    h = h.withColumn("pident", F.col("nident") * 100.0 / F.col("length")).withColumn("ppos", F.col("positive") * 100.0 / F.col("length"))
    h = h.withColumn("qcovhsp", (F.col("qend") - F.col("qstart") + 1) * 100.0 / F.col("qlen")).withColumn("scovhsp", (F.col("send") - F.col("sstart") + 1) * 100.0 / F.col("slen"))
    same = (F.col("qseq_range") == F.col("sseq_range")) if "qseq_range" in hsps.columns else F.lit(False)
    return h.withColumn("approx_pident", F.when(same, F.lit(100.0)).otherwise(scores.approx_identity(F.col("score"), F.col("qend") - F.col("qstart") + 1, F.col("send") - F.col("sstart") + 1)))
