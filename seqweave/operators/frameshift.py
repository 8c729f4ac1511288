"""Frameshift-aware local alignment of DNA against proteins over the three frames of a strand."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from seqweave.functions import alphabet, scores

OUT = "score int, strand int, qbegin int, qend int, sbegin int, send int, shifts int, transcript string"


def translate_all(dna: str, code: int = 1) -> np.ndarray:
    """Residue code that starts at each base; X where a base is unknown."""
    order, letters = "TCAG", alphabet.GENETIC_CODES[code]
    table = np.full(256, -1, dtype=np.int64)
    for k, b in enumerate(order):
        table[ord(b)] = k
    v = table[np.frombuffer(dna.encode(), dtype=np.uint8)]
    if len(v) < 3:
        return np.zeros(0, dtype=np.int8)
    index = 16 * v[:-2] + 4 * v[1:-1] + v[2:]
    bad = (v[:-2] < 0) | (v[1:-1] < 0) | (v[2:] < 0)
    residues = scores.encode(letters)
    return np.where(bad, 23, residues[np.clip(index, 0, 63)]).astype(np.int8)


def align_strand(codons: np.ndarray, t: np.ndarray, shift: int = 15, gap_open: int = 11, gap_extend: int = 1) -> dict | None:
    """Best local alignment of codons (one per base) with a protein; a step of two or four bases costs `shift`.

    Rows run over bases: a codon follows the one three bases before it; a shifted one, two or four before.
    """
    m, n, k = scores.blosum62(), len(codons), len(t)
    if not n or not k:
        return None
    low = -(10**6)
    h = np.zeros((n + 5, k + 1), dtype=np.int32)  # row r + 4 holds the base r
    f = np.full((n + 5, k + 1), low, dtype=np.int32)
    step = np.zeros((n + 5, k + 1), dtype=np.int8)
    at = np.arange(k + 1)
    for r in range(n):
        row = r + 4
        before = np.stack((h[row - 3, :-1], h[row - 2, :-1] - shift, h[row - 4, :-1] - shift))
        if r < 4:
            before[2] = low if r < 4 else before[2]
            if r < 3:
                before[0] = 0
            if r < 2:
                before[1] = low
        kind = before.argmax(axis=0)
        value = np.maximum(before.max(axis=0), 0) + m[codons[r], t]
        f[row] = np.maximum(h[row - 3] - gap_open, f[row - 3]) - gap_extend if r >= 3 else low
        best = np.maximum(np.concatenate(([0], value)), 0)
        best = np.maximum(best, f[row])
        run = np.maximum.accumulate(best + gap_extend * at)  # gaps in the query along the protein
        gap = np.concatenate(([low], run[:-1] - gap_open - gap_extend * at[1:]))
        h[row] = np.maximum(np.maximum(best, gap), 0)
        choice = np.zeros(k + 1, dtype=np.int8)
        choice[h[row] == gap] = 5
        choice[h[row] == f[row]] = 4
        diagonal = np.concatenate(([False], (value == h[row, 1:]) & (h[row, 1:] > 0)))
        choice[1:][diagonal[1:]] = 1 + kind[diagonal[1:]]
        choice[h[row] <= 0] = 0
        step[row] = choice
    score = int(h.max())
    if score <= 0:
        return None
    row, col = (int(x) for x in np.unravel_index(h.argmax(), h.shape))
    qend, send, ops, shifts = row - 4 + 3, col, [], 0
    first = row
    while row >= 4 and col > 0 and step[row, col]:
        s = step[row, col]
        first = row
        if s in (1, 2, 3):
            came = h[row, col] - m[codons[row - 4], t[col - 1]]
            ops.append("=" if codons[row - 4] == t[col - 1] else "X")
            back = {1: 3, 2: 2, 3: 4}[int(s)]
            row, col = row - back, col - 1
            if came <= 0:
                break
            if s == 2:
                ops.append("\\")
                shifts += 1
            elif s == 3:
                ops.append("/")
                shifts += 1
        elif s == 4:
            while True:
                ops.append("I")
                opened = f[row, col] == h[row - 3, col] - gap_open - gap_extend
                row -= 3
                if opened:
                    break
        else:
            value, length = h[row, col], 1
            while h[row, col - length] - gap_open - gap_extend * length != value:
                length += 1
            ops.extend("D" * length)
            col -= length
    ops.reverse()
    return {"score": score, "qbegin": first - 4, "qend": qend, "sbegin": col, "send": send, "shifts": shifts, "ops": "".join(ops)}


def align_frameshift(pairs: DataFrame, shift: int = 15, code: int = 1) -> DataFrame:
    """Best frameshift alignment of pairs (.., qseq DNA, tseq protein) over both strands; positions count bases from 0."""
    others = [c for c in pairs.columns if c not in ("qseq", "tseq")]
    kinds = [pa.int32()] * 7 + [pa.string()]
    names = [x.split()[0] for x in OUT.split(", ")]

    def aligned(batches):
        for batch in batches:
            rows, where = [], []
            for r in range(batch.num_rows):
                dna, t = (batch.column("qseq")[r].as_py() or "").upper(), scores.encode(batch.column("tseq")[r].as_py() or "")
                back = dna[::-1].translate(str.maketrans("ACGT", "TGCA"))
                found = [(a["score"], s, a) for s, x in ((1, dna), (-1, back)) if (a := align_strand(translate_all(x, code), t, shift))]
                if found:
                    score, strand, a = max(found, key=lambda x: (x[0], x[1]))
                    begin, end = (a["qbegin"], a["qend"]) if strand > 0 else (len(dna) - a["qend"], len(dna) - a["qbegin"])
                    rows.append((score, strand, begin, end, a["sbegin"], a["send"], a["shifts"], a["ops"]))
                    where.append(r)
            columns = [pa.array(list(v), k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(where, pa.int32())) for c in others] + columns, names=[*others, *names])

    return pairs.mapInArrow(aligned, "".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}, " for c in others) + OUT)
