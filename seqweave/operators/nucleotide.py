"""Nucleotide search: minimiser index, exact extension, colinear chaining, affine alignment and its statistics."""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqweave.functions import alphabet, digest
from seqweave.operators import seeds
from seqweave.plans.scratch import cut_lineage


def matrix(match: int = 2, mismatch: int = -3) -> np.ndarray:
    """Scores by letter code of the amino alphabet, so that alignment kernels take DNA too; N never matches."""
    from seqweave.functions.scores import LETTERS

    m = np.full((26, 26), mismatch, dtype=np.int32)
    for c in "ACGT":
        m[LETTERS.index(c), LETTERS.index(c)] = match
    return m


@cache
def karlin(match: int = 2, mismatch: int = -3) -> tuple[float, float]:
    """(lambda, K) of ungapped scores at even base frequencies: the root of sum p exp(lambda s) = 1, and K by its series."""
    p = {match: 0.25, mismatch: 0.75}
    low, high = 1e-6, 10.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(q * math.exp(mid * s) for s, q in p.items()) < 1 else (low, mid)
    lam = (low + high) / 2
    mean = sum(s * q * math.exp(lam * s) for s, q in p.items())
    sigma, walk = 0.0, {0: 1.0}
    for k in range(1, 60):
        step: dict[int, float] = {}
        for s, q in walk.items():
            for d, w in p.items():
                step[s + d] = step.get(s + d, 0.0) + q * w
        walk = step
        sigma += sum(q * (math.exp(lam * s) if s < 0 else 1.0) for s, q in walk.items()) / k
    unit = math.gcd(match, -mismatch)
    k = unit * math.exp(-2 * sigma) / (mean * (1 - math.exp(-lam * unit)))
    return lam, k


def minimizers(dna: DataFrame, k: int = 15, w: int = 10) -> DataFrame:
    """(seed, oid, pos, strand): minimisers of both strands' smaller k-mer; pos is that of the forward strand."""
    s = seeds.windows(dna, k).where(~F.col("win").contains("N"))
    back = alphabet.reverse_complement(F.col("win"))
    s = s.where(F.col("win") != back).select("oid", "pos", F.least("win", back).alias("seed"), F.when(F.col("win") < back, 1).otherwise(-1).alias("strand"))
    by = Window.partitionBy("oid").orderBy("pos").rowsBetween(-(w - 1), 0)
    best = F.min(F.struct(F.md5("seed").alias("h"), "pos", "seed", "strand")).over(by)
    full = F.count("*").over(by) == w
    return s.select("oid", best.alias("b"), full.alias("f")).where("f").select("oid", "b.seed", "b.pos", "b.strand").distinct()


_COMPLEMENT = np.arange(256, dtype=np.uint8)
_COMPLEMENT[list(b"ACGT")] = list(b"TGCA")
_BASE = np.full(256, -1, dtype=np.int64)
_BASE[list(b"ACGT")] = range(4)


def text_minimizers(text: pa.StringArray, k: int, w: int, block: int | None = None):
    """(row, pos, letters, strand) of the minimisers of texts, block by block of whole texts."""
    bad = np.zeros(256, dtype=bool)
    bad[ord("N")] = True
    for first, at, data in seeds.each_text(text.fill_null(""), block):
        row, pos, letters = seeds.windows_of(data, at, np.arange(k), bad)
        back = _COMPLEMENT[letters][:, ::-1]
        differs = letters != back
        each, place = np.arange(len(letters)), differs.argmax(axis=1)
        forward = letters[each, place] < back[each, place]
        keep = np.flatnonzero(differs[each, place])  # one strand's text can be the other's: such have no strand
        row, pos, forward = row[keep], pos[keep], forward[keep]
        letters = np.where(forward[:, None], letters[keep], back[keep])
        _, best = seeds.sliding_least(row, *digest.md5_words(letters), w)
        best = best[np.append(True, best[1:] != best[:-1])] if len(best) else best
        yield row[best] + first, pos[best], letters[best], np.where(forward[best], 1, -1)


def sequence_minimizers(dna: DataFrame, k: int = 15, w: int = 10, keys: list | None = None) -> DataFrame:
    """minimizers, each text in one piece; with keys, only those whose seed is among them."""
    wanted = None if keys is None else pa.array(keys, pa.string())

    def read(batches):
        for batch in batches:
            for row, pos, letters, strand in text_minimizers(batch.column("_s"), k, w):
                out = pa.RecordBatch.from_arrays([batch.column("oid").take(pa.array(row)), seeds.string_rows(letters), pa.array(pos.astype(np.int32)), pa.array(strand.astype(np.int32))], names=["oid", "seed", "pos", "strand"])
                yield out if wanted is None else out.filter(pc.is_in(out.column("seed"), value_set=wanted))

    def by_id(s):
        m = minimizers(s, k, w)
        return m if keys is None else m.where(F.col("seed").isin(keys))

    kind = dna.schema["oid"].dataType.simpleString()
    return seeds.apart(dna, lambda s: s.select("oid", F.col("seq").alias("_s")).mapInArrow(read, f"oid {kind}, seed string, pos int, strand int"), by_id)


def seed_counts(dna: DataFrame, k: int = 15, w: int = 10) -> DataFrame:
    """(code, seed, n): how many minimisers have a seed, given by two bits a base, or by its text if it has other letters."""

    def read(batches):
        for batch in batches:
            for _, _, letters, _ in text_minimizers(batch.column("_s"), k, w, seeds.MANY):
                plain = (_BASE[letters] >= 0).all(axis=1)
                code = np.zeros(int(plain.sum()), dtype=np.int64)
                for column in letters[plain].T:
                    code = (code << 2) | _BASE[column]
                code, n = np.unique(code, return_counts=True)
                rest = seeds.string_rows(letters[~plain])
                both = [pa.concat_arrays([pa.array(code), pa.nulls(len(rest), pa.int64())]), pa.concat_arrays([pa.nulls(len(code), pa.string()), rest]), pa.array(np.append(n, np.ones(len(rest), dtype=np.int64)))]
                yield pa.RecordBatch.from_arrays(both, names=["code", "seed", "n"])

    def by_id(s):
        return minimizers(s, k, w).select(F.lit(None).cast("long").alias("code"), "seed", F.lit(1).cast("long").alias("n"))

    def plain_code(c):  # the same number for texts of repeated ids
        digits = F.transform(F.split(F.translate(c, "ACGT", "0123"), ""), lambda x: x.cast("long"))
        return F.when(c.rlike("^[ACGT]+$"), F.aggregate(digits, F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 2) + x))

    if k > 31:
        return minimizers(dna, k, w).groupBy(F.lit(None).cast("long").alias("code"), "seed").agg(F.count("*").alias("n"))
    n = seeds.apart(dna, lambda s: s.select(F.col("seq").alias("_s")).mapInArrow(read, "code long, seed string, n long"), by_id)
    n = n.withColumn("code", F.coalesce("code", plain_code(F.col("seed")))).withColumn("seed", F.when(F.col("code").isNull(), F.col("seed")))
    return n.groupBy("code", "seed").agg(F.sum("n").alias("n"))


def repetitive_from(counts: DataFrame, share: float = 0.0002) -> int | None:
    """The count from which drop_repetitive drops keys; None if it drops none."""
    sizes = sorted(((r["n"], r["keys"]) for r in counts.groupBy("n").agg(F.count("*").alias("keys")).collect()), reverse=True)
    most, above, out = math.floor(sum(keys for _, keys in sizes) * share), 0, None
    for n, keys in sizes:
        above += keys
        if above > most or n <= 1:
            break
        out = n
    return out


def shared_index(queries: DataFrame, targets: DataFrame, k: int = 15) -> DataFrame:
    """What anchors needs of drop_repetitive(minimizers(targets, k)): minimisers that some query has. How often seeds occur is
    counted over all targets."""
    keys = [r["seed"] for r in sequence_minimizers(queries, k).select("seed").distinct().limit(seeds.MOST_KEYS + 1).collect()]
    if len(keys) > seeds.MOST_KEYS:
        return drop_repetitive(sequence_minimizers(targets, k))
    cut = repetitive_from(seed_counts(targets, k))
    index = sequence_minimizers(targets, k, keys=keys)
    if cut is None:
        return index
    index = cut_lineage(index)
    return index.join(index.groupBy("seed").agg(F.count("*").alias("n")).where(F.col("n") >= cut).select("seed"), "seed", "left_anti")


def drop_repetitive(index: DataFrame, share: float = 0.0002) -> DataFrame:
    """Index without the `share` of keys that occur most often; keys of one count go or stay together."""
    n = index.groupBy("seed").agg(F.count("*").alias("n"))
    sizes = n.groupBy("n").agg(F.count("*").alias("keys"))  # one row per count
    above = F.sum("keys").over(Window.orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("keys").over(Window.partitionBy(F.lit(0)))
    hot = sizes.withColumn("_a", above).withColumn("_t", total).where((F.col("_a") <= F.floor(F.col("_t") * share)) & (F.col("n") > 1)).select("n")
    return index.join(n.join(hot, "n").select("seed"), "seed", "left_anti")


def anchors(queries: DataFrame, index: DataFrame, k: int = 15) -> DataFrame:
    """(qid, tid, strand, i, j): query and target positions of shared minimisers; on strand -1, i counts from the query's end."""
    q = minimizers(queries, k).join(queries.select("oid", F.length("seq").alias("qlen")), "oid").select("seed", F.col("oid").alias("qid"), F.col("pos").alias("qpos"), F.col("strand").alias("qs"), "qlen")
    h = q.join(index.select("seed", F.col("oid").alias("tid"), F.col("pos").alias("j"), F.col("strand").alias("ts")), "seed")
    strand = F.col("qs") * F.col("ts")
    return h.select("qid", "tid", strand.alias("strand"), F.when(strand > 0, F.col("qpos")).otherwise(F.col("qlen") - F.col("qpos") - k).alias("i"), "j")


def chain_anchors(i: np.ndarray, j: np.ndarray, k: int, most_gap: int = 5000) -> list[tuple[float, list[int]]]:
    """Colinear chains of k-long anchors (score, indexes), best first; gaps cost their diagonals' distance and its log."""
    order = np.lexsort((i, j))
    i, j = i[order], j[order]
    best, back = np.full(len(i), float(k)), np.full(len(i), -1)
    for a in range(1, len(i)):
        p = np.arange(max(0, a - 500), a)
        di, dj = i[a] - i[p], j[a] - j[p]
        gap = np.abs(di - dj)
        gain = np.minimum(np.minimum(di, dj), k) - np.where(gap > 0, 0.01 * k * gap + 0.5 * np.log2(np.maximum(gap, 1)), 0)
        total = np.where((di > 0) & (dj > 0) & (np.maximum(di, dj) <= most_gap), best[p] + gain, -np.inf)
        if total.max() > best[a]:
            best[a], back[a] = total.max(), p[total.argmax()]
    out, used = [], np.zeros(len(i), dtype=bool)
    for a in np.argsort(-best, kind="stable"):
        path, at = [], int(a)
        while at != -1 and not used[at]:
            path.append(at)
            at = int(back[at])
        if path:
            used[path] = True
            out.append((float(best[a] - (best[at] if at != -1 else 0)), [int(order[x]) for x in path[::-1]]))
    return sorted(out, key=lambda c: -c[0])


CHAINS = "qid bigint, tid bigint, strand int, qbegin int, qend int, sbegin int, send int, score double, n_anchors int"


def map_queries(queries: DataFrame, targets: DataFrame, k: int = 15, least: float = 30.0) -> DataFrame:
    """Chains of each query with primary flag and mapping quality from its best and second chain."""
    index = shared_index(queries, targets, k)

    def chained(frame):
        import pandas as pd

        i, j = frame["i"].to_numpy(), frame["j"].to_numpy()
        rows = [(frame["qid"].iloc[0], frame["tid"].iloc[0], frame["strand"].iloc[0], i[c].min(), i[c].max() + k, j[c].min(), j[c].max() + k, s, len(c)) for s, c in chain_anchors(i, j, k) if s >= least]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in CHAINS.split(", ")])

    c = anchors(queries, index, k).groupBy("qid", "tid", "strand").applyInPandas(chained, CHAINS)
    by = Window.partitionBy("qid").orderBy(F.col("score").desc(), "tid", "sbegin")
    second = F.coalesce(F.lead("score").over(by), F.lit(0.0))
    c = c.withColumn("rank", F.row_number().over(by)).withColumn("_2", second)
    quality = F.least(F.lit(60.0), 40 * (1 - F.col("_2") / F.col("score")) * F.least(F.lit(1.0), F.col("n_anchors") / 10.0) * F.log("score"))
    return c.withColumn("primary", F.col("rank") == 1).withColumn("mapq", F.when(F.col("rank") == 1, F.floor(quality)).otherwise(0).cast("int")).drop("_2")
