"""Joins of seeds and the predicates that go with them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqweave.operators import seeds as S


def _as(seeds: DataFrame, oid: str, pos: str) -> DataFrame:
    return seeds.withColumnRenamed("oid", oid).withColumnRenamed("pos", pos)


def seed_join(queries: DataFrame, targets: DataFrame) -> DataFrame:
    """Every pair of a query and a target seed with one shape and key: (shape, seed, qid, i, tid, j)."""
    return _as(queries, "qid", "i").join(_as(targets, "tid", "j"), ["shape", "seed"])


def self_join(seeds: DataFrame) -> DataFrame:
    """Pairs of seeds of different sequences, each unordered pair once."""
    return seed_join(seeds, seeds).where("qid < tid")


def with_length_ratio(hits: DataFrame, lengths: DataFrame, least: float, target_lengths: DataFrame | None = None) -> DataFrame:
    """Hits whose sequences have lengths in a ratio of at least `least`, both ways; target_lengths if targets are other sequences."""
    ql, tl = lengths.select(F.col("oid").alias("qid"), F.col("len").alias("qlen")), (target_lengths or lengths).select(F.col("oid").alias("tid"), F.col("len").alias("tlen"))
    return hits.join(ql, "qid").join(tl, "tid").where(F.least("qlen", "tlen") >= least * F.greatest("qlen", "tlen"))


def star_join(queries: DataFrame, targets: DataFrame, side: str = "target") -> DataFrame:
    """Linear joins: per key only the longest target (side target), query (query), or longest of both (combo).

    seeds carry `len`; ties go to the smaller id. The pivot comes from an aggregate, so a hot key is reduced before it is
    joined and yields as many rows as it has seeds, not their product.
    """
    key = ["shape", "seed"]

    def pivot(s: DataFrame, oid: str, pos: str) -> DataFrame:
        best = F.max_by(F.struct("oid", "pos"), F.struct(F.col("len"), -F.col("oid"), -F.col("pos")))
        return s.groupBy(*key).agg(best.alias("_p")).select(*key, F.col("_p.oid").alias(oid), F.col("_p.pos").alias(pos))

    q, t = _as(queries, "qid", "i").drop("len"), _as(targets, "tid", "j").drop("len")
    if side == "target":
        return q.join(pivot(targets, "tid", "j"), key)
    if side == "query":
        return pivot(queries, "qid", "i").join(t, key)
    both = queries.withColumn("_q", F.lit(True)).union(targets.withColumn("_q", F.lit(False)))
    top = both.groupBy(*key).agg(F.max_by(F.struct("_q", "oid", "pos"), F.struct(F.col("len"), F.col("_q"), -F.col("oid"), -F.col("pos"))).alias("_p"))
    of_query = top.where("_p._q").select(*key, F.col("_p.oid").alias("qid"), F.col("_p.pos").alias("i")).join(t, key)
    of_target = q.join(top.where("not _p._q").select(*key, F.col("_p.oid").alias("tid"), F.col("_p.pos").alias("j")), key)
    columns = [*key, "qid", "i", "tid", "j"]
    return of_query.select(*columns).union(of_target.select(*columns))


def kmer_rank(queries: DataFrame, targets: DataFrame) -> DataFrame:
    """(oid, rank) of queries: sum over their seeds of the root of how many target seeds share the key."""
    n = targets.groupBy("shape", "seed").agg(F.sqrt(F.count("*")).alias("r"))
    return queries.join(n, ["shape", "seed"], "left").groupBy("oid").agg(F.sum(F.coalesce("r", F.lit(0.0))).alias("rank"))


def window_identities(q: Column, t: Column, i: Column, j: Column, left: int = 16, right: int = 32) -> Column:
    """Identical letters on a hit's diagonal from `left` before to `right` after it, clipped at the ends."""
    back = F.least(F.lit(left), i, j)
    size = F.least(back + right, F.length(q) - i + back, F.length(t) - j + back)
    a, b = F.substring(q, i - back + 1, size), F.substring(t, j - back + 1, size)
    return F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x == y) & ~x.isin("X", "*", "_", "")), lambda x: x))


def hamming_filter(hits: DataFrame, queries: DataFrame, targets: DataFrame, least: int) -> DataFrame:
    """Hits with at least `least` identities in the window around the seed; adds `hamming`."""
    h = hits.join(queries.select(F.col("oid").alias("qid"), F.col("seq").alias("_q")), "qid").join(targets.select(F.col("oid").alias("tid"), F.col("seq").alias("_t")), "tid")
    return h.withColumn("hamming", window_identities(F.col("_q"), F.col("_t"), F.col("i"), F.col("j"))).where(F.col("hamming") >= least).drop("_q", "_t")


def compare_windows(hits: DataFrame, least: int, left: int = 16, right: int = 32) -> DataFrame:
    """Hits with columns qwin, qat, twin and tat (see seeds_around) as hamming_filter gives them, from these windows alone."""
    others = ["shape", "seed", "qid", "i", "tid", "j"]
    silent = np.zeros(256, dtype=bool)
    silent[list(b"X*_")] = True

    def placed(win, at, fill: int) -> np.ndarray:
        offsets = np.frombuffer(win.buffers()[1], dtype=np.int32)[win.offset : win.offset + len(win) + 1].astype(np.int64)
        out, size = np.full((len(win), left + right), fill, dtype=np.uint8), np.diff(offsets)
        data = np.frombuffer(win.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
        row = np.repeat(np.arange(len(win)), size)
        out[row, np.arange(len(data)) - (offsets[:-1] - offsets[0])[row] + (left - at)[row]] = data
        return out

    def compared(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            q, t = (placed(batch.column(w), batch.column(a).to_numpy(), f) for w, a, f in (("qwin", "qat", 0), ("twin", "tat", 1)))
            same = ((q == t) & ~silent[q]).sum(axis=1).astype(np.int32)
            keep = np.flatnonzero(same >= least)
            take = pa.array(keep)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in others), pa.array(same[keep])], names=[*others, "hamming"])

    kinds = ", ".join(f"{c} {hits.schema[c].dataType.simpleString()}" for c in others)
    return hits.select(*others, "qwin", "qat", "twin", "tat").mapInArrow(compared, f"{kinds}, hamming int")


def repeated(seqs: DataFrame) -> DataFrame | None:
    """Ids that more than one sequence has; None if there are none."""
    ids = seqs.groupBy("oid").agg(F.count("*").alias("n")).where((F.col("n") > 1) & F.col("oid").isNotNull()).select("oid")
    return None if ids.isEmpty() else ids


def window_hits(query_seeds: DataFrame, target_seeds: DataFrame, queries: DataFrame, targets: DataFrame, least: int) -> DataFrame:
    """hamming_filter of the seed join of seeds that carry their windows (seeds_around): no text is joined to a hit, but where an
    id names several texts each of them is compared."""
    q = query_seeds.select("shape", "seed", F.col("oid").alias("qid"), F.col("pos").alias("i"), F.col("win").alias("qwin"), F.col("at").alias("qat"))
    t = target_seeds.select("shape", "seed", F.col("oid").alias("tid"), F.col("pos").alias("j"), F.col("win").alias("twin"), F.col("at").alias("tat"))
    found = q.join(t, ["shape", "seed"]).where("qid is not null and tid is not null")
    if repeated(queries) is not None:
        return hamming_filter(found.drop("qwin", "qat", "twin", "tat"), queries, targets, least)
    often = repeated(targets)
    if often is None:
        return compare_windows(found, least)
    of = often.withColumnRenamed("oid", "tid")
    slow = hamming_filter(found.join(of, "tid", "left_semi").drop("qwin", "qat", "twin", "tat"), queries, targets.join(often, "oid", "left_semi"), least)
    return compare_windows(found.join(of, "tid", "left_anti"), least).unionByName(slow)


def seed_hits(queries: DataFrame, targets: DataFrame, codes: list[str], least: int) -> DataFrame:
    """(shape, seed, qid, i, tid, j, hamming): pairs of seeds with at least `least` identities around them, in one pass over targets."""
    q = S.seeds_around(queries, codes)
    keys = S.key_list(q)
    if keys is None:
        return hamming_filter(seed_join(S.spaced_seeds(queries, codes), S.spaced_seeds(targets, codes)), queries, targets, least)
    return window_hits(q, S.seeds_around(targets, codes, keys), queries, targets, least)


def leftmost(hits: DataFrame, window: int = 48) -> DataFrame:
    """One hit per diagonal and run of hits less than `window` apart: the first by position, then shape."""
    by = Window.partitionBy("qid", "tid", "_d").orderBy("i", "shape")
    h = hits.withColumn("_d", F.col("i") - F.col("j"))
    h = h.withColumn("_before", F.lag("i").over(by))
    return h.where(F.col("_before").isNull() | (F.col("i") - F.col("_before") >= window)).drop("_d", "_before")


def group_hits(hits: DataFrame) -> DataFrame:
    return hits.groupBy("qid", "tid").agg(F.count("*").alias("n_hits"), F.max("hamming").alias("best"))


def exhaustive(queries: DataFrame, targets: DataFrame, blocks: int = 64) -> DataFrame:
    """Every query against every target, dealt by blocks of queries so that no task holds a whole side."""
    q = queries.select(F.col("oid").alias("qid"), F.col("seq").alias("qseq"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_b"))
    t = targets.select(F.col("oid").alias("tid"), F.col("seq").alias("tseq"), F.pmod(F.xxhash64("oid"), F.lit(blocks)).cast("int").alias("_b"))
    return q.join(t, "_b").drop("_b")
