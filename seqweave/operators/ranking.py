"""Filters, ranking and culling of alignments."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hsp_filters(hsps: DataFrame, identity: float = 0, approx_id: float = 0, query_cover: float = 0, subject_cover: float = 0, either_cover: float = 0, no_self: bool = False, expression: str | None = None) -> DataFrame:
    """HSPs that pass every threshold (percent); `expression` is a SQL predicate over HSP columns."""
    h = hsps
    if identity:
        h = h.where(F.col("pident") >= identity)
    if approx_id:
        h = h.where(F.col("approx_pident") >= approx_id)
    if query_cover:
        h = h.where(F.col("qcovhsp") >= query_cover)
    if subject_cover:
        h = h.where(F.col("scovhsp") >= subject_cover)
    if either_cover:
        h = h.where(F.greatest("qcovhsp", "scovhsp") >= either_cover)
    if no_self:
        h = h.where(~((F.col("qtitle") == F.col("stitle")) & (F.col("full_qseq") == F.col("full_sseq"))))
    return h.where(expression) if expression else h


def significant(hsps: DataFrame, max_evalue: float = 0.001, min_bits: float = 0) -> DataFrame:
    """A least bit score replaces the e-value cutoff."""
    return hsps.where(F.col("bitscore") >= min_bits) if min_bits else hsps.where(F.col("evalue") <= max_evalue)


def best_per_pair(hsps: DataFrame, keep: int = 1) -> DataFrame:
    """The `keep` best HSPs of each query and target, by score, then begin."""
    by = Window.partitionBy("qid", "tid").orderBy(F.col("score").desc(), "qstart", "sstart")
    return hsps.withColumn("hspnum", F.row_number().over(by)).where(F.col("hspnum") <= keep)


def cull_overlaps(hsps: DataFrame, overlap: float = 0.5, most: int = 0) -> DataFrame:
    """HSPs of a pair without those half covered, in query or subject, by a better one; at most `most` (0: all)."""

    def cull(frame: pd.DataFrame) -> pd.DataFrame:
        kept: list = []
        for row in frame.sort_values(["score", "qstart", "sstart"], ascending=[False, True, True]).itertuples():
            inside = False
            for k in kept:
                q = min(row.qend, k.qend) - max(row.qstart, k.qstart) + 1
                s = min(row.send, k.send) - max(row.sstart, k.sstart) + 1
                if q >= overlap * (row.qend - row.qstart + 1) or s >= overlap * (row.send - row.sstart + 1):
                    inside = True
                    break
            if not inside and (not most or len(kept) < most):
                kept.append(row)
        return frame.loc[[k.Index for k in kept]]

    return hsps.groupBy("qid", "tid").applyInPandas(cull, hsps.schema)


def top_targets(hsps: DataFrame, k: int = 25) -> DataFrame:
    """HSPs of the k best targets of each query by (evalue, score descending, target); 0 keeps all."""
    if not k:
        return hsps
    best = hsps.groupBy("qid", "tid").agg(F.min(F.struct(F.col("evalue"), -F.col("score"))).alias("_b"))
    by = Window.partitionBy("qid").orderBy("_b", "tid")
    chosen = best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("qid", "tid", "rank")
    return hsps.join(chosen, ["qid", "tid"])


def top_percent(hsps: DataFrame, percent: float) -> DataFrame:
    """Targets whose best bit score is within `percent` of the query's best, and at least 1; 100 keeps all."""
    if percent >= 100:
        return hsps
    h = hsps.withColumn("_t", F.max("bitscore").over(Window.partitionBy("qid", "tid"))).withColumn("_q", F.max("bitscore").over(Window.partitionBy("qid")))
    return h.where(F.col("_t") >= F.greatest(F.lit(1.0), F.col("_q") * (1 - percent / 100.0))).drop("_t", "_q")


def taxon_k(ranked: DataFrame, k: int) -> DataFrame:
    """Targets of a query in rank order while one of their taxa has fewer than k; columns qid, rank, taxa.

    A target is skipped if all its taxa are full; one without taxa is only kept as the first.
    """

    def scan(frame: pd.DataFrame) -> pd.DataFrame:
        used: dict = {}
        keep = []
        for row in frame.sort_values(["rank", "tid"]).itertuples():
            taxa = list(row.taxa) if row.taxa is not None else []
            if keep and all(used.get(t, 0) >= k for t in taxa):
                continue
            for t in taxa:
                used[t] = used.get(t, 0) + 1
            keep.append(row.Index)
        return frame.loc[keep]

    return ranked.groupBy("qid").applyInPandas(scan, ranked.schema)


def range_cull(hsps: DataFrame, k: int = 1, cover: float = 0.5, top: float | None = None) -> DataFrame:
    """Range culling: in score order, drop a target if `cover` of its query range is covered k times already.

    With `top`, a position counts as covered by a score that is more than top percent better. Without, only the best k rows of
    one range go on: if one of them is dropped the others of its range are too, and k that stay cover it.
    """
    if top is None:
        by = Window.partitionBy("qid", "qstart", "qend").orderBy(F.col("score").desc(), "tid")
        hsps = hsps.withColumn("_k", F.row_number().over(by)).where(F.col("_k") <= k).drop("_k")

    def scan(frame: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        size = int(frame["qend"].max()) + 1
        count, best = np.zeros(size, dtype=np.int64), np.zeros(size)
        keep = []
        for row in frame.sort_values(["score", "tid", "qstart"], ascending=[False, True, True]).itertuples():
            a, b = int(row.qstart), int(row.qend) + 1
            covered = (count[a:b] >= k) if top is None else (best[a:b] * (1 - top / 100.0) > row.bitscore)
            if covered.sum() >= cover * (b - a):
                continue
            count[a:b] += 1
            best[a:b] = np.maximum(best[a:b], row.bitscore)
            keep.append(row.Index)
        return frame.loc[keep]

    return hsps.groupBy("qid").applyInPandas(scan, hsps.schema)


def global_rank(hits: DataFrame, n: int) -> DataFrame:
    """The n targets of each query with the best ungapped score over all hits: (qid, tid, score, rank)."""
    best = hits.groupBy("qid", "tid").agg(F.max("score").alias("score"))
    by = Window.partitionBy("qid").orderBy(F.col("score").desc(), "tid")
    return best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n)


def aligned(queries: DataFrame, hsps: DataFrame) -> DataFrame:
    return queries.join(hsps.select(F.col("qid").alias("oid")).distinct(), "oid", "left_semi")


def unaligned(queries: DataFrame, hsps: DataFrame) -> DataFrame:
    return queries.join(hsps.select(F.col("qid").alias("oid")).distinct(), "oid", "left_anti")
