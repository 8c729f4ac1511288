"""Similarity search as one plan: seeds, equi-join, score filters, alignment, ranking."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqweave.functions import scores, shapes
from seqweave.operators import align, chaining, joins, masking, ranking, seeds, translation
from seqweave.plans.scratch import cut_lineage

#: Cells of dynamic programming up to which target ranges that overlap are aligned as one.
MOST_CELLS = 1 << 24


@dataclass
class SearchConfig:
    sensitivity: str = "default"
    codes: list[str] | None = None
    seed_cut: float | None = None
    freq_sd: float = 50.0
    least_identities: int | None = None
    ungapped_cut: int = 0
    max_evalue: float = 0.001
    min_bits: float = 0.0
    k: int = 25
    top: float | None = None
    max_hsps: int = 1
    gap_open: int = 11
    gap_extend: int = 1
    bias: bool = True
    mask: str | None = None
    linear: str | None = None  # target, query or combo: one pivot per key
    margin: int = 64
    db_letters: int | None = None
    filters: dict = field(default_factory=dict)

    def shapes(self) -> list[str]:
        return self.codes or shapes.SHAPES[self.sensitivity]


def search_seeds(seqs: DataFrame, cfg: SearchConfig) -> DataFrame:
    s = seqs
    if cfg.mask:
        s = masking.soft_mask(s.select("oid", "seq"), algorithm=cfg.mask).select("oid", F.col("masked_seq").alias("seq"))
    out = seeds.spaced_seeds(s, cfg.shapes())
    cut = cfg.seed_cut if cfg.seed_cut is not None else shapes.SEED_CUT.get(cfg.sensitivity, 1.0)
    return seeds.complex_seeds(out, cfg.shapes()[0].count("1"), cut) if cut else out


def hits(queries: DataFrame, targets: DataFrame, cfg: SearchConfig) -> DataFrame:
    """(qid, tid, i, j, shape, hamming): one seed hit per diagonal run that passes the identity filter."""
    least = cfg.least_identities if cfg.least_identities is not None else shapes.least_identities(cfg.sensitivity)
    q = search_seeds(queries, cfg)
    keys = None if cfg.mask or cfg.linear else seeds.key_list(q)
    if keys is not None:
        # read once: the cut of frequent seeds counts them before they are joined
        t = cut_lineage(seeds.seeds_around(targets, cfg.shapes(), keys))
        if cfg.freq_sd:
            t = seeds.drop_frequent(t, cfg.freq_sd)
        around = seeds.seeds_around(queries, cfg.shapes()).join(q.select("shape", "seed").distinct(), ["shape", "seed"], "left_semi")
        return joins.leftmost(joins.window_hits(around, t, queries, targets, least))
    t = search_seeds(targets, cfg)
    if cfg.freq_sd:
        t = seeds.drop_frequent(seeds.only_shared(t, q), cfg.freq_sd)
    if cfg.linear:
        q = q.join(queries.select("oid", F.length("seq").alias("len")), "oid")
        t = t.join(targets.select("oid", F.length("seq").alias("len")), "oid")
        found = joins.star_join(q, t, cfg.linear)
    else:
        found = joins.seed_join(q, t)
    return joins.leftmost(joins.hamming_filter(found, queries, targets, least))


def best_hits(queries: DataFrame, targets: DataFrame, cfg: SearchConfig) -> DataFrame:
    """(qid, tid, i, j, score): the hit with the best ungapped window score of each pair."""

    def best(q, t, i, j, base):
        score, a, b = max((align.window_score(q, t, a, b), -a, -b) for a, b in zip(i.tolist(), j.tolist(), strict=True))
        if score > cut:
            yield -a, base - b, score

    cut = cfg.ungapped_cut
    return chaining.each_pair(chaining.with_texts(hits(queries, targets, cfg), queries, targets), best, "i int, j int, score int")


def bands(queries: DataFrame, targets: DataFrame, cfg: SearchConfig) -> DataFrame:
    """(qid, tid, lo, hi, score, qlen, slen): ranges of the target to align, which together hold the band of every chain of the
    pair's hits, and the score of the alignment in each.

    A range reaches over a chain's diagonals by the query's length and the margin; without a margin it is the whole target.
    """
    cut, margin, go, ge, corrected = cfg.ungapped_cut, cfg.margin, cfg.gap_open, cfg.gap_extend, cfg.bias

    def ranges(q, t, i, j, base):
        found = [(a, b) for a, b in sorted(zip(i.tolist(), j.tolist(), strict=True)) if align.window_score(q, t, a, b) > cut]
        if not found or not margin:
            return [(0, len(t))] if found else []
        # a hit whose extension scores nothing is in no chain; its own diagonal is aligned all the same
        ends = {(i - j, i - j) for i, j in found} | {(c["d_min"], c["d_max"]) for c in chaining.pair_chains(q, t, found, 1)}
        out = []
        for lo, hi in sorted((max(0, -b - margin), min(len(t), len(q) - a + margin)) for a, b in ends):
            if out and hi <= out[-1][1]:
                continue
            if out and lo <= out[-1][1] and (hi - out[-1][0]) * len(q) <= MOST_CELLS:
                out[-1] = (out[-1][0], hi)
            else:
                out.append((lo, hi))
        return out

    def scored(codes, texts, where, rows, base, slen):
        biases: dict = {}
        for r in where:
            if corrected and codes[r].tobytes() not in biases:
                biases[codes[r].tobytes()] = scores.composition_bias(codes[r])
        found = align.local_scores([codes[r] for r in where], [texts[r][lo:hi] for r, (lo, hi) in zip(where, rows, strict=True)], go, ge, [biases.get(codes[r].tobytes()) for r in where])
        return [(lo + int(base[r]), hi + int(base[r]), int(s), len(codes[r]), int(slen[r])) for r, (lo, hi), s in zip(where, rows, found, strict=True)]

    pairs = chaining.with_texts(hits(queries, targets, cfg), queries, targets, margin)
    return chaining.each_pair(pairs, ranges, "lo int, hi int, score int, qlen int, slen int", scored)


def worth_aligning(ranges: DataFrame, db: int, cfg: SearchConfig) -> DataFrame:
    """(qid, tid, lo, hi) of the bands whose alignments can be among the results: the significant ones of the best targets, and
    of one target the best ones if it has one alignment. Filters of alignments are met later, so with them all targets stay."""
    h = ranges.where("score > 0").withColumn("evalue", align.evalues(db, cfg.gap_open, cfg.gap_extend)).withColumn("bitscore", scores.bitscore(F.col("score"), cfg.gap_open, cfg.gap_extend))
    h = cut_lineage(ranking.significant(h, cfg.max_evalue, cfg.min_bits))
    if not cfg.filters:
        h = ranking.top_percent(h, cfg.top) if cfg.top is not None else ranking.top_targets(h, cfg.k or 10**9)
        if cfg.max_hsps == 1:
            h = h.withColumn("_best", F.max("score").over(Window.partitionBy("qid", "tid"))).where("score = _best")
    return h.select("qid", "tid", "lo", "hi")


def search(queries: DataFrame, targets: DataFrame, cfg: SearchConfig | None = None) -> DataFrame:
    """HSPs of each query's best targets, ready for the output formats. Inputs: (oid, seq[, id, title])."""
    cfg = cfg or SearchConfig()
    db = cfg.db_letters or targets.agg(F.sum(F.length("seq"))).first()[0] or 1
    name = lambda df: F.coalesce(F.col("id"), F.col("oid").cast("string")) if "id" in df.columns else F.col("oid").cast("string")
    title = lambda df: F.col("title") if "title" in df.columns else name(df)
    q = queries.select(F.col("oid").alias("qid"), name(queries).alias("qseqid"), title(queries).alias("qtitle"), F.col("seq").alias("full_qseq"), F.length("seq").alias("qlen"))
    t = targets.select(F.col("oid").alias("tid"), name(targets).alias("sseqid"), title(targets).alias("stitle"), F.col("seq").alias("full_sseq"), F.length("seq").alias("slen"))
    # scores come first, of all pairs; only what can be among the results is aligned with its way back
    chosen = worth_aligning(bands(queries, targets, cfg), db, cfg)
    # dealt by number, not by size: rows are small, but each is an alignment
    dealt = cut_lineage(chosen.repartition(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), "qid", "tid", "lo"))
    pairs = dealt.join(q, "qid").join(t, "tid").withColumn("qseq", F.col("full_qseq")).withColumn("tseq", F.col("full_sseq"))
    h = align.align_pairs(pairs, cfg.gap_open, cfg.gap_extend, cfg.bias, cfg.max_hsps)
    if cfg.max_hsps > 1:  # ranges too large to be joined may overlap and find one alignment twice
        h = h.dropDuplicates(["qid", "tid", "qstart", "qend", "sstart", "send"])
    h = ranking.significant(align.with_statistics(h, db, cfg.gap_open, cfg.gap_extend), cfg.max_evalue, cfg.min_bits)
    h = ranking.best_per_pair(ranking.hsp_filters(h, **cfg.filters), cfg.max_hsps)
    if cfg.top is not None:
        h = ranking.top_targets(ranking.top_percent(h, cfg.top), 10**9)
    else:
        h = ranking.top_targets(h, cfg.k or 10**9)
    return h


def iterated_search(queries: DataFrame, targets: DataFrame, cfg: SearchConfig) -> DataFrame:
    """Rounds of rising sensitivity; only queries without a hit go on."""
    found, left = None, queries
    for level in [*shapes.ITERATED.get(cfg.sensitivity, []), cfg.sensitivity]:
        part = cut_lineage(search(left, targets, SearchConfig(**{**cfg.__dict__, "sensitivity": level})))
        found = part if found is None else found.union(part)
        left = ranking.unaligned(left, part)
    return found


def translated_search(dna: DataFrame, targets: DataFrame, cfg: SearchConfig | None = None, code: int = 1, strand: str = "both", min_orf: int | None = None) -> DataFrame:
    """DNA queries against proteins through six frames; coordinates are those of the DNA."""
    frames = translation.mask_orfs(translation.six_frames(dna, code, strand), min_orf)
    f = frames.select((F.col("oid") * 6 + F.col("frame")).alias("oid"), "seq", F.col("oid").alias("source"), "frame", "source_len")
    h = search(f.select("oid", "seq"), targets, cfg)
    back = f.select(F.col("oid").alias("qid"), "source", "frame", "source_len")
    return translation.query_coordinates(h.join(back, "qid").withColumn("qid", F.col("source")).drop("source"))


def exhaustive_search(queries: DataFrame, targets: DataFrame, cfg: SearchConfig | None = None) -> DataFrame:
    """Every pair by full dynamic programming, without seeds."""
    cfg = cfg or SearchConfig()
    db = cfg.db_letters or targets.agg(F.sum(F.length("seq"))).first()[0] or 1
    pairs = joins.exhaustive(queries, targets).withColumn("qlen", F.length("qseq")).withColumn("slen", F.length("tseq"))
    h = align.with_statistics(align.align_pairs(pairs, cfg.gap_open, cfg.gap_extend, cfg.bias, cfg.max_hsps), db, cfg.gap_open, cfg.gap_extend)
    return ranking.top_targets(ranking.significant(h, cfg.max_evalue, cfg.min_bits), cfg.k)


def globally_ranked(queries: DataFrame, targets: DataFrame, n: int, cfg: SearchConfig | None = None) -> DataFrame:
    """The n best targets of a query by ungapped score over all shapes, then aligned."""
    cfg = cfg or SearchConfig()
    top = ranking.global_rank(best_hits(queries, targets, cfg), n)
    keep = top.select("qid", "tid")
    q, t = queries.select(F.col("oid").alias("qid"), F.col("seq").alias("qseq")), targets.select(F.col("oid").alias("tid"), F.col("seq").alias("tseq"))
    pairs = keep.join(q, "qid").join(t, "tid").withColumn("qlen", F.length("qseq")).withColumn("slen", F.length("tseq"))
    db = cfg.db_letters or targets.agg(F.sum(F.length("seq"))).first()[0] or 1
    return ranking.significant(align.with_statistics(align.align_pairs(pairs, cfg.gap_open, cfg.gap_extend, cfg.bias), db, cfg.gap_open, cfg.gap_extend), cfg.max_evalue)


def corrected_bits(hsps: DataFrame, cfg: SearchConfig | None = None) -> DataFrame:
    cfg = cfg or SearchConfig()
    go, ge = cfg.gap_open, cfg.gap_extend

    @F.pandas_udf("double")
    def corrected(score, qlen, slen):
        import pandas as pd

        return pd.Series(scores.bitscore_corrected(score.to_numpy(), qlen.to_numpy(), slen.to_numpy(), go, ge))

    return hsps.withColumn("corrected_bitscore", corrected("score", "qlen", "slen"))
