"""Clustering by rounds of search, greedy vertex cover and composition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqweave.operators import align, graph
from seqweave.plans.scratch import cut_lineage
from seqweave.plans.search import SearchConfig, corrected_bits, search
from seqweave.sources.files import number_rows


def renumber_by_length(seqs: DataFrame) -> DataFrame:
    """seqs numbered from the longest; of equal lengths the larger old number first. The old number stays as `old`."""
    d = seqs.withColumnRenamed("oid", "old").withColumn("_l", -F.length("seq")).withColumn("_o", -F.col("old"))
    return number_rows(d, ["_l", "_o"]).drop("_l", "_o")


def steps(approx_id: float, linear_only: bool = False) -> list[tuple[str, bool]]:
    """Rounds (sensitivity, linear) for an identity threshold; linear rounds come first."""
    out = [("faster", True)]
    if approx_id < 90:
        out.append(("fast", True))
    if approx_id < 80:
        out.append(("default", True))
    if not linear_only:
        out.append(("default" if approx_id < 80 else "fast", False))
        if approx_id < 50:
            out.append(("more-sensitive", False))
    return out


def round_edges(reps: DataFrame, level: str, linear: bool, approx_id: float, cover: float, mutual: bool, max_evalue: float) -> DataFrame:
    cfg = SearchConfig(sensitivity=level, linear="query" if linear else None, k=0, max_evalue=max_evalue, freq_sd=0 if linear else 50.0, filters={"approx_id": approx_id, "either_cover": cover})
    found = corrected_bits(search(reps, reps, cfg)).select("qid", "tid", "qcovhsp", "scovhsp", F.col("corrected_bitscore").alias("weight"))
    return graph.cover_edges(found, cover, mutual)


def cluster(seqs: DataFrame, approx_id: float = 50.0, cover: float = 80.0, mutual: bool = False, linear_only: bool = False, max_evalue: float = 0.001, rounds: list[tuple[str, bool]] | None = None) -> DataFrame:
    """(rep, member): cascaded clustering. Representatives of a round are the sequences of the next."""
    reps = cut_lineage(seqs.select("oid", "seq"))
    mapping = None
    for level, linear in rounds or steps(approx_id, linear_only):
        e = cut_lineage(round_edges(reps, level, linear, approx_id, cover, mutual, max_evalue))
        found = cut_lineage(graph.greedy_vertex_cover(reps.select(F.col("oid").alias("node")), e))
        mapping = found if mapping is None else cut_lineage(graph.compose_rounds(mapping, found))
        reps = cut_lineage(reps.join(found.where("rep = member").select(F.col("rep").alias("oid")), "oid", "left_semi"))
    return mapping.select("rep", "member")


def linclust(seqs: DataFrame, approx_id: float = 90.0, cover: float = 80.0) -> DataFrame:
    return cluster(seqs, approx_id, cover, linear_only=True)


def deepclust(seqs: DataFrame, cover: float = 80.0) -> DataFrame:
    return cluster(seqs, 0.0, cover)


def realign(seqs: DataFrame, clusters: DataFrame, cfg: SearchConfig | None = None) -> DataFrame:
    """Alignments of each member with its representative, in full."""
    cfg = cfg or SearchConfig()
    q, t = seqs.select(F.col("oid").alias("rep"), F.col("seq").alias("qseq")), seqs.select(F.col("oid").alias("member"), F.col("seq").alias("tseq"))
    pairs = clusters.join(q, "rep").join(t, "member").withColumn("qlen", F.length("qseq")).withColumn("slen", F.length("tseq"))
    db = seqs.agg(F.sum(F.length("seq"))).first()[0] or 1
    return align.with_statistics(align.align_pairs(pairs, cfg.gap_open, cfg.gap_extend, cfg.bias), db, cfg.gap_open, cfg.gap_extend)


def reassign(seqs: DataFrame, clusters: DataFrame, cover: float = 80.0) -> DataFrame:
    """(rep, member): each member goes to the representative that covers it with the best score, its own if none does."""
    reps = seqs.join(clusters.select(F.col("rep").alias("oid")).distinct(), "oid", "left_semi")
    found = search(reps, seqs, SearchConfig(k=0)).where(F.col("scovhsp") >= cover).groupBy("tid").agg(F.max_by("qid", F.struct("bitscore", -F.col("qid"))).alias("_best"))
    return clusters.join(found, F.col("member") == F.col("tid"), "left").select(F.when(F.col("rep") == F.col("member"), F.col("rep")).otherwise(F.coalesce("_best", "rep")).alias("rep"), "member")


def read_clusters(spark, path: str, seqs: DataFrame) -> DataFrame:
    """A cluster file (representative TAB member, by id) as (rep, member) numbers; an unknown or missing id is an error."""
    c = spark.read.option("sep", "\t").schema("r string, m string").csv(path).where("r <> 'centroid'")
    ids = seqs.select("id", "oid")
    out = c.join(ids.select(F.col("id").alias("r"), F.col("oid").alias("rep")), "r", "left").join(ids.select(F.col("id").alias("m"), F.col("oid").alias("member")), "m", "left")
    bad = out.where("rep is null or member is null").limit(1).count() or ids.join(out, F.col("oid") == F.col("member"), "left_anti").limit(1).count()
    if bad:
        raise ValueError("The cluster file and the sequences do not name the same accessions")
    return out.select("rep", "member")


def write_clusters(clusters: DataFrame, seqs: DataFrame) -> DataFrame:
    """Text rows `representative TAB member` by id, ordered by representative, then member."""
    ids = seqs.select("oid", "id")
    c = clusters.join(ids.select(F.col("oid").alias("rep"), F.col("id").alias("_r")), "rep").join(ids.select(F.col("oid").alias("member"), F.col("id").alias("_m")), "member")
    return c.orderBy("rep", "member").select(F.concat_ws("\t", "_r", "_m").alias("value"))


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("rep").agg(F.count("*").alias("members"))


def split_rounds(clusters: DataFrame) -> DataFrame:
    """Representatives first in each cluster, then members by number."""
    by = Window.partitionBy("rep").orderBy((F.col("rep") != F.col("member")).cast("int"), "member")
    return clusters.withColumn("place", F.row_number().over(by))
