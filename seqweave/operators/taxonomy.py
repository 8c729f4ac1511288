"""Taxonomy: lineage, ranks, lowest common ancestors and filters over a tree table nodes(taxid, parent, rank)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqweave.plans.scratch import cut_lineage

# The ranks of the public taxonomy.
RANKS = (
    "no rank,superkingdom,cellular root,acellular root,domain,realm,kingdom,subkingdom,superphylum,phylum,subphylum,superclass,class,"
    "subclass,infraclass,cohort,subcohort,superorder,order,suborder,infraorder,parvorder,superfamily,family,subfamily,tribe,subtribe,"
    "genus,subgenus,section,subsection,series,species group,species subgroup,species,subspecies,varietas,forma,strain,biotype,clade,"
    "forma specialis,genotype,isolate,morph,pathogroup,serogroup,serotype,subvariety"
).split(",")


def check_ranks(nodes: DataFrame) -> DataFrame:
    known = F.col("rank").isin(*RANKS)
    return nodes.withColumn("rank", F.when(known, F.col("rank")).otherwise(F.raise_error(F.concat(F.lit("Invalid taxonomic rank: "), F.col("rank")))))


def ancestors(nodes: DataFrame, most: int = 64) -> DataFrame:
    """(taxid, ancestor, depth): each taxon with itself at depth 0 and its ancestors; the root is its own parent.

    Pointer doubling: round k joins paths of 2**k steps, so 64 levels take six joins.
    """
    known = nodes.select("taxid", F.when(F.col("parent") != F.col("taxid"), F.col("parent")).alias("parent"))
    paths = known.select("taxid", F.col("taxid").alias("ancestor"), F.lit(0).alias("depth"))
    step = known.where("parent is not null").select("taxid", "parent")
    paths = paths.union(step.select("taxid", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")))
    reach = 1
    while reach < most:
        far = paths.where(F.col("depth") == reach).select(F.col("taxid").alias("_t"), F.col("ancestor").alias("_m"))
        if not far.limit(1).count():
            break
        more = far.join(paths.where("depth > 0"), F.col("_m") == F.col("taxid")).select(F.col("_t").alias("taxid"), "ancestor", (F.col("depth") + reach).alias("depth"))
        paths = cut_lineage(paths.union(more).distinct())
        reach *= 2
    return paths.where(F.col("depth") < most)


def lineages(nodes: DataFrame) -> DataFrame:
    """(taxid, lineage): ids from below the root to the taxon; empty if a parent on the way is unknown."""
    a = ancestors(nodes)
    roots = nodes.where((F.col("parent") == F.col("taxid")) | F.col("parent").isNull()).select(F.col("taxid").alias("ancestor"))
    whole = a.join(roots, "ancestor", "left_semi").select("taxid").distinct()
    path = a.join(roots, "ancestor", "left_anti").groupBy("taxid").agg(F.transform(F.sort_array(F.collect_list(F.struct("depth", "ancestor")), asc=False), lambda x: x["ancestor"]).alias("lineage"))
    empty = F.array().cast(f"array<{nodes.schema['taxid'].dataType.simpleString()}>")
    return nodes.select("taxid").join(whole.withColumn("_w", F.lit(True)), "taxid", "left").join(path, "taxid", "left").select("taxid", F.when(F.col("_w"), F.coalesce("lineage", empty)).otherwise(empty).alias("lineage"))


def at_rank(nodes: DataFrame, rank: str) -> DataFrame:
    """(taxid, ancestor): the nearest ancestor of a rank, 0 if there is none."""
    named = nodes.where(F.col("rank") == rank).select(F.col("taxid").alias("ancestor"))
    best = ancestors(nodes).join(named, "ancestor").groupBy("taxid").agg(F.min_by("ancestor", "depth").alias("ancestor"))
    return nodes.select("taxid").join(best, "taxid", "left").select("taxid", F.coalesce("ancestor", F.lit(0)).alias("ancestor"))


def lca(rows: DataFrame, nodes: DataFrame, key: str, taxid: str = "taxid") -> DataFrame:
    """(key, lca): lowest common ancestor of each key's taxa; unknown ids are ignored, no known id gives 0.

    An ancestor common to all taxa of a key is counted as often as the key has taxa; the deepest such is the result. This
    aggregates in parts, whatever the size of a key.
    """
    ids = rows.select(key, F.col(taxid).alias("taxid")).distinct().join(nodes.select("taxid"), "taxid", "left_semi")
    a = ancestors(nodes)
    level = a.groupBy("taxid").agg(F.max("depth").alias("level")).withColumnRenamed("taxid", "ancestor")
    n = ids.groupBy(key).agg(F.count("*").alias("_n"))
    common = ids.join(a, "taxid").groupBy(key, "ancestor").agg(F.count("*").alias("_c")).join(n, key).where("_c = _n").join(level, "ancestor")
    best = common.groupBy(key).agg(F.max_by("ancestor", "level").alias("lca"))
    return rows.select(key).distinct().join(best, key, "left").select(key, F.coalesce("lca", F.lit(0)).alias("lca"))


def descendants(nodes: DataFrame, roots: list[int]) -> DataFrame:
    if any(r in (0, 1) for r in roots):
        raise ValueError("Invalid taxonomy ID: 0 and 1 cannot be filtered by")
    return ancestors(nodes).where(F.col("ancestor").isin(*roots)).select("taxid").distinct()


def include_taxa(seqs: DataFrame, seq_tax: DataFrame, nodes: DataFrame, roots: list[int]) -> DataFrame:
    """Sequences any of whose taxa lies under the list; those without a taxon go. seq_tax: (oid, taxid)."""
    return seqs.join(seq_tax.join(descendants(nodes, roots), "taxid", "left_semi").select("oid").distinct(), "oid", "left_semi")


def exclude_taxa(seqs: DataFrame, seq_tax: DataFrame, nodes: DataFrame, roots: list[int]) -> DataFrame:
    """Sequences with a taxon that is known and not under the list; all of those without a taxon go too."""
    outside = seq_tax.join(nodes.select("taxid"), "taxid", "left_semi").join(descendants(nodes, roots), "taxid", "left_anti")
    return seqs.join(outside.select("oid").distinct(), "oid", "left_semi")


def names(rows: DataFrame, table: DataFrame, taxid: str = "taxid") -> DataFrame:
    """rows with `name`: the scientific name, or the id as text."""
    t = table.select(F.col("taxid").alias("_t"), F.col("name").alias("_name"))
    return rows.join(t, F.col(taxid) == F.col("_t"), "left").withColumn("name", F.coalesce("_name", F.col(taxid).cast("string"))).drop("_t", "_name")
