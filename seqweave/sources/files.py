"""Sequence files: FASTA and FASTQ readers and writers, and the Parquet data base."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqweave.functions import alphabet


def number_rows(df: DataFrame, order: list, start: int = 0) -> DataFrame:
    """df with `oid`: consecutive numbers in an order, without gathering rows in one task.

    Rows are range-partitioned and sorted; the counts of the partitions, one number each, give each its offset.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    from seqweave.plans.scratch import cut_lineage

    ordered = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id())
    ordered = cut_lineage(ordered)
    sizes = ordered.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_k").alias("_first"))
    before = sizes.select("_p", "_first", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return ordered.join(F.broadcast(before), "_p").withColumn("oid", F.col("_k") - F.col("_first") + F.col("_before") + start).drop("_p", "_k", "_first", "_before")


def read_fasta(spark: SparkSession, path: str, kind: str = "protein", check: bool = True) -> DataFrame:
    """(oid, id, title, seq, len) of FASTA files (also .gz), records split by the reader at '\\n>'."""
    rows = spark.read.option("lineSep", "\n>").text(path).withColumn("_f", F.col("_metadata.file_path")).withColumn("_at", F.monotonically_increasing_id())
    rows = rows.withColumn("value", F.regexp_replace(F.regexp_replace("value", r"\r", ""), "^>", "")).where(F.length(F.trim("value")) > 0)
    cut = F.instr("value", "\n")
    title = alphabet.clean_title(F.when(cut > 0, F.substring(F.col("value"), F.lit(1), cut - 1)).otherwise(F.col("value")))
    body = F.when(cut > 0, F.substring(F.col("value"), cut + 1, F.length("value"))).otherwise(F.lit(""))
    clean = alphabet.clean_protein if kind == "protein" else alphabet.clean_dna
    seqs = rows.select("_f", "_at", title.alias("title"), clean(body).alias("seq"))
    out = number_rows(seqs, ["_f", "_at"]).select("oid", alphabet.seqid_of(F.col("title")).alias("id"), "title", "seq", F.length("seq").alias("len"))
    if check and kind == "protein":
        looks_like_dna(out)
    return out


def looks_like_dna(seqs: DataFrame, n: int = 10) -> None:
    """An error if each of the first n sequences is all ACGTN; fewer than n are not judged."""
    first = seqs.orderBy("oid").limit(n).agg(F.count("*").alias("n"), F.min(F.col("seq").rlike("^[ACGTN]+$").cast("int")).alias("d")).first()
    if first["n"] >= n and first["d"] == 1:
        raise ValueError("The sequences are expected to be proteins but only contain DNA letters.")


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(oid, id, title, seq, len, qual) of four-line FASTQ records."""
    rows = spark.read.option("lineSep", "\n@").text(path).withColumn("_f", F.col("_metadata.file_path")).withColumn("_at", F.monotonically_increasing_id())
    lines = F.split(F.regexp_replace("value", r"\r", ""), "\n")
    # a quality line may begin with @: such a piece has no separator line and belongs to the record before it
    whole = rows.withColumn("_l", lines).withColumn("_new", (F.size("_l") >= 3).cast("int"))
    by = Window.partitionBy("_f").orderBy("_at")
    whole = whole.withColumn("_r", F.sum("_new").over(by)).groupBy("_f", "_r").agg(F.min("_at").alias("_at"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "value"))), lambda x: x["value"]), "\n@").alias("value"))
    parts = F.split(F.regexp_replace(F.regexp_replace("value", r"\r", ""), "^@", ""), "\n")
    recs = whole.select("_f", "_at", parts.alias("_l")).where(F.size("_l") >= 4)
    recs = recs.select("_f", "_at", alphabet.clean_title(F.get("_l", F.lit(0))).alias("title"), alphabet.clean_dna(F.get("_l", F.lit(1))).alias("seq"), F.get("_l", F.lit(3)).alias("qual"))
    return number_rows(recs, ["_f", "_at"]).select("oid", alphabet.seqid_of(F.col("title")).alias("id"), "title", "seq", F.length("seq").alias("len"), "qual")


def read_sequences(spark: SparkSession, path: str, kind: str = "protein") -> DataFrame:
    """Any source by what it is: a Parquet data base, else FASTA or FASTQ by the first byte."""
    if path.rstrip("/").endswith((".parquet", ".db")):
        return spark.read.parquet(path)
    first = spark.read.text(path).where(F.length("value") > 0).limit(1).first()
    if first and first["value"].startswith(">"):
        return read_fasta(spark, path, kind)
    if first and first["value"].startswith("@"):
        return read_fastq(spark, path)
    raise ValueError("Invalid input file format: neither FASTA nor FASTQ nor a data base")


def read_pairs(spark: SparkSession, first: str, second: str, kind: str = "dna") -> DataFrame:
    """Two files of mates: numbers 2n and 2n + 1."""
    a, b = read_sequences(spark, first, kind), read_sequences(spark, second, kind)
    return a.withColumn("oid", F.col("oid") * 2).unionByName(b.withColumn("oid", F.col("oid") * 2 + 1))


def mates(queries: DataFrame) -> DataFrame:
    m = queries.select(F.col("oid").bitwiseXOR(F.lit(1)).alias("oid"), F.col("seq").alias("mate_seq"))
    return queries.join(m, "oid", "left")


def fasta_lines(seqs: DataFrame, width: int = 0) -> DataFrame:
    """One text row per record."""
    body = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n") if width else F.col("seq")
    return seqs.select(F.concat(F.lit(">"), F.coalesce("title", "id"), F.lit("\n"), body).alias("value"))


def fastq_lines(seqs: DataFrame) -> DataFrame:
    return seqs.select(F.concat(F.lit("@"), F.coalesce("title", "id"), F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.col("qual")).alias("value"))


def write_fasta(seqs: DataFrame, path: str, compression: str | None = None) -> None:
    w = fasta_lines(seqs).write
    (w.option("compression", compression) if compression else w).text(path)


def make_db(seqs: DataFrame, path: str, taxonmap: DataFrame | None = None, nodes: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """Write a data base: sequences with a soft-masked copy, seq_tax, nodes, names. An empty sequence is an error."""
    from seqweave.operators import masking

    checked = seqs.withColumn("seq", F.when(F.length("seq") > 0, F.col("seq")).otherwise(F.raise_error("File format error: sequence of length 0")))
    masking.soft_mask(checked, algorithm="seg").write.mode("overwrite").parquet(f"{path}/sequences")
    db = seqs.sparkSession.read.parquet(f"{path}/sequences")
    if taxonmap is not None:
        acc = db.select("oid", F.explode(F.transform(alphabet.deflines(F.col("title")), lambda t: alphabet.accession(alphabet.seqid_of(t)))).alias("accession"))
        m = taxonmap.select(alphabet.accession(F.col("accession")).alias("accession"), "taxid")
        acc.join(m, "accession").select("oid", "taxid").distinct().write.mode("overwrite").parquet(f"{path}/seq_tax")
    for name, df in (("nodes", nodes), ("names", names)):
        if df is not None:
            df.write.mode("overwrite").parquet(f"{path}/{name}")
    return db


def db_info(seqs: DataFrame) -> DataFrame:
    return seqs.agg(F.count("*").alias("sequences"), F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("letters"), F.max(F.length("seq")).alias("longest"))


def read_taxonmap(spark: SparkSession, path: str) -> DataFrame:
    """accession to taxid from a mapping file; either layout: accession.version, taxid, or four columns with both."""
    t = spark.read.option("header", True).option("sep", "\t").csv(path)
    col = "accession.version" if "accession.version" in t.columns else t.columns[0]
    return t.select(F.col(f"`{col}`").alias("accession"), F.col("taxid").cast("long").alias("taxid"))


def read_dmp(spark: SparkSession, path: str, what: str) -> DataFrame:
    """nodes.dmp as (taxid, parent, rank) or names.dmp as (taxid, name), scientific names only."""
    p = F.split(F.regexp_replace("value", r"\t\|$", ""), r"\t\|\t")
    rows = spark.read.text(path).select(p.alias("p"))
    if what == "nodes":
        return rows.select(F.col("p")[0].cast("long").alias("taxid"), F.col("p")[1].cast("long").alias("parent"), F.col("p")[2].alias("rank"))
    return rows.where(F.col("p")[3] == "scientific name").select(F.col("p")[0].cast("long").alias("taxid"), F.col("p")[1].alias("name"))


def get_seqs(db: DataFrame, ids: DataFrame | None = None, ordinals: list[int] | None = None, reverse: bool = False) -> DataFrame:
    """Records by 1-based ordinal, by an id table (id[, title] gives new titles), or all."""
    out = db
    if ordinals is not None:
        out = out.where(F.col("oid").isin([o - 1 for o in ordinals]))
    if ids is not None:
        t = ids.select(F.col("id").alias("_id"), (F.col("title") if "title" in ids.columns else F.lit(None).cast("string")).alias("_title"))
        out = out.join(t, F.col("id") == F.col("_id")).withColumn("title", F.coalesce("_title", "title")).drop("_id", "_title")
    return out.withColumn("seq", F.reverse("seq")) if reverse else out


def filter_ids(db: DataFrame, ids: DataFrame, skip_missing: bool = False) -> DataFrame:
    """Rows any of whose deflines' accessions is listed; a listed accession that no row has is an error."""
    acc = db.select("oid", F.explode(F.transform(alphabet.deflines(F.col("title")), lambda t: alphabet.seqid_of(t))).alias("id"))
    if not skip_missing:
        gone = ids.select("id").distinct().join(acc, "id", "left_anti").limit(1).collect()
        if gone:
            raise ValueError(f"Accession not found in database: {gone[0]['id']}")
    return db.join(acc.join(ids.select("id").distinct(), "id", "left_semi").select("oid").distinct(), "oid", "left_semi")


def random_sample(db: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n distinct sequences, the same for the same seed."""
    return db.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("oid").cast("string")))).limit(n)


def split_blocks(seqs: DataFrame, letters: int) -> DataFrame:
    """seqs with `block`: blocks of at most about `letters` letters in oid order.

    Letters are summed by runs of ids first; only one row a run meets in the running sum.
    """
    run = F.floor(F.col("oid") / 1024)
    sums = seqs.groupBy(run.alias("_run")).agg(F.sum("len").alias("_n"))
    before = sums.select("_run", F.coalesce(F.sum("_n").over(Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    inside = F.coalesce(F.sum("len").over(Window.partitionBy("_run").orderBy("oid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return seqs.withColumn("_run", run).join(before, "_run").withColumn("block", F.floor((F.col("_b") + inside) / letters)).drop("_run", "_b")
