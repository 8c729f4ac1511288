"""Shared-folder scratch tables, id helpers and connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; everything else belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share; a temporary one only where the session names none and runs on this machine (tests)."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="seqweave-")
    return _own_dir


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Let this session's Arrow batches hold at most 8 MB, or one row: by rows alone, batches of long texts fill a worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(name)).lower().rstrip("b")
    if not now.isdigit() or int(now) > most:
        spark.conf.set(name, str(most))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _forget_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _forget_at_exit(spark: SparkSession, path: str) -> None:
    def gone() -> None:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended; the folder's owner sweeps it
            pass

    atexit.register(gone)


def aside(docs: DataFrame, known: tuple[str, ...], work) -> DataFrame:
    """work(docs) of a step that returns the columns of docs; all but the known ones stand under names of their own meanwhile,
    so that none clashes with a working column."""
    names = docs.columns
    return work(docs.toDF(*(c if c in known else f"c{k}" for k, c in enumerate(names)))).toDF(*names)


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, body) -> Column:
    """Bind value once for use inside body: a plain alias would be inlined and evaluated for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold_of(doc_id: Column, folds: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of an edge list; component is the smallest reachable node.

    Alternating large-star and small-star: a logarithmic number of rounds, each two joins and two minima, so no
    group is gathered anywhere; a hub's rows are split by adaptive skew handling.
    """
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e, before = materialize(e, "cc"), None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        small = small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        e = materialize(small.distinct(), "cc")
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
