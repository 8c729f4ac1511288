"""Six-frame translation of DNA and open reading frame masking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqweave.functions import alphabet


def six_frames(dna: DataFrame, code: int = 1, strand: str = "both") -> DataFrame:
    """(oid, frame, seq, source_len): frames 0 to 2 forward, 3 to 5 of the reverse complement."""
    first, last = {"plus": (0, 2), "minus": (3, 5), "both": (0, 5)}[strand]
    d = dna.select("oid", F.upper("seq").alias("_s"), F.explode(F.sequence(F.lit(first), F.lit(last))).alias("frame"))
    base = F.when(F.col("frame") < 3, F.col("_s")).otherwise(alphabet.reverse_complement(F.col("_s")))
    frame = F.substring(base, F.pmod("frame", F.lit(3)) + 1, F.length("_s"))
    return d.select("oid", "frame", alphabet.translate_codons(frame, code).alias("seq"), F.length("_s").alias("source_len"))


def least_orf(frame_len: Column, frameshift: bool = False) -> Column:
    """Least open reading frame by length of the translated frame."""
    return F.when((frame_len < 30) | F.lit(frameshift), F.lit(1)).when(frame_len < 100, F.lit(20)).otherwise(F.lit(40))


def mask_orfs(frames: DataFrame, min_orf: int | None = None) -> DataFrame:
    """frames with stretches between stops that are shorter than the least length masked by X; stops stay."""
    least = F.lit(min_orf) if min_orf else least_orf(F.length("seq"))
    parts = F.transform(F.split("seq", r"\*", -1), lambda p: F.when(F.length(p) < least, F.repeat(F.lit("X"), F.length(p))).otherwise(p))
    return frames.withColumn("seq", F.array_join(parts, "*"))


def query_coordinates(hsps: DataFrame) -> DataFrame:
    """HSPs on frames (qstart, qend in residues) with begin and end in the source DNA, 1-based; reverse frames run down."""
    shift, n = F.pmod("frame", F.lit(3)), F.col("source_len")
    a, b = (F.col("qstart") - 1) * 3 + shift + 1, F.col("qend") * 3 + shift
    reverse = F.col("frame") >= 3
    return hsps.withColumn("_a", a).withColumn("_b", b).withColumn("qstart", F.when(reverse, n - F.col("_a") + 1).otherwise(F.col("_a"))).withColumn("qend", F.when(reverse, n - F.col("_b") + 1).otherwise(F.col("_b"))).drop("_a", "_b").withColumn("qframe", F.when(reverse, -(F.col("frame") - 2)).otherwise(F.col("frame") + 1))
