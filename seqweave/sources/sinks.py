"""Output fields and formats of alignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_FIELDS = ["qseqid", "sseqid", "pident", "length", "mismatch", "gapopen", "qstart", "qend", "sstart", "send", "evalue", "bitscore"]


def render_evalue(e: Column) -> Column:
    return F.when(e == 0, F.lit("0.0")).otherwise(F.format_string("%.2e", e))


def render_number(x: Column) -> Column:
    """Whole numbers from 100 up, else one decimal, half away from zero."""
    return F.when(x >= 100, F.format_string("%d", F.floor(x).cast("long"))).otherwise(F.format_string("%.1f", F.round(x, 1)))


#: How fields that are not plain columns are made.
FIELDS = {
    "evalue": lambda: render_evalue(F.col("evalue")),
    "bitscore": lambda: render_number(F.col("bitscore")),
    "pident": lambda: F.format_string("%.1f", F.round("pident", 1)),
    "ppos": lambda: F.format_string("%.1f", F.round("ppos", 1)),
    "qcovhsp": lambda: F.format_string("%.1f", F.round("qcovhsp", 1)),
    "scovhsp": lambda: F.format_string("%.1f", F.round("scovhsp", 1)),
    "approx_pident": lambda: F.format_string("%.1f", F.round("approx_pident", 1)),
    "corrected_bitscore": lambda: F.format_string("%.1f", F.round("corrected_bitscore", 1)),
    "normalized_bitscore": lambda: F.format_string("%f", F.col("bitscore") / F.greatest("qself_bits", "sself_bits")),
    "normalized_bitscore_query": lambda: F.format_string("%f", F.col("bitscore") / F.col("qself_bits")),
    "normalized_nident": lambda: F.format_string("%f", F.col("nident") / F.greatest("qlen", "slen")),
    "qstrand": lambda: F.when(F.col("qframe") < 0, F.lit("-")).otherwise(F.lit("+")),
    "qseq": lambda: F.substring(F.col("full_qseq"), F.least("qstart", "qend"), F.abs(F.col("qend") - F.col("qstart")) + 1),
    "sseq": lambda: F.substring(F.col("full_sseq"), F.col("sstart"), F.col("send") - F.col("sstart") + 1),
    "sallseqid": lambda: F.array_join(F.transform(F.split("stitle", r"\x01"), lambda t: F.regexp_extract(t, r"^(\S*)", 1)), ";"),
    "salltitles": lambda: F.replace(F.col("stitle"), F.lit("\x01"), F.lit("<>")),
    "staxids": lambda: F.array_join(F.transform("staxids", lambda t: t.cast("string")), ";"),
}

UNALIGNED_NUMBERS = {"qstart", "qend", "sstart", "send", "length", "mismatch", "gapopen", "pident", "evalue", "bitscore", "score", "slen", "nident", "positive", "gaps"}

NUMBERS = UNALIGNED_NUMBERS | {"qlen", "mismatch", "ppos", "qcovhsp", "scovhsp", "approx_pident", "corrected_bitscore", "normalized_bitscore", "normalized_bitscore_query", "normalized_nident", "qframe", "rank"}


def field(name: str) -> Column:
    return FIELDS[name]() if name in FIELDS else F.col(name)


def project(hsps: DataFrame, fields: list[str] | None = None) -> DataFrame:
    return hsps.select(*[field(f).cast("string").alias(f) for f in fields or DEFAULT_FIELDS])


def tabular(hsps: DataFrame, fields: list[str] | None = None, header: str | None = None) -> DataFrame:
    """One text row a line, fields between TABs."""
    fields = fields or DEFAULT_FIELDS
    lines = project(hsps, fields).select(F.concat_ws("\t", *[F.coalesce(f, F.lit("N/A")) for f in fields]).alias("value"))
    if header:
        title = "\t".join(fields) if header == "simple" else f"# Fields: {', '.join(fields)}"
        return hsps.sparkSession.range(1).select(F.lit(title).alias("value")).union(lines)
    return lines


def with_unaligned(hsps: DataFrame, queries: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Tabular rows, and one placeholder row for each query without a hit: -1 for numbers, * for the rest."""
    fields = fields or DEFAULT_FIELDS
    rest = queries.join(hsps.select(F.col("qid").alias("oid")).distinct(), "oid", "left_anti")
    blank = [F.col("id").alias(f) if f == "qseqid" else F.lit("-1" if f in UNALIGNED_NUMBERS else "*").alias(f) for f in fields]
    return project(hsps, fields).union(rest.select(*blank))


def json_flat(hsps: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """One JSON object a line; fields that are numbers are bare, others are strings."""
    fields = fields or DEFAULT_FIELDS

    def member(f: str) -> Column:
        quoted = F.regexp_extract(F.to_json(F.struct(F.col(f).alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)
        number = F.col(f).rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][-+]?[0-9]+)?$") if f in NUMBERS else F.lit(False)
        return F.concat(F.lit(f'"{f}":'), F.when(number, F.col(f)).otherwise(quoted))

    present = [F.when(F.col(f).isNotNull(), member(f)) for f in fields]  # a null has no member
    return project(hsps, fields).select(F.concat(F.lit("{"), F.concat_ws(",", *present), F.lit("}")).alias("value"))


def paf(hsps: DataFrame) -> DataFrame:
    return hsps.select(F.concat_ws("\t", "qseqid", "qlen", F.col("qstart") - 1, F.col("qend") - 1, F.lit("+"), "sseqid", "slen", F.col("sstart") - 1, F.col("send") - 1, "nident", "length", F.lit("255"), F.format_string("AS:i:%d", F.floor("bitscore").cast("long")), F.format_string("ZR:i:%d", "score"), F.concat(F.lit("ZE:f:"), render_evalue(F.col("evalue")))).alias("value"))


def mismatch_runs(btop: Column) -> Column:
    """The MD string of a transcript: runs of identities, letters of the target where it differs, ^ before deleted ones."""
    tokens = F.regexp_extract_all(btop, F.lit(r"[0-9]+|[A-Z*_-]{2}"), F.lit(0))
    start = F.struct(F.lit("").alias("s"), F.lit(0).alias("n"), F.lit(False).alias("deleted"))

    def step(acc: Column, tok: Column) -> Column:
        q, t = F.substring(tok, 1, 1), F.substring(tok, 2, 1)
        told = F.concat(acc["s"], acc["n"].cast("string"))
        state = lambda s, n, deleted: F.struct(s.alias("s"), n.alias("n"), deleted.alias("deleted"))
        deletion = F.when(acc["deleted"] & (acc["n"] == 0), F.concat(acc["s"], t)).otherwise(F.concat(told, F.lit("^"), t))
        return (
            F.when(tok.rlike("^[0-9]+$"), state(acc["s"], (acc["n"] + F.coalesce(tok.try_cast("int"), F.lit(0))), acc["deleted"]))
            .when(t == "-", acc)
            .when(q == "-", state(deletion, F.lit(0), F.lit(True)))
            .otherwise(state(F.concat(told, t), F.lit(0), F.lit(False)))
        )

    return F.aggregate(tokens, start, step, lambda acc: F.concat(acc["s"], acc["n"].cast("string")))


def sam(hsps: DataFrame, reference: bool = True) -> DataFrame:
    """SAM lines."""
    md = mismatch_runs(F.col("btop"))
    line = F.concat_ws("\t", "qseqid", F.lit("0"), "sseqid", "sstart", F.lit("255"), "cigar", F.lit("*"), F.lit("0"), F.lit("0"), F.substring(F.col("full_qseq"), F.col("qstart"), F.col("qend") - F.col("qstart") + 1), F.lit("*"), F.format_string("AS:i:%d", F.floor("bitscore").cast("long")), F.format_string("NM:i:%d", F.col("length") - F.col("nident")), F.format_string("ZL:i:%d", "slen"), F.format_string("ZR:i:%d", "score"), F.concat(F.lit("ZE:f:"), render_evalue(F.col("evalue"))), F.format_string("ZI:i:%d", F.floor("pident").cast("long")), F.lit("ZF:i:1"), F.format_string("ZS:i:%d", "qstart"), F.concat(F.lit("MD:Z:"), md))
    lines = hsps.select(line.alias("value"))
    if not reference:
        return lines
    head = hsps.sparkSession.range(1).select(F.explode(F.array(F.lit("@HD\tVN:1.5\tSO:query"), F.lit("@mm\tProtein"))).alias("value"))
    return head.union(lines)


def _gapped(seq: str, begin: str, other: bool) -> Column:
    """Aligned letters of one side, from the transcript: runs of identities take letters, pairs take the side's letter."""
    tokens = F.regexp_extract_all("btop", F.lit(r"[0-9]+|[A-Z*_-]{2}"), F.lit(0))
    side = 2 if other else 1
    start = F.struct(F.lit("").alias("s"), F.col(begin).cast("int").alias("p"))

    def step(acc: Column, tok: Column) -> Column:
        n = F.try_to_number(tok, F.lit("999999999")).cast("int")
        letter = F.substring(tok, side, 1)
        run = F.struct(F.concat(acc["s"], F.substring(F.col(seq), acc["p"], n)).alias("s"), (acc["p"] + n).alias("p"))
        pair = F.struct(F.concat(acc["s"], letter).alias("s"), (acc["p"] + F.when(letter == "-", 0).otherwise(1)).alias("p"))
        return F.when(tok.rlike("^[0-9]+$"), run).otherwise(pair)

    return F.aggregate(tokens, start, step, lambda acc: acc["s"])


def gapped(hsps: DataFrame) -> DataFrame:
    return hsps.withColumn("qseq_gapped", _gapped("full_qseq", "qstart", False)).withColumn("sseq_gapped", _gapped("full_sseq", "sstart", True))


def pairwise(hsps: DataFrame, width: int = 60) -> DataFrame:
    """BLAST-like blocks: one text row an HSP."""
    g = gapped(hsps)
    mid = F.array_join(F.zip_with(F.split("qseq_gapped", ""), F.split("sseq_gapped", ""), lambda a, b: F.when((a == b) & (a != "-"), a).otherwise(F.lit(" "))), "")
    g = g.withColumn("_mid", mid)
    blocks = F.transform(F.sequence(F.lit(0), F.length("qseq_gapped") - 1, F.lit(width)), lambda o: F.concat(F.lit("Query  "), F.substring("qseq_gapped", o + 1, F.lit(width)), F.lit("\n       "), F.substring("_mid", o + 1, F.lit(width)), F.lit("\nSbjct  "), F.substring("sseq_gapped", o + 1, F.lit(width)), F.lit("\n")))
    head = F.format_string("Query= %s\n\n>%s\nLength=%d\n\n Score = %.1f bits (%d), Expect = %s\n Identities = %d/%d, Gaps = %d/%d\n\n", "qseqid", "sseqid", "slen", "bitscore", "score", render_evalue(F.col("evalue")), "nident", "length", "gaps", "length")
    return g.select(F.concat(head, F.array_join(blocks, "\n")).alias("value"))


def xml(hsps: DataFrame) -> DataFrame:
    """One Iteration element a query, with hits and HSPs nested in rank order."""
    safe = lambda c: F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value.cast("string"), F.lit(f"</{name}>"))
    c = F.col
    hsp = F.concat(F.lit("<Hsp>"), tag("Hsp_num", c("hspnum")), tag("Hsp_bit-score", c("bitscore")), tag("Hsp_score", c("score")), tag("Hsp_evalue", render_evalue(c("evalue"))), tag("Hsp_query-from", c("qstart")), tag("Hsp_query-to", c("qend")), tag("Hsp_hit-from", c("sstart")), tag("Hsp_hit-to", c("send")), tag("Hsp_identity", c("nident")), tag("Hsp_positive", c("positive")), tag("Hsp_gaps", c("gaps")), tag("Hsp_align-len", c("length")), F.lit("</Hsp>"))
    hits = hsps.select("qid", safe("qseqid").alias("qseqid"), "qlen", "rank", "tid", safe("sseqid").alias("sseqid"), "slen", F.struct("hspnum", hsp.alias("x")).alias("h"))
    hit = hits.groupBy("qid", "qseqid", "qlen", "rank", "tid", "sseqid", "slen").agg(F.array_join(F.transform(F.array_sort(F.collect_list("h")), lambda h: h["x"]), "").alias("x"))
    hit = hit.select("qid", "qseqid", "qlen", F.struct("rank", F.concat(F.lit("<Hit>"), tag("Hit_num", c("rank")), tag("Hit_id", c("sseqid")), tag("Hit_len", c("slen")), F.lit("<Hit_hsps>"), c("x"), F.lit("</Hit_hsps></Hit>")).alias("x")).alias("h"))
    one = hit.groupBy("qid", "qseqid", "qlen").agg(F.array_join(F.transform(F.array_sort(F.collect_list("h")), lambda h: h["x"]), "").alias("x"))
    return one.select("qid", F.concat(F.lit("<Iteration>"), tag("Iteration_iter-num", c("qid") + 1), tag("Iteration_query-def", c("qseqid")), tag("Iteration_query-len", c("qlen")), F.lit("<Iteration_hits>"), c("x"), F.lit("</Iteration_hits></Iteration>")).alias("value"))


def taxon(hsps: DataFrame, seq_tax: DataFrame, nodes: DataFrame) -> DataFrame:
    """(qid, lca, evalue): lowest common ancestor of the targets' taxa and the best e-value of each query."""
    from seqweave.operators import taxonomy

    rows = hsps.join(seq_tax.withColumnRenamed("oid", "tid"), "tid", "left").select("qid", "taxid", "evalue")
    return taxonomy.lca(rows, nodes, "qid").join(rows.groupBy("qid").agg(F.min("evalue").alias("evalue")), "qid")


def edges(hsps: DataFrame) -> DataFrame:
    return hsps.select("qid", "tid", "qcovhsp", "scovhsp", F.col("corrected_bitscore").alias("weight"))


def merge_archives(archives: list[DataFrame]) -> DataFrame:
    """HSP archives as one; targets are named by accession, so equal ones fall together."""
    out = archives[0]
    for a in archives[1:]:
        out = out.unionByName(a)
    ids = out.select("sseqid").distinct().withColumn("_t", F.xxhash64("sseqid"))
    return out.join(ids, "sseqid").withColumn("tid", F.col("_t")).drop("_t")


def write_archive(hsps: DataFrame, path: str | None = None) -> str:
    """All HSP columns as Parquet; without a path, below the session's shared folder."""
    import uuid

    from seqweave.plans.scratch import shared_folder

    path = path or f"{shared_folder(hsps.sparkSession)}/archive-{uuid.uuid4().hex}"
    hsps.write.parquet(path)
    return path


def view(spark, path: str, fields: list[str] | None = None, k: int | None = None, top: float | None = None) -> DataFrame:
    """An archive's HSPs as output fields, ranked again if k or top is given."""
    from seqweave.operators import ranking

    h = spark.read.parquet(path)
    if top is not None:
        h = ranking.top_percent(h, top)
    if k:
        h = ranking.top_targets(h.drop("rank"), k)
    return project(h, fields)
