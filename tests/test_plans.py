import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from seqweave.functions import scores
from seqweave.plans import cluster, registry
from seqweave.plans.search import SearchConfig, exhaustive_search, iterated_search, search, translated_search
from seqweave.sources import files, sinks

SF = "/root/testdata/sf0.001"


def protein(rng, n):
    return "".join(rng.choice(scores.RESIDUES) for _ in range(n))


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(8)
    targets = [protein(rng, 200) for _ in range(20)]
    near = list(targets[3])
    for k in range(0, 200, 17):
        near[k] = rng.choice(scores.RESIDUES)
    queries = [targets[0], "".join(near), protein(rng, 150)]
    make = lambda rows, name: spark.createDataFrame([(i, f"{name}{i}", s) for i, s in enumerate(rows)], "oid long, id string, seq string")
    return make(queries, "q"), make(targets, "t")


def test_search_finds_relatives(world):
    q, t = world
    got = search(q, t).orderBy("qid", "rank").collect()
    assert [(r["qid"], r["tid"]) for r in got] == [(0, 0), (1, 3)]
    assert got[0]["pident"] == 100 and got[0]["cigar"] == "200M" and got[0]["evalue"] < 1e-80


def test_search_aligns_every_hit_of_a_pair(spark):
    rng = random.Random(18)
    p = protein(rng, 160)
    target = protein(rng, 30) + p[:60] + protein(rng, 700) + p + protein(rng, 500) + p[20:140]
    q = spark.createDataFrame([(0, p)], "oid long, seq string")
    t = spark.createDataFrame([(0, target)], "oid long, seq string")
    (best,) = search(q, t).collect()
    whole = target.index(p)
    assert (best["qstart"], best["qend"], best["sstart"], best["send"]) == (1, 160, whole + 1, whole + 160)
    three = search(q, t, SearchConfig(max_hsps=3)).orderBy("hspnum").collect()
    assert [(r["hspnum"], r["sstart"] // 100) for r in three] == [(1, (whole + 1) // 100), (2, (len(target) - 119) // 100), (3, 0)]
    assert three[0]["score"] == max(r["score"] for r in exhaustive_search(q, t).collect())


def test_exhaustive_agrees(world):
    q, t = world
    cfg = SearchConfig(margin=0)
    a = {(r["qid"], r["tid"], r["score"]) for r in exhaustive_search(q, t, cfg).collect()}
    b = {(r["qid"], r["tid"], r["score"]) for r in search(q, t, cfg).collect()}
    assert b <= a and {(x, y) for x, y, _ in a} == {(0, 0), (1, 3)}


def test_iterated_search(world):
    q, t = world
    got = iterated_search(q, t, SearchConfig(sensitivity="default"))
    assert {(r["qid"], r["tid"]) for r in got.collect()} == {(0, 0), (1, 3)}


def test_formats(world):
    q, t = world
    h = search(q, t).withColumn("rank", F.col("rank"))
    line = sinks.tabular(h.where("qid = 0")).first()["value"].split("\t")
    assert line[:4] == ["q0", "t0", "100.0", "200"] and len(line) == 12
    assert sinks.paf(h).first()["value"].split("\t")[4] == "+"
    assert "AS:i:" in sinks.sam(h, reference=False).first()["value"]
    assert sinks.json_flat(h).first()["value"].startswith('{"qseqid"')
    assert "<Hit_id>t0</Hit_id>" in sinks.xml(h.where("qid = 0")).first()["value"]
    g = sinks.gapped(h.where("qid = 1")).first()
    assert len(g["qseq_gapped"]) == len(g["sseq_gapped"]) == g["length"]
    assert "Query  " in sinks.pairwise(h).first()["value"]
    rows = sinks.with_unaligned(h, q).collect()
    assert any(r["qseqid"] == "q2" and r["sseqid"] == "*" and r["qstart"] == "-1" for r in rows)


def test_translated_search(spark, world):
    _, t = world
    from seqweave.functions.alphabet import GENETIC_CODES

    order, code = "TCAG", GENETIC_CODES[1]
    codon = {code[16 * i + 4 * j + k]: a + b + c for i, a in enumerate(order) for j, b in enumerate(order) for k, c in enumerate(order)}
    target = t.where("oid = 5").first()["seq"]
    dna = "G" + "".join(codon[c] for c in target)
    back = dna[::-1].translate(str.maketrans("ACGT", "TGCA"))
    d = spark.createDataFrame([(0, dna), (1, back)], "oid long, seq string")
    got = {r["qid"]: (r["tid"], r["qframe"], r["qstart"], r["qend"]) for r in translated_search(d, t).collect()}
    assert got == {0: (5, 2, 2, 601), 1: (5, -2, 600, 1)}


def test_linclust(spark):
    rng = random.Random(4)
    a, b = protein(rng, 180), protein(rng, 120)
    rows = [a, a[:170], a[5:], b, b[:118], protein(rng, 90)]
    d = spark.createDataFrame(list(enumerate(rows)), "oid long, seq string")
    got = {r["member"]: r["rep"] for r in cluster.linclust(d).collect()}
    groups = {frozenset(k for k, v in got.items() if v == r) for r in set(got.values())}
    assert groups == {frozenset({0, 1, 2}), frozenset({3, 4}), frozenset({5})}
    lines = cluster.realign(d, spark.createDataFrame([(0, 1)], "rep long, member long")).collect()
    assert lines[0]["pident"] == 100 and lines[0]["length"] == 170


def test_fasta_round_trip(spark, tmp_path):
    p = tmp_path / "a.fasta"
    p.write_text(">s1 first\r\nACDE\r\nFGHI\r\n>s2\nWWWW\n>\nAAU\n")
    got = [(r["oid"], r["id"], r["seq"], r["len"]) for r in files.read_sequences(spark, str(p)).orderBy("oid").collect()]
    assert got == [(0, "s1", "ACDEFGHI", 8), (1, "s2", "WWWW", 4), (2, "N/A", "AAX", 3)]
    files.write_fasta(files.read_fasta(spark, str(p)), str(tmp_path / "out"))
    again = files.read_fasta(spark, str(tmp_path / "out"))
    assert {r["seq"] for r in again.collect()} == {"ACDEFGHI", "WWWW", "AAX"}


def test_fastq(spark, tmp_path):
    p = tmp_path / "a.fastq"
    p.write_text("@r1 x\nACGT\n+\n@III\n@r2\nGGNN\n+r2\nIIII\n")
    got = [(r["id"], r["seq"], r["qual"]) for r in files.read_sequences(spark, str(p)).orderBy("oid").collect()]
    assert got == [("r1", "ACGT", "@III"), ("r2", "GGNN", "IIII")]


def test_dna_guard(spark, tmp_path):
    p = tmp_path / "d.fasta"
    p.write_text("".join(f">s{i}\nACGT\n" for i in range(10)))
    with pytest.raises(ValueError, match="DNA"):
        files.read_fasta(spark, str(p))


def test_make_db_and_filters(spark, tmp_path):
    rows = spark.createDataFrame([(0, "P1.1", "P1.1 one\x01P9.2 also", "ACDEFGHIKL", 10), (1, "P2.1", "P2.1 two", "WWWW", 4)], "oid long, id string, title string, seq string, len int")
    tax = spark.createDataFrame([("P9", 7), ("P2.3", 8)], "accession string, taxid long")
    db = files.make_db(rows, str(tmp_path / "x.db"), tax)
    assert files.db_info(db).first()["letters"] == 14
    assert {(r["oid"], r["taxid"]) for r in spark.read.parquet(str(tmp_path / "x.db/seq_tax")).collect()} == {(0, 7), (1, 8)}
    ids = spark.createDataFrame([("P9.2",)], "id string")
    assert [r["oid"] for r in files.filter_ids(rows, ids).collect()] == [0]
    with pytest.raises(ValueError):
        files.filter_ids(rows, spark.createDataFrame([("none",)], "id string"))
    assert [r["seq"] for r in files.get_seqs(rows, ordinals=[2], reverse=True).collect()] == ["WWWW"]


def test_stream_equals_batch(spark, world, tmp_path):
    from seqweave.streaming.stream_search import stream_search

    q, t = world
    q.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(q.schema).parquet(str(tmp_path / "in"))
    stream_search(stream, t, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {(r["qid"], r["tid"]) for r in got.collect()} == {(0, 0), (1, 3)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name", ["seq_stats", "kmer_topn", "seed_join", "hamming_window_filter", "topk_targets", "connected_components", "lca", "block_partition_letters", "search_topk", "self_scores", "mask_seg", "range_cull"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "orders", "documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = con.execute(registry.ORACLE_SQL[name]).fetchdf()
    got = registry.QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    key = lambda df: sorted(map(tuple, df[columns].astype(str).to_numpy()))
    assert key(got) == key(want)
