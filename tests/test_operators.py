import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqweave.functions import scores
from seqweave.operators import align, graph, joins, masking, ranking, seeds, taxonomy


def seqs(spark, rows):
    return spark.createDataFrame([(i, s) for i, s in enumerate(rows)], "oid long, seq string")


def random_protein(rng, n):
    return "".join(rng.choice(scores.RESIDUES) for _ in range(n))


def slow_local(q, t, open_, extend):
    """Affine local score by the plain recurrence."""
    m, low = scores.blosum62(), -(10**9)
    h = [[0] * (len(t) + 1) for _ in range(len(q) + 1)]
    e = [[low] * (len(t) + 1) for _ in range(len(q) + 1)]
    f = [[low] * (len(t) + 1) for _ in range(len(q) + 1)]
    best = 0
    for i in range(1, len(q) + 1):
        for j in range(1, len(t) + 1):
            e[i][j] = max(h[i][j - 1] - open_, e[i][j - 1]) - extend
            f[i][j] = max(h[i - 1][j] - open_, f[i - 1][j]) - extend
            h[i][j] = max(0, h[i - 1][j - 1] + m[q[i - 1], t[j - 1]], e[i][j], f[i][j])
            best = max(best, h[i][j])
    return best


def test_alignments_side_by_side_equal_single_ones():
    rng = np.random.default_rng(8)
    queries = [rng.integers(0, 4, n).astype(np.int8) for n in (0, 1, 30, 7, 61, 30, 12)]
    targets = [rng.integers(0, 4, n).astype(np.int8) for n in (5, 1, 44, 80, 0, 9, 33)]
    biases = [None if r % 2 else rng.integers(-2, 2, len(q)).astype(np.int32) for r, q in enumerate(queries)]
    single = [align.local_alignment(q, t, bias=b) for q, t, b in zip(queries, targets, biases, strict=True)]
    assert align.local_alignments(queries, targets, biases=biases) == single
    assert single[0] is None and single[4] is None and sum(a is not None for a in single) >= 4


def test_local_alignment_against_plain_recurrence():
    rng = random.Random(3)
    for _ in range(40):
        a = random_protein(rng, rng.randint(1, 40))
        b = list(a)
        for _ in range(rng.randint(0, 10)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randint(0, 2)] = random_protein(rng, rng.randint(0, 2))
        q, t = scores.encode(a), scores.encode("".join(b))
        want = slow_local(q, t, 11, 1)
        got = align.local_alignment(q, t)
        if want == 0:
            assert got is None
            continue
        assert got["score"] == want
        i, j, total, gap = got["qbegin"], got["sbegin"], 0, None
        for op in got["ops"]:
            if op in "=X":
                total += scores.blosum62()[q[i], t[j]]
                assert (op == "=") == (q[i] == t[j])
            else:
                total -= 1 + (11 if gap != op else 0)
            gap = op
            i += op != "D"
            j += op != "I"
        assert (total, i, j) == (want, got["qend"], got["send"])


def test_window_and_xdrop():
    q = scores.encode("AAAWWWWAAA")
    assert align.window_score(q, q, 5, 5) == align.self_score(q) == 4 * 11 + 6 * 4
    i, j, n, s, same = align.xdrop_ungapped(q, q, 4, 4)
    assert (i, j, n, s, same) == (0, 0, 10, 68, 10)


def test_align_pairs_and_second_hsp(spark):
    p = spark.createDataFrame([(1, "WWWWHHHH", "WWWWHHHHAAAAWWWWHHHH"), (2, "", "A"), (3, "WWWW", None)], "id int, qseq string, tseq string")
    got = align.align_pairs(p, bias=False, max_hsps=2).orderBy("sstart").collect()
    assert [(r["id"], r["sstart"], r["send"], r["cigar"], r["btop"]) for r in got] == [(1, 1, 8, "8M", "8"), (1, 13, 20, "8M", "8")]


def test_composition_bias_is_small_on_mixed_text():
    rng = random.Random(1)
    b = scores.composition_bias(scores.encode(random_protein(rng, 300)))
    assert abs(b.mean()) < 1.5
    assert scores.composition_bias(scores.encode("W" * 50)).min() < -5


def test_spaced_seeds_against_slices(spark):
    rng = random.Random(5)
    rows = [random_protein(rng, 700), "AC", "", "AAXAAAAAAAAAAAAA"]
    from seqweave.functions.alphabet import reduction_map

    table = dict(zip(*reduction_map(), strict=True))
    code = "110101"
    want = set()
    for o, s in enumerate(rows):
        for p in range(len(s) - len(code) + 1):
            key = "".join(table.get(s[p + k], s[p + k]) for k, c in enumerate(code) if c == "1")
            if "X" not in key:
                want.add((key, o, p))
    got = {(r["seed"], r["oid"], r["pos"]) for r in seeds.spaced_seeds(seqs(spark, rows), [code]).collect()}
    assert got == want


def test_minimizers_skip_short(spark):
    s = seeds.contiguous_seeds(seqs(spark, ["ARNDCQEGHILK", "ARND"]), 4)
    got = seeds.minimizers(s, 4)
    assert {r["oid"] for r in got.collect()} == {0}


def test_seed_neighbours(spark):
    w = spark.createDataFrame([("WA",)], "word string")
    got = {r["neighbour"]: r["score"] for r in seeds.seed_neighbours(w, 2, 12).collect()}
    m = scores.blosum62()
    want = {a + b: int(m[scores.LETTERS.index("W"), scores.LETTERS.index(a)] + m[0, scores.LETTERS.index(b)]) for a in scores.RESIDUES for b in scores.RESIDUES}
    assert got == {k: v for k, v in want.items() if v >= 12}


def test_star_join_is_linear(spark):
    t = spark.createDataFrame([(0, "A", i, 0, 10 + i) for i in range(50)], "shape int, seed string, oid long, pos int, len int")
    assert joins.star_join(t, t, "target").count() == 50
    assert {r["tid"] for r in joins.star_join(t, t, "target").collect()} == {49}
    assert joins.star_join(t, t, "combo").count() == 50


def test_window_identities(spark):
    d = spark.createDataFrame([("ARNDCQ", "RNDCQE", 1, 0)], "q string, t string, i int, j int")
    assert d.select(joins.window_identities(*map(F.col, "qtij")).alias("n")).first()["n"] == 5


def hsps(spark, rows):
    return spark.createDataFrame(rows, "qid int, tid int, score int, qstart int, qend int, sstart int, send int, evalue double, bitscore double")


def test_ranking(spark):
    h = hsps(spark, [(1, t, s, 1, 50, 1, 50, 1.0 / s, float(s)) for t, s in ((5, 90), (6, 90), (7, 50), (8, 85))])
    assert [r["tid"] for r in ranking.top_targets(h, 2).orderBy("rank").collect()] == [5, 6]
    assert {r["tid"] for r in ranking.top_percent(h, 10).collect()} == {5, 6, 8}
    assert ranking.top_percent(h, 100).count() == 4


def test_cull_overlaps(spark):
    h = hsps(spark, [(1, 1, 90, 1, 50, 1, 50, 0.0, 90.0), (1, 1, 80, 10, 60, 10, 60, 0.0, 80.0), (1, 1, 70, 100, 150, 100, 150, 0.0, 70.0)])
    assert {r["score"] for r in ranking.cull_overlaps(h).collect()} == {90, 70}


def test_range_cull(spark):
    h = hsps(spark, [(1, 1, 90, 1, 50, 1, 50, 0.0, 90.0), (1, 2, 80, 1, 50, 10, 60, 0.0, 80.0), (1, 3, 70, 60, 90, 1, 30, 0.0, 70.0)])
    assert {r["tid"] for r in ranking.range_cull(h, 1).collect()} == {1, 3}


def test_taxon_k_without_taxa(spark):
    r = spark.createDataFrame([(1, 10, 1, []), (1, 11, 2, [5]), (1, 12, 3, [5]), (1, 13, 4, [])], "qid int, tid int, rank int, taxa array<int>")
    assert {x["tid"] for x in ranking.taxon_k(r, 1).collect()} == {10, 11}


def edges(spark, rows):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in rows], "src long, dst long, weight double")


def test_components_and_cover(spark):
    nodes = spark.createDataFrame([(i,) for i in range(8)], "node long")
    e = edges(spark, [(1, 2, 1), (2, 3, 1), (5, 6, 1)])
    got = {r["node"]: r["component"] for r in graph.connected_components(nodes, e).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7}
    cover = {r["member"]: r["rep"] for r in graph.greedy_vertex_cover(nodes, graph.symmetric(e)).collect()}
    assert cover == {0: 0, 1: 2, 2: 2, 3: 2, 4: 4, 5: 6, 6: 6, 7: 7}


def test_long_chain_of_components(spark):
    e = edges(spark, [(i, i + 1, 1) for i in range(60)])
    nodes = spark.range(61).withColumnRenamed("id", "node")
    assert {r["component"] for r in graph.connected_components(nodes, e).collect()} == {0}


def test_path_compression_and_rounds(spark):
    m = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 3)], "member long, rep long")
    assert {r["rep"] for r in graph.path_compression(m).collect()} == {1}
    two = graph.compose_rounds(spark.createDataFrame([(9, 4), (8, 7)], "member long, rep long"), m)
    assert {(r["member"], r["rep"]) for r in two.collect()} == {(9, 3), (8, 7)}


def test_mcl_splits_two_cliques(spark):
    rows = [(a, b, 10) for a in range(3) for b in range(a + 1, 3)] + [(a, b, 10) for a in range(3, 6) for b in range(a + 1, 6)] + [(2, 3, 1)]
    got = {r["member"]: r["rep"] for r in graph.mcl(spark.range(6).withColumnRenamed("id", "node"), edges(spark, rows)).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3}


@pytest.fixture
def nodes(spark):
    rows = [(1, 1, "no rank"), (2, 1, "phylum"), (3, 2, "genus"), (4, 3, "species"), (5, 3, "species"), (6, 99, "species")]
    return spark.createDataFrame(rows, "taxid long, parent long, rank string")


def test_taxonomy(spark, nodes):
    lin = {r["taxid"]: r["lineage"] for r in taxonomy.lineages(nodes).collect()}
    assert lin[4] == [2, 3, 4] and lin[1] == [] and lin[6] == []
    rows = spark.createDataFrame([("a", 4), ("a", 5), ("b", 4), ("c", 777), ("d", 4), ("d", 2)], "key string, taxid long")
    assert {r["key"]: r["lca"] for r in taxonomy.lca(rows, nodes, "key").collect()} == {"a": 3, "b": 4, "c": 0, "d": 2}
    assert {r["taxid"]: r["ancestor"] for r in taxonomy.at_rank(nodes, "phylum").collect()} == {1: 0, 2: 2, 3: 2, 4: 2, 5: 2, 6: 0}
    seq_tax = spark.createDataFrame([(10, 4), (11, 2), (12, 6)], "oid long, taxid long")
    db = spark.createDataFrame([(10,), (11,), (12,), (13,)], "oid long")
    assert {r["oid"] for r in taxonomy.include_taxa(db, seq_tax, nodes, [3]).collect()} == {10}
    assert {r["oid"] for r in taxonomy.exclude_taxa(db, seq_tax, nodes, [3]).collect()} == {11, 12}
    with pytest.raises(ValueError):
        taxonomy.descendants(nodes, [1])


def test_masking(spark):
    rng = random.Random(2)
    plain = random_protein(rng, 60)
    d = seqs(spark, [plain + "PQ" * 20 + plain[::-1], plain, "", None])
    got = [r["seq"] for r in masking.mask(d, "tantan").orderBy("oid").collect()]
    assert got[0].count("X") > 25 and got[1].count("X") < 5 and got[2] == "" and got[3] is None
    low = [r["seq"] for r in masking.mask(seqs(spark, ["A" * 30, plain]), "seg").orderBy("oid").collect()]
    assert low[0] == "X" * 30 and low[1].count("X") < 20
    motif = masking.mask(seqs(spark, ["AAACDEFGHIKLAAA"]), "motif", motifs=["CDEFGHIK"]).first()["seq"]
    assert motif == "AAAXXXXXXXXLAAA"


def test_kadane_is_numpy_safe():
    assert align.self_score(np.array([], dtype=np.int8)) == 0
