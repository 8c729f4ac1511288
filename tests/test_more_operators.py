import random

import numpy as np

from seqweave.functions import adjust, alphabet, scores
from seqweave.operators import align, chaining, frameshift, nucleotide


def protein(rng, n):
    return "".join(rng.choice(scores.RESIDUES) for _ in range(n))


def codons():
    order, code = "TCAG", alphabet.GENETIC_CODES[1]
    return {code[16 * i + 4 * j + k]: a + b + c for i, a in enumerate(order) for j, b in enumerate(order) for k, c in enumerate(order)}


def test_frameshift_alignment(spark):
    rng = random.Random(1)
    p = protein(rng, 80)
    dna = "".join(codons()[c] for c in p)
    cut = dna[:120] + dna[121:]  # one base lost
    grown = dna[:120] + "A" + dna[120:]
    back = dna[::-1].translate(str.maketrans("ACGT", "TGCA"))
    d = spark.createDataFrame([(0, dna, p), (1, cut, p), (2, grown, p), (3, back, p), (4, "", p)], "id int, qseq string, tseq string")
    got = {r["id"]: r for r in frameshift.align_frameshift(d).collect()}
    whole = align.self_score(scores.encode(p))
    assert (got[0]["score"], got[0]["shifts"], got[0]["qbegin"], got[0]["qend"]) == (whole, 0, 0, 240)
    assert got[1]["shifts"] == 1 and got[1]["score"] > whole - 35 and got[1]["sbegin"] == 0 and got[1]["send"] == 80
    assert got[2]["shifts"] == 1 and got[2]["score"] == whole - 15
    assert (got[3]["strand"], got[3]["score"], got[3]["qbegin"], got[3]["qend"]) == (-1, whole, 0, 240)
    assert 4 not in got


def test_every_chain_of_a_repeated_passage(spark):
    rng = random.Random(7)
    a = protein(rng, 40)
    t, at = "", []
    for _ in range(7):
        t += protein(rng, 25)
        at.append(len(t))
        t += a
    d = spark.createDataFrame([(1, 2, 10, j + 10, a, t) for j in at], "qid long, tid long, i int, j int, qseq string, tseq string")
    found = chaining.chains(d).collect()
    assert sorted(r["sbegin"] for r in found if r["score"] > 100) == at and sorted(r["chain"] for r in found) == list(range(len(found)))


def test_chaining_joins_over_a_gap(spark):
    rng = random.Random(2)
    a, b = protein(rng, 40), protein(rng, 40)
    q, t = a + b, a + protein(rng, 7) + b
    d = spark.createDataFrame([(1, 2, 10, 10, q, t), (1, 2, 50, 57, q, t)], "qid long, tid long, i int, j int, qseq string, tseq string")
    c = chaining.chains(d).orderBy("chain").first()
    assert c["n_segments"] == 2 and (c["d_min"], c["d_max"]) == (-7, 0) and c["qbegin"] == 0 and c["qend"] == 80
    exact = align.local_alignment(scores.encode(q), scores.encode(t))["score"]
    assert abs(c["score"] - exact) <= 15
    assert chaining.gapped_filter(d, exact - 20).count() == 1 and chaining.gapped_filter(d, exact + 50).count() == 0
    assert chaining.accept_diagonal(scores.encode(a), scores.encode(a), 5, 5, 90, 90, 90)


def test_nucleotide_mapping(spark):
    rng = random.Random(3)
    target = "".join(rng.choice("ACGT") for _ in range(3000))
    read = target[1000:1400]
    back = read[::-1].translate(str.maketrans("ACGT", "TGCA"))
    t = spark.createDataFrame([(0, target)], "oid long, seq string")
    q = spark.createDataFrame([(0, read), (1, back)], "oid long, seq string")
    got = {r["qid"]: r for r in nucleotide.map_queries(q, t).where("primary").collect()}
    for k, strand in ((0, 1), (1, -1)):
        assert got[k]["strand"] == strand and 1000 <= got[k]["sbegin"] < 1030 and 1370 < got[k]["send"] <= 1400 and got[k]["mapq"] > 20


def test_nucleotide_statistics():
    lam, k = nucleotide.karlin(1, -2)
    assert abs(0.25 * np.exp(lam) + 0.75 * np.exp(-2 * lam) - 1) < 1e-6 and abs(lam - 1.33) < 0.01 and 0.55 < k < 0.68


def test_adjusted_matrix():
    rng = random.Random(4)
    plain = scores.encode(protein(rng, 2000))
    rich = scores.encode("".join(rng.choice("LLLLAVIG" + scores.RESIDUES) for _ in range(2000)))
    q = adjust.adjusted_pairs(adjust.composition(rich), adjust.composition(plain))
    assert abs(q.sum(axis=1) - adjust.composition(rich)).max() < 1e-6 and abs(q.sum() - 1) < 1e-6
    m, leucine = adjust.adjusted_matrix(rich, rich), scores.LETTERS.index("L")
    assert m[leucine, leucine] <= scores.blosum62()[leucine, leucine]
    assert adjust.rescaled_matrix(rich, rich)[leucine, leucine] <= scores.blosum62()[leucine, leucine]
    assert adjust.conditional_matrix(plain, plain).shape == (26, 26)
