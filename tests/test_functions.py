import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqweave.functions import alphabet, scores, shapes
from seqweave.operators import translation


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(column.alias("x")).first()["x"]


def test_text_to_residues(spark):
    assert one(spark, alphabet.text_to_residues(F.col("t")), t="Hello, wörld 1!") == "HELLXWRLD"


def test_clean_protein_rejects(spark):
    assert one(spark, alphabet.clean_protein(F.col("t")), t="acu-*") == "ACXX*"
    with pytest.raises(Exception, match="invalid character"):
        one(spark, alphabet.clean_protein(F.col("t")), t="AC1")


def test_reduction_sends_ambiguous_to_first_group(spark):
    assert one(spark, alphabet.reduce_residues(F.col("t")), t="ARBJZDNIMVX") == "AKAAAEEIIIX"


@pytest.mark.parametrize(("dna", "protein"), [("ATGGCNTAA", "MA*"), ("ATGNNN", "MX"), ("AT", ""), ("TTYTTN", "FX")])
def test_translation(spark, dna, protein):
    assert one(spark, alphabet.translate_codons(alphabet.clean_dna(F.col("t"))), t=dna) == protein.replace("F", "X")


def test_unknown_code():
    with pytest.raises(ValueError):
        alphabet.translate_codons(F.lit("A"), 7)


def test_six_frames_and_orfs(spark):
    d = spark.createDataFrame([(1, "ATGGCATAA")], "oid long, seq string")
    got = {r["frame"]: r["seq"] for r in translation.six_frames(d).collect()}
    assert got[0] == "MA*" and got[3] == "LCH" and got[1] == "WH" and len(got) == 6
    m = translation.mask_orfs(spark.createDataFrame([(1, "MAAAA*MA")], "oid long, seq string"), 3)
    assert m.first()["seq"] == "MAAAA*XX"


def test_reverse_coordinates(spark):
    h = spark.createDataFrame([(0, 9, 1, 1), (3, 9, 1, 1), (1, 9, 1, 2)], "frame int, source_len int, qstart int, qend int")
    got = [(r["qstart"], r["qend"], r["qframe"]) for r in translation.query_coordinates(h).orderBy("frame").collect()]
    assert got == [(1, 3, 1), (2, 7, 2), (9, 7, -1)]


@pytest.mark.parametrize(("raw", "acc"), [("UniRef90_P12345", "P12345"), ("gi|123|sp|Q1.2|NAME", "Q1"), ("sp|P1|X", "P1"), ("NP_001.1", "NP_001"), ("A:PDB=1abc", "A")])
def test_accession(spark, raw, acc):
    assert one(spark, alphabet.accession(F.col("t")), t=raw) == acc


def test_matrix_is_symmetric_and_scores_identities():
    m = scores.blosum62()
    assert (m[:25, :25] == m[:25, :25].T).all()
    assert m[scores.LETTERS.index("W"), scores.LETTERS.index("W")] == 11
    assert m[scores.LETTERS.index("I"), scores.LETTERS.index("V")] == 3


def test_background_sums_to_one():
    p = scores.background()
    assert abs(p.sum() - 1) < 1e-9 and (p > 0).all()


def test_evalue_matches_published_rows():
    """Raw scores, lengths and data base size of known rows give their printed e-values and bits."""
    assert scores.evalue([879], [165], [165], 97484)[0] == pytest.approx(5.04e-125, rel=0.6)
    p = scores.statistics()
    for raw, bits in ((879, 343), (783, 306), (743, 290)):
        assert math.floor((p["lambda"] * raw - math.log(p["K"])) / math.log(2)) == bits


def test_evalue_falls_with_score():
    e = scores.evalue(np.array([40, 60, 80]), np.array([100] * 3), np.array([200] * 3), 1e6)
    assert e[0] > e[1] > e[2] > 0


def test_band_width(spark):
    got = spark.createDataFrame([(10,), (99,), (249,), (349,), (900,)], "n int").select(scores.band_width(F.col("n")).alias("b")).collect()
    assert [r["b"] for r in got] == [12, 16, 30, 40, 64]


def test_shape_runs():
    assert shapes.runs("1101") == [(0, 2), (3, 1)]
    assert all(len(set(x.count("1") for x in v)) == 1 for v in shapes.SHAPES.values())
    assert shapes.least_identities("default", 90) == 30 and shapes.least_identities("very-sensitive") == 9


def test_matrix_file():
    m = scores.parse_matrix("# c\n   A R\nA 5 -2\nR -2 7\n")
    assert m[0, 0] == 5 and m[0, 1] == -2 and m[1, 1] == 7
