"""Plans that read each sequence once give the rows of the plain operators."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqweave.functions import digest, scores, shapes
from seqweave.operators import align, chaining, joins, nucleotide, seeds

CODE = shapes.SHAPES["default"][0]


def texts(rng, n, letters=scores.RESIDUES):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 120))) for _ in range(n)]


def table(spark, rows):
    return spark.createDataFrame(rows, "oid long, seq string").repartition(3)


def rows(df, *columns):
    return sorted(map(tuple, (df.select(*columns) if columns else df).collect()), key=str)


@pytest.fixture
def sides(spark):
    """Queries, and targets with copies of them, short and null texts, letters without a seed, ids of two texts and of none."""
    rng = random.Random(7)
    q = texts(rng, 6) + ["ARNDCQEGHILKMFPSTWYV" * 3]
    t = texts(rng, 6) + [s[k : k + 60] for s in q for k in (0, 3, 30)] + [texts(rng, 1)[0] + s + "X*_XB" for s in q] + [q[-1][:30] + "X" + q[-1][31:], "", "AC"]
    targets = [(k, s) for k, s in enumerate(t)] + [(3, q[-1]), (3, q[0]), (None, q[-1]), (99, None)]
    return table(spark, list(enumerate(q))), table(spark, targets)


HIT = ("shape", "seed", "qid", "i", "tid", "j", "hamming")


@pytest.mark.parametrize("most", [seeds.MOST_KEYS, 5])
def test_hits_without_texts_joined(spark, sides, most, monkeypatch):
    monkeypatch.setattr(seeds, "MOST_KEYS", most)
    q, t = sides
    codes = shapes.SHAPES["default"]
    pairs = joins.seed_join(seeds.spaced_seeds(q, codes), seeds.spaced_seeds(t, codes))
    want = rows(joins.hamming_filter(pairs, q, t, 11), *HIT)
    assert len(want) > 20
    assert rows(joins.seed_hits(q, t, codes, 11), *HIT) == want
    wanted = seeds.spaced_seeds(q, codes)
    assert rows(seeds.shared_seeds(t, codes, wanted), *HIT[:2], "oid", "pos") == rows(seeds.only_shared(seeds.spaced_seeds(t, codes), wanted), *HIT[:2], "oid", "pos")


def test_texts_do_not_travel_with_hits(spark, sides):
    once = [x.where("oid is not null and oid <> 3") for x in sides]
    plan = joins.seed_hits(*once, [CODE], 11)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "twin" in plan


def test_diagonals_side_by_side_equal_single_ones():
    rng = random.Random(3)
    for q, t in zip(texts(rng, 30), texts(rng, 30), strict=True):
        a, b, centre = scores.encode(q), scores.encode(t), rng.randint(-60, 60)
        want = []
        for d in range(centre - 9, centre + 10):
            i, j = max(d, 0), max(-d, 0)
            n = max(min(len(a) - i, len(b) - j), 0)
            total = np.concatenate(([0], scores.blosum62()[a[i : i + n], b[j : j + n]].cumsum()))
            want.append((total - np.minimum.accumulate(total)).max())
        assert chaining.scan_diagonals(a, b, centre, 9).tolist() == want


def test_pairs_by_batches(spark, sides):
    once = [x.where("oid is not null and oid <> 3") for x in sides]
    h = joins.leftmost(joins.seed_hits(*once, [CODE], 11))
    pairs = chaining.with_texts(h, *once)
    q, t = ({r["oid"]: scores.encode(r["seq"] or "") for r in x.collect()} for x in once)
    hits = {}
    for r in h.collect():
        hits.setdefault((r["qid"], r["tid"]), []).append((r["i"], r["j"]))
    want = sorted((*k, n, c["score"], c["d_min"], c["d_max"]) for k, v in hits.items() for n, c in enumerate(chaining.pair_chains(q[k[0]], t[k[1]], sorted(v))))
    assert sorted(rows(chaining.chained_pairs(pairs), "qid", "tid", "chain", "score", "d_min", "d_max")) == want and len(want) > 10
    reached = sorted(k for k, v in hits.items() if any(chaining.gapped_score(chaining.scan_diagonals(q[k[0]], t[k[1]], i - j, 64)) >= 150 for i, j in v))
    assert sorted(rows(chaining.gapped_pairs(pairs, 150))) == reached and 0 < len(reached) < len(hits)
    assert "Pandas" not in chaining.gapped_pairs(pairs, 60)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("side", [align.SIDE, 40])
def test_scores_without_traces(side, monkeypatch):
    monkeypatch.setattr(align, "SIDE", side)
    rng = np.random.default_rng(5)
    own = [rng.integers(0, 4, n).astype(np.int8) for n in (0, 1, 30, 7, 61)]
    queries = [own[k % 5] for k in range(40)]
    targets = [rng.integers(0, 4, n).astype(np.int8) for n in rng.integers(0, 90, 40)]
    bias = [None if k % 2 else rng.integers(-2, 2, len(q)).astype(np.int32) for k, q in enumerate(own)]
    biases = [bias[k % 5] for k in range(40)]
    want = [a["score"] if a else 0 for a in align.local_alignments(queries, targets, biases=biases)]
    assert align.local_scores(queries, targets, biases=biases).tolist() == want and max(want) > 50


def test_md5_of_many_orders_as_its_text():
    rng = np.random.default_rng(2)
    for size in (0, 3, 10, 15, 55):
        letters = rng.integers(65, 91, (50, size)).astype(np.uint8)
        high, low = digest.md5_words(letters)
        assert [f"{a:016x}{b:016x}" for a, b in zip(high.tolist(), low.tolist(), strict=True)] == [hashlib.md5(x.tobytes()).hexdigest() for x in letters]


@pytest.mark.parametrize("block", [seeds.BLOCK, 50])
def test_each_text_in_one_piece(spark, sides, block, monkeypatch):
    monkeypatch.setattr(seeds, "BLOCK", block)
    codes = [*shapes.SHAPES["default"], "1101"]
    t = sides[1].where("oid is null or oid <> 3")
    s = seeds.spaced_seeds(t, codes)
    assert rows(seeds.sequence_minimizers(t, codes, 4), "shape", "seed", "oid", "pos") == rows(seeds.minimizers(s, 4), "shape", "seed", "oid", "pos")
    for part in sides[1], t:  # ids of two texts count as one
        s = seeds.spaced_seeds(part, codes)
        assert rows(seeds.sequence_sketch(part, codes, 5), "shape", "oid", "seed", "pos") == rows(seeds.sketch(s, 5), "shape", "oid", "seed", "pos")
        want = s.groupBy("shape", "oid").agg(F.count("*").alias("n"), F.countDistinct("seed").alias("keys"), F.min("seed").alias("low"), F.max("seed").alias("high"))
        columns = ("shape", "oid", "n", "keys", "low", "high")
        assert rows(seeds.seed_summary(part, codes), *columns) == rows(want, *columns)


@pytest.mark.parametrize("span", [8, 15])
def test_distinct_windows(spark, sides, span, monkeypatch):
    monkeypatch.setattr(seeds, "MANY", 100)
    want = rows(seeds.windows(sides[1], span).select("win").distinct())
    got = seeds.distinct_windows(sides[1], span)
    assert rows(got) == want
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_index_of_shared_minimizers(spark):
    rng = random.Random(4)
    base = "".join(rng.choice("ACGT") for _ in range(300))
    repeat = "".join(rng.choice("ACGT") for _ in range(60))
    q = table(spark, [(0, base[:150] + repeat), (1, "AC"), (2, base[100:])])
    t = [base + repeat] + [repeat + x for x in texts(rng, 8, "ACGT")] + [base[40:200] + "N" + base[::-1], "R".join((base[:50], base[60:120])), "", base[10:90]]
    targets = table(spark, [*enumerate(t), (2, base), (2, repeat), (77, None)])
    for part in targets, targets.where("oid <> 2"):
        assert rows(nucleotide.sequence_minimizers(part), "oid", "seed", "pos", "strand") == rows(nucleotide.minimizers(part), "oid", "seed", "pos", "strand")
        counted = sorted(r["n"] for r in nucleotide.seed_counts(part).collect())
        n = nucleotide.minimizers(part).groupBy("seed").count()
        assert counted == sorted(r["count"] for r in n.collect())
        whole = rows(nucleotide.anchors(q, nucleotide.drop_repetitive(nucleotide.minimizers(part), 0.0002)))
        assert rows(nucleotide.anchors(q, nucleotide.shared_index(q, part))) == whole and whole
        kept = nucleotide.drop_repetitive(n.drop("count").join(nucleotide.minimizers(part), "seed"), 0.05).select("seed").distinct().count()
        cut = nucleotide.repetitive_from(nucleotide.seed_counts(part), 0.05)
        assert cut is not None and n.where(F.col("count") < cut).count() == kept
