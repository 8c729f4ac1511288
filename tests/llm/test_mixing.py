import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from seqweave.llm import mixing

from .helpers import DOCS, corpus, words


def targets(size, cap=3):
    """Shares by weight with the excess of capped sources reshared, round by round."""
    names = sorted([s for s in size if s is not None]) + [s for s in size if s is None]
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, fixed = sum(size.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * size[s]]
        if not over:
            return fixed | share
        fixed |= {s: cap * size[s] for s in over}


@pytest.mark.parametrize("n", [60, 7])
def test_mix(spark, n):
    rows = corpus(n=max(n, 10))
    docs = spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("clash")).withColumn("shard", F.lit(1))
    got = mixing.mix(docs, block=4, shard_words=2000).collect()
    assert len(got) == len(rows)
    size = defaultdict(int)
    for r in rows:
        size[r[3]] += len(words(r[1]))
    want = targets(size)
    taken = defaultdict(int)
    for r in got:
        assert r["size"] == len(words(rows[[x[0] for x in rows].index(r["doc_id"])][1]))
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == size[r["source"]]
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in want:
        assert abs(taken[s] - want[s]) <= 4 * 12
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix(docs.repartition(7), block=4, shard_words=2000).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in got}


def test_sainte_lague_against_list_of_quotients(spark):
    votes = {"a": 53000, "b": 24000, "c": 23000, "d": 0, "e": 1}
    for house in (0, 1, 7, 10, 101):
        quotients = sorted(((-v / (2 * s - 1), p) for p, v in votes.items() if v for s in range(1, house + 2)))[:house]
        want = {p: sum(q[1] == p for q in quotients) for p in votes}
        df = spark.createDataFrame([(p, v, house) for p, v in votes.items()], "p string, v long, house long")
        assert {r["p"]: r["won"] for r in mixing.sainte_lague(df, [], ["p"], "v", "house").collect()} == want


def test_empty_and_wordless(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    got = mixing.mix(spark.createDataFrame([(1, None, "en", None, None), (None, "", "en", "x", 0)], DOCS)).collect()
    assert [r["taken"] for r in got] == [0, 0]


def test_mixed_documents(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS)
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    n, texts = defaultdict(int), {r[0]: r[1] for r in rows}
    for r in mixed.collect():
        n[r["doc_id"]] += len(words(r["text"]))
        assert texts[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"])
    assert n == {k: v for k, v in taken.items() if v}
    assert hashlib.md5(repr(sorted(n.items())).encode()).digest()
