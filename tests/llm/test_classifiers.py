import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqweave.llm import langid, nbsvm, runtime

from .helpers import prose


def junk(rng):
    return " ".join(f"{prose(rng, 1)}***" if rng.random() < 0.5 else "BUY!! NOW!!" for _ in range(rng.randint(20, 80)))


def test_quality_on_held_out(spark):
    rng = random.Random(1)
    rows = [(i, junk(rng) if i % 4 == 0 else prose(rng, rng.randint(30, 200))) for i in range(400)]
    docs = spark.createDataFrame(rows + [(900, None), (901, ""), (902, "x" * 200_000)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i, _ in rows], "doc_id long, quality int")
    held = runtime.fold_of(F.col("doc_id"), 5) == 0
    model = nbsvm.train(docs, labels.where(~held))
    got = {r["doc_id"]: r["score"] for r in nbsvm.score(docs, model).collect()}
    out = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.3) == (i % 4 != 0) for i in out]) > 0.97
    assert all(0 <= s <= 1 for s in got.values()) and got[900] == got[901]


def test_quality_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert nbsvm.score(docs, nbsvm.train(docs, none)).first()["score"] == pytest.approx(0.5)
    one = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert nbsvm.score(docs, nbsvm.train(docs, one)).first()["score"] > 0.9
    assert nbsvm.score(docs.limit(0), nbsvm.train(docs.limit(0), none)).count() == 0


def test_dual_coordinate_descent_separates():
    rows = [np.array([k % 2, 5 + k % 3], dtype=np.int32) for k in range(60)]
    y = np.array([1.0 if k % 2 else -1.0 for k in range(60)])
    w, b = nbsvm.dual_coordinate_descent(rows, [np.ones(2)] * 60, y, np.full(60, 1.0))
    assert all((w[r].sum() + b) * t > 0.9 for r, t in zip(rows, y, strict=True))


LETTERS = {"aa": "aeioustrnl", "bb": "kxzwqjyväö", "cc": "абвгдежзик"}


def test_language_on_held_out(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randint(2, 60), LETTERS[lang]), lang) for i in range(300) for lang in [list(LETTERS)[i % 3]]]
    rows += [(900, None, "aa"), (901, "", "aa"), (902, "12 34 !?", "bb"), (903, rows[0][1], None), (904, rows[0][1] * 500, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit(1))
    held = runtime.fold_of(F.col("doc_id"), 4) == 2
    model = langid.train(docs.where(~held))
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    out = [r for r in rows[:300] if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert np.mean([got[r[0]]["lang_pred"] == r[2] for r in out]) > 0.98
    assert np.mean([got[r[0]]["accepted"] for r in out]) > 0.97
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3
    assert got[903]["lang_pred"] == got[904]["lang_pred"] == "aa"
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    got = langid.predict(docs, langid.train(docs)).first()
    assert (got["lang_pred"], got["score"], got["accepted"]) == ("und", 0.0, False)
    assert langid.predict(docs.limit(0), langid.train(docs)).count() == 0
