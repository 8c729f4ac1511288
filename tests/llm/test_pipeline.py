import os

import pytest

import corpus_pipeline
from seqweave.llm import queries

from .helpers import DOCS, corpus, prose, words
from .test_text_operators import brute_components, brute_passages


def test_stages(spark, tmp_path):
    rows = corpus(9)
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, docs.collect())
        if name != "sequences":
            assert docs.columns == [c.split()[0] for c in DOCS.split(", ")]
    before, after = seen["language"]
    assert {r["doc_id"] for r in before} - {r["doc_id"] for r in after} <= {r[0] for r in rows if len(words(r[1])) < 4}
    before, after = seen["near_copies"]
    comp = brute_components([tuple(r) for r in before], 5, 80)
    assert sorted(r["doc_id"] for r in after) == sorted(i for i, (n, c) in comp.items() if c == i)
    before, after = seen["passages"]
    assert brute_passages([tuple(r) for r in before], 50) and not brute_passages([tuple(r) for r in after], 50)
    before, after = seen["sequences"]
    assert {r["doc_id"] for r in before} == {r["doc_id"] for r in after}


def test_near_copies_of_null_and_repeated_ids(spark):
    import random

    rng = random.Random(14)
    a, b, c, d = (prose(rng, 90) for _ in range(4))
    rows = [(3, a), (5, a + " end"), (5, b), (5, b), (7, c), (7, ""), (None, a), (None, d), (None, d), (4, d)]
    docs = spark.createDataFrame([(*r, "en", "s", len(r[1])) for r in rows], DOCS).repartition(3)
    got = corpus_pipeline.near_copies(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] or -1, r["text"]) for r in got.collect()) == sorted([(3, a), (5, b), (7, c), (7, ""), (-1, a), (-1, d), (-1, d), (4, d)])


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = con.execute(queries.ORACLE_SQL[name]).fetchdf()
    got = queries.QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    key = lambda df: sorted(map(tuple, df[columns].astype(str).replace({"<NA>": "nan", "None": "nan"}).to_numpy()))
    assert len(got) == len(want)
    for c in columns:
        assert sorted(got[c].map(lambda v: f"{v:g}" if isinstance(v, float) else str(v))) == sorted(want[c].map(lambda v: f"{v:g}" if isinstance(v, float) else str(v))), c
