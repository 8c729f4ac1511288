"""The training-data pipeline: language, near copies, repeated passages, mixture, packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqweave.llm import langid, mixing, packing, parity_join, runtime, suffix_dedup
from seqweave.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with confidence (langid.predict's `accepted`); the others go.

    Rows with a null text or without a letter go; null ids, repeated rows and columns of any name are kept as they are; an
    empty table stays empty.
    """
    runtime.small_batches(spark)
    names = docs.columns
    own = ["text" if c == "text" else f"_{k}" for k, c in enumerate(names)]  # no clash with the columns of predict
    told = langid.predict(docs.toDF(*own), langid.train(docs), keep_text=True)
    return told.where("accepted").select(*own).toDF(*names)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each component of near copies (five words, similarity 0.8).

    Where a doc_id repeats with different sets of five words, each is compared by itself, so that a text that is near
    to nothing stays whatever its id's other texts are. Of rows with one id and one set the least stays, in the order of
    the columns, text first. Rows with a null doc_id all stay; rows without a word are near to nothing and stay, one for
    each doc_id; an empty table stays empty.
    """
    names = docs.columns
    own = [c if c in ("doc_id", "text") else f"c{k}" for k, c in enumerate(names)]  # no clash with working columns
    wide, found = parity_join.node_components(docs.toDF(*own), n=5, percent=80)
    keep = found.where("doc_id = component_id").select(F.col("doc_id").alias("_id")).distinct()
    row = F.struct("text", *(c for c in own if c != "text"))
    one = wide.join(keep, F.col("_node") == F.col("_id"), "left_semi").groupBy("_node").agg(F.min(row).alias("_row"))
    return one.select(*(F.col("_row")[c].alias(c) for c in own)).toDF(*names).union(docs.where(F.col("doc_id").isNull()))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that an earlier document has.

    n_chars is counted anew; documents of which nothing is left go. Null texts and rows with a null doc_id stay as they are;
    later exact copies of a text of 50 words or more go; an empty table stays empty.
    """
    return suffix_dedup.without_repeats(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source: a row per pass over a document.

    Documents that the mix takes nothing of, and those without a word, have no row; a null source is a source of its own; rows
    that share a doc_id get the same passes; an empty table stays empty.
    """
    return mixing.mixed_documents(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 ids: every row of its input is packed once, null texts as their end id."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("language", language), ("near_copies", near_copies), ("passages", passages), ("mixture", mixture), ("sequences", sequences)]

#: SQL expresses neither a trained model nor a tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = runtime.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
