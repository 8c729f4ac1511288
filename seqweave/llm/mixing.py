"""Mixing sources to target weights by Sainte-Lague apportionment, with DataFrame functions only.

Equal-word blocks are seats. Seats go to sources by highest quotients target / (2 s - 1), and a source's seats go to its
shards the same way. Inside a shard documents stand in seeded order; that stream is cut into blocks and the shard's quota
takes blocks from its front, going round again when the quota exceeds the shard (an epoch).

Highest quotients need no list of all quotients: the seats of a party lie between round(v / d) for two divisors d whose
totals enclose the house, so two candidates a party are ranked, whatever the size of the house.

Defined results: a null source is a source of its own, ordered last; a null or wordless text has size 0 and takes 0; rows
that repeat are rows of their own; rows without an id are dealt by their text; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import runtime


def sainte_lague(parties: DataFrame, group: list[str], order: list[str], votes: str, seats: str) -> DataFrame:
    """parties with `won`: the seats of each party among its group's `seats`, by highest quotients; ties by `order`."""
    g = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    p = parties.withColumn("_total", F.sum(F.col(votes).cast("double")).over(g)).withColumn("_n", F.count("*").over(g))
    share = F.col(votes).cast("double") / F.when(F.col("_total") > 0, F.col("_total"))
    low = F.greatest(F.lit(0), F.floor(share * F.greatest(F.lit(0.0), F.col(seats) - F.col("_n") / 2) + 0.5) - 1)
    high = F.when(F.col(votes) > 0, F.floor(share * (F.col(seats) + F.col("_n") / 2) + 0.5) + 1)
    p = p.withColumn("_low", F.coalesce(low, F.lit(0)).cast("long")).withColumn("_high", F.greatest(F.coalesce(high, F.lit(0)).cast("long"), F.col("_low")))
    p = p.withColumn("_left", F.col(seats) - F.sum("_low").over(g))
    p = p.withColumn("_seat", F.explode(F.sequence("_low", "_high")))
    given = F.col("_seat") == F.col("_low")
    ranked = Window.partitionBy(*(group or [F.lit(0)])).orderBy(given.desc(), F.when(given, F.lit(0.0)).otherwise(F.col(votes) / (2 * F.col("_seat") - 1)).desc(), *[F.col(c).asc_nulls_last() for c in order], "_seat")
    p = p.withColumn("_rank", F.row_number().over(ranked))
    keep = parties.columns
    p = p.where(given | (F.col("_rank") - F.col("_n") <= F.col("_left")))
    return p.groupBy(*keep).agg(F.max("_seat").alias("won"))


def source_targets(sizes: DataFrame, weights: Column | None = None, share: float = 1.0, most_epochs: int = 3) -> DataFrame:
    """(source, source_size, weight, target): share of all words by weight, at most most_epochs times a source's size.

    The excess of capped sources is reshared by weight until none is above its cap. With sources ordered by cap / weight
    that fixed point is one prefix: level = max over sources of (rest of the words) / (rest of the weights).
    """
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last()))
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", (rank - 1) % 3 + 1 if weights is None else weights)
    everyone = Window.partitionBy(F.lit(0))
    order = everyone.orderBy(F.col("source_size") * most_epochs / F.col("weight"), F.col("source").asc_nulls_last())
    total = F.sum("source_size").over(everyone) * F.lit(float(share))
    capped = F.coalesce(F.sum(F.col("source_size") * most_epochs).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weight_left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("_level", (total - capped) / weight_left).withColumn("_level", F.max("_level").over(everyone))
    return s.select("source", "source_size", "weight", F.least((F.col("source_size") * most_epochs).cast("double"), F.col("weight") * F.col("_level")).alias("target"))


def seeded(mark: Column, seed: int, what: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(f"{seed}{what}"), mark))


def mix(docs: DataFrame, seed: int = 17, block: int = 16, shard_words: int = 1 << 18, most_epochs: int = 3) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, epochs, part): words taken of each row of docs.

    taken = epochs * size + part: whole passes over the document and the words taken from its front in the last pass.
    A shard holds about shard_words words, however large its source.
    """
    spark = docs.sparkSession
    # what a document's place hangs on: its id, or the text of one without
    mark = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).alias("mark")
    sizes = runtime.materialize(docs.select("doc_id", "source", runtime.word_count(F.col("text")).alias("size"), mark), "mix-sizes")
    sources = source_targets(sizes, most_epochs=most_epochs)
    everyone = Window.partitionBy(F.lit(0))
    sources = sources.withColumn("_house", F.floor(F.sum("target").over(everyone) / block + 0.5).cast("long"))
    sources = sainte_lague(sources, [], ["source"], "target", "_house").drop("_house").withColumnRenamed("won", "source_blocks")
    sources = sources.withColumn("n_shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long"))
    sources = runtime.materialize(sources, "mix-sources").withColumnRenamed("source", "_s")  # one row a source
    in_shard = sizes.join(sources.select("_s", "n_shards"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    number = F.conv(F.substring(seeded(F.col("mark"), seed, "shard"), 1, 12), 16, 10).cast("long")
    in_shard = in_shard.withColumn("shard", F.pmod(number, F.col("n_shards"))).drop("n_shards")
    shards = in_shard.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"))
    shards = shards.join(sources, F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "n_shards", "weight")
    shards = sainte_lague(shards, ["source"], ["shard"], "shard_size", "source_blocks")
    quota = F.least(F.col("won") * block, F.col("shard_size") * most_epochs)
    shards = shards.select(F.col("source").alias("_s"), F.col("shard").alias("_h"), "shard_size", "source_size", "target", quota.alias("quota"))
    order = Window.partitionBy("source", "shard").orderBy(seeded(F.col("mark"), seed, "order"), F.col("doc_id").asc_nulls_last(), "size")
    placed = in_shard.withColumn("_end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.join(shards, F.col("source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_h")))
    epochs = F.when(F.col("shard_size") > 0, F.floor(F.col("quota") / F.greatest(F.col("shard_size"), F.lit(1)))).otherwise(0).cast("long")
    placed = placed.withColumn("epochs", epochs).withColumn("_rest", F.col("quota") - F.col("epochs") * F.col("shard_size"))
    part = F.greatest(F.lit(0), F.least(F.col("_end"), F.col("_rest")) - (F.col("_end") - F.col("size"))).cast("long")
    placed = placed.withColumn("part", F.when(F.col("epochs") < most_epochs, part).otherwise(F.lit(0).cast("long")))
    return placed.select("doc_id", "source", F.col("size").cast("long").alias("size"), F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"), (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken"), "epochs", "part")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: a row for each whole pass over a document and one with the words of a partial pass.

    Texts keep their own white space; a partial row ends after its last word taken. A document that the mix takes nothing
    of has no row. Rows that share a doc_id get the same passes, the most that any of them got.
    """
    return runtime.aside(docs, ("doc_id", "text", "source", "n_chars"), lambda d: _mixed(d, mix(d, **options)))


def _mixed(docs: DataFrame, taken: DataFrame) -> DataFrame:
    taken = taken.groupBy("doc_id").agg(F.max("epochs").alias("_epochs"), F.max("part").alias("_part"), F.max("size").alias("_size")).withColumnRenamed("doc_id", "_id")
    rows = docs.join(taken.where("_size > 0"), F.col("doc_id").eqNullSafe(F.col("_id"))).drop("_id")
    whole = F.array_repeat(F.col("_size"), F.col("_epochs").cast("int"))
    passes = F.concat(whole, F.when(F.col("_part") > 0, F.array(F.col("_part"))).otherwise(F.array().cast("array<bigint>")))
    rows = rows.withColumn("_words", F.explode(passes))
    to_word_ends = F.split(F.col("text"), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    front = F.array_join(F.slice(to_word_ends, F.lit(1), F.col("_words").cast("int")), "")
    text = F.when(F.col("_words") == F.col("_size"), F.col("text")).otherwise(front)
    out = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
