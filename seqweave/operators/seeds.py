"""Seed extraction: the join keys of a search.

Seeds of all shapes are gathered in one pass over Arrow batches of letters: a window's seed is the bytes at the shape's
1-positions, taken for a block of positions at once, and invalid windows never become rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqweave.functions import alphabet, digest, shapes

#: Positions whose seeds are gathered at once.
BLOCK = 1 << 16
#: Letters whose windows are told apart at once.
MANY = 1 << 20
#: Keys of queries up to which every task gets them all.
MOST_KEYS = 1_000_000


def seed_rows(seqs: DataFrame, codes: list[str], seq: str, keep: tuple[str, ...], without: str) -> DataFrame:
    """(shape, seed, keep.., pos): letters at the 1-positions of every window of every shape, but windows with a letter of
    `without` there. Sequences are ASCII; null ones have no windows."""
    bad = np.zeros(256, dtype=bool)
    bad[list(without.encode())] = True
    at_ones = [(len(code), np.array([i for i, c in enumerate(code) if c == "1"])) for code in codes]
    names = ["shape", "seed", *keep, "pos"]

    def gathered(batches):
        for batch in batches:
            text = batch.column("_s").fill_null("")
            at = np.frombuffer(text.buffers()[1], dtype=np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
            if not len(text) or at[-1] == at[0]:
                continue
            data = np.frombuffer(text.buffers()[2], dtype=np.uint8)
            for block in range(int(at[0]), int(at[-1]), BLOCK):
                place = np.arange(block, min(block + BLOCK, int(at[-1])))
                row = np.searchsorted(at, place, side="right") - 1
                for shape, (span, ones) in enumerate(at_ones):
                    whole = place + span <= at[row + 1]
                    start, of = place[whole], row[whole]
                    letters = data[start[:, None] + ones]
                    good = ~bad[letters].any(axis=1)
                    start, of, letters = start[good], of[good], letters[good]
                    ends = pa.py_buffer(np.arange(0, letters.size + 1, len(ones), dtype=np.int32))
                    seed = pa.StringArray.from_buffers(len(start), ends, pa.py_buffer(np.ascontiguousarray(letters)))
                    take = pa.array(of)
                    same = [batch.column(c).take(take) for c in keep]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(start), shape, dtype=np.int32)), seed, *same, pa.array((start - at[of]).astype(np.int32))], names=names)

    kinds = ", ".join(f"`{c}` {seqs.schema[c].dataType.simpleString()}" for c in keep)
    return seqs.select(*keep, F.col(seq).alias("_s")).mapInArrow(gathered, f"shape int, seed string, {kinds}, pos int")


def each_text(text: pa.StringArray, block: int | None = None):
    """(first row, offsets, bytes) of texts in a row that have BLOCK (or `block`) letters or more together; offsets count from 0."""
    at = np.frombuffer(text.buffers()[1], dtype=np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    if not len(text) or at[-1] == at[0]:
        return
    data, a = np.frombuffer(text.buffers()[2], dtype=np.uint8), 0
    while a < len(text):
        b = min(len(text), max(a + 1, int(np.searchsorted(at, at[a] + (block or BLOCK)))))
        if at[b] > at[a]:
            yield a, at[a : b + 1] - at[a], data[at[a] : at[b]]
        a = b


def windows_of(data: np.ndarray, at: np.ndarray, ones: np.ndarray, bad: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, pos, letters) of the windows of all rows whose letters at `ones` are not bad."""
    n = len(data) - int(ones[-1])
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(ones)), np.uint8)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))[:n]
    good, ill = np.arange(n) + int(ones[-1]) < at[row + 1], bad[data]
    for o in ones:
        good &= ~ill[o : o + n]
    start = np.flatnonzero(good)
    row = row[start]
    return row, start - at[row], data[start[:, None] + ones]


def words_of(letters: np.ndarray) -> list[np.ndarray]:
    """Numbers that order rows of letters as their text does: as few as 60 bits each can hold."""
    known = np.flatnonzero(np.bincount(letters.ravel(), minlength=256))
    code, bits = np.zeros(256, dtype=np.int64), max(1, (len(known) - 1).bit_length())
    code[known] = np.arange(len(known))
    out = []
    for k in range(letters.shape[1]):
        if k % (60 // bits) == 0:
            out.append(np.zeros(len(letters), dtype=np.int64))
        out[-1] = (out[-1] << bits) | code[letters[:, k]]
    return out


def string_rows(letters: np.ndarray) -> pa.StringArray:
    ends = np.arange(0, letters.size + 1, max(letters.shape[1], 1), dtype=np.int32)
    return pa.StringArray.from_buffers(len(letters), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(letters)))


def grouped(row: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): rows and letters in order, equal ones as they come, and where a new one begins."""
    words = words_of(letters)
    order = np.lexsort((*words[::-1], row))
    new = np.ones(len(order), dtype=bool)
    new[1:] = False
    for x in (row, *words):
        x = x[order]
        new[1:] |= x[1:] != x[:-1]
    return order, new


def each_row(seqs: DataFrame, codes: list[str], reduction: str, found, schema: str) -> DataFrame:
    """(shape, oid, found(row, pos, letters, rows)..) of every text; found gives the rows' numbers and the columns of `schema`."""
    table, bad = reduced_bytes(reduction), np.zeros(256, dtype=bool)
    bad[list(b"X*_")] = True
    shaped = [np.array([i for i, c in enumerate(code) if c == "1"]) for code in codes]
    spans, names = [len(code) for code in codes], [c.split()[0] for c in schema.split(", ")]

    def read(batches):
        for batch in batches:
            for first, at, data in each_text(batch.column("_s").fill_null("")):
                near = table[data]
                for shape, ones in enumerate(shaped):
                    ends = ones if ones[-1] + 1 == spans[shape] else np.append(ones, spans[shape] - 1)
                    row, pos, letters = windows_of(near, at, ones, bad)
                    if len(ends) > len(ones):
                        whole = at[row] + pos + spans[shape] <= at[row + 1]
                        row, pos, letters = row[whole], pos[whole], letters[whole]
                    if len(row):
                        of, columns = found(row, pos, letters, len(at) - 1)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(of), shape, dtype=np.int32)), batch.column("oid").take(pa.array(of + first)), *columns], names=["shape", "oid", *names])

    kind = seqs.schema["oid"].dataType.simpleString()
    return seqs.select("oid", F.col("seq").alias("_s")).mapInArrow(read, f"shape int, oid {kind}, {schema}")


def apart(seqs: DataFrame, by_text, by_id) -> DataFrame:
    """by_text of sequences whose id is their own, and by_id of those that share one."""
    ids = seqs.groupBy("oid").agg(F.count("*").alias("n")).where("n > 1").select(F.col("oid").alias("_id"))
    if ids.isEmpty():
        return by_text(seqs)
    same = F.col("oid").eqNullSafe(F.col("_id"))
    return by_text(seqs.join(ids, same, "left_anti")).unionByName(by_id(seqs.join(ids, same, "left_semi")))


def seed_summary(seqs: DataFrame, codes: list[str], reduction: str = "murphy10") -> DataFrame:
    """(shape, oid, n, keys, low, high): how many seeds and different seeds a sequence has, the least and the last of them."""

    def found(row, pos, letters, rows):
        order, new = grouped(row, letters)
        n = np.bincount(row, minlength=rows)
        of = np.flatnonzero(n)
        last = n.cumsum()[of] - 1
        keys = np.bincount(row[order][new], minlength=rows)[of]
        return of, [pa.array(n[of]), pa.array(keys), string_rows(letters[order[last - n[of] + 1]]), string_rows(letters[order[last]])]

    def by_id(s):
        return spaced_seeds(s, codes, reduction).groupBy("shape", "oid").agg(F.count("*").alias("n"), F.countDistinct("seed").alias("keys"), F.min("seed").alias("low"), F.max("seed").alias("high"))

    return apart(seqs, lambda s: each_row(s, codes, reduction, found, "n bigint, keys bigint, low string, high string"), by_id)


def sequence_sketch(seqs: DataFrame, codes: list[str], n: int, reduction: str = "murphy10") -> DataFrame:
    """sketch of the sequences' seeds. Each text's own n smallest come from one pass; those of one id are met again."""

    def found(row, pos, letters, rows):
        order, new = grouped(row, letters)
        first = order[new]  # at the least position
        high, low = digest.md5_words(letters[first])
        by = first[np.lexsort((low, high, row[first]))]
        k = np.arange(len(by)) - np.searchsorted(row[by], row[by])
        by = by[k < n]
        return row[by], [string_rows(letters[by]), pa.array(pos[by].astype(np.int32))]

    return sketch(each_row(seqs, codes, reduction, found, "seed string, pos int"), n)


def sliding_least(row: np.ndarray, high: np.ndarray, low: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(end, least): of every w in a row of one text the place of the smallest hash, the first of equals."""
    end = np.flatnonzero(np.arange(len(row)) - np.searchsorted(row, row) >= w - 1)
    best = end - (w - 1)
    for k in range(w - 2, -1, -1):
        x = end - k
        less = (high[x] < high[best]) | ((high[x] == high[best]) & (low[x] < low[best]))
        best = np.where(less, x, best)
    return end, best


def sequence_minimizers(seqs: DataFrame, codes: list[str], w: int, reduction: str = "murphy10") -> DataFrame:
    """minimizers of the sequences' seeds, each text in one piece."""

    def found(row, pos, letters, rows):
        high, low = digest.md5_words(letters)
        end, best = sliding_least(row, high, low, w)
        keep = np.ones(len(best), dtype=bool)
        keep[1:] = (row[end[1:]] != row[end[:-1]]) | (high[best[1:]] != high[best[:-1]]) | (low[best[1:]] != low[best[:-1]])
        best = best[keep]
        return row[best], [string_rows(letters[best]), pa.array(pos[best].astype(np.int32))]

    def by_text(s):
        return each_row(s, codes, reduction, found, "seed string, pos int").select("shape", "seed", "oid", "pos")

    return apart(seqs, by_text, lambda s: minimizers(spaced_seeds(s, codes, reduction), w))


def reduced_bytes(reduction: str) -> np.ndarray:
    """The byte that each byte is reduced to."""
    out = np.arange(256, dtype=np.uint8)
    for a, b in zip(*alphabet.reduction_map(reduction), strict=True):
        out[ord(a)] = ord(b)
    return out


def key_list(seeds: DataFrame) -> list | None:
    """The keys (shape, seed) of seeds, or None if they are more than MOST_KEYS."""
    found = seeds.select("shape", "seed").distinct().limit(MOST_KEYS + 1).collect()
    return None if len(found) > MOST_KEYS else [(r["shape"], r["seed"]) for r in found]


def seeds_around(seqs: DataFrame, codes: list[str], keys: list | None = None, reduction: str = "murphy10", left: int = 16, right: int = 32) -> DataFrame:
    """(shape, seed, oid, pos, win, at): spaced seeds with the letters from `left` before to `right` after their begin, clipped
    at the ends; the seed begins at letter `at` of them. With keys, only seeds that are among these: they are told apart while
    windows are read, so that others never leave the task, first by a hash in a table of bytes, then by their letters.
    """
    table, bad = reduced_bytes(reduction), np.zeros(256, dtype=bool)
    bad[list(b"X*_")] = True
    at_ones = [(len(code), np.array([i for i, c in enumerate(code) if c == "1"])) for code in codes]
    factor, spread = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
    wanted: list = []
    bits = min(26, max(16, (64 * len(keys or ())).bit_length()))
    down = np.uint64(64 - bits)
    for shape, (_, ones) in enumerate(at_ones if keys is not None else ()):
        own = sorted(k for s, k in keys if s == shape and len(k) == len(ones))
        h = np.zeros(len(own), dtype=np.uint64)
        letters = np.frombuffer("".join(own).encode(), dtype=np.uint8).reshape(len(own), len(ones)).astype(np.uint64)
        for k in range(len(ones)):
            h = h * factor + letters[:, k]
        marks = np.zeros(1 << bits, dtype=bool)
        marks[((h * spread) >> down).astype(np.int64)] = True
        wanted.append((marks, pa.array(own, pa.string())))

    def gathered(batches):
        for batch in batches:
            text = batch.column("_s").fill_null("")
            at = np.frombuffer(text.buffers()[1], dtype=np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
            if not len(text) or at[-1] == at[0]:
                continue
            data = np.frombuffer(text.buffers()[2], dtype=np.uint8)[: at[-1]]
            for block in range(int(at[0]), int(at[-1]), BLOCK):
                place = np.arange(block, min(block + BLOCK, int(at[-1])))
                row = np.searchsorted(at, place, side="right") - 1
                for shape, (span, ones) in enumerate(at_ones):
                    n = min(len(place), len(data) - block - span + 1)
                    if n <= 0:
                        continue
                    near = table[data[block : block + n + span - 1]]
                    good = place[:n] + span <= at[row[:n] + 1]
                    ill = bad[near]
                    for o in ones:
                        good &= ~ill[o : o + n]
                    if keys is not None:
                        wide, h = near.astype(np.uint64), np.zeros(n, dtype=np.uint64)
                        for o in ones:
                            h *= factor
                            h += wide[o : o + n]
                        h *= spread
                        good &= wanted[shape][0][(h >> down).astype(np.int64)]
                    start = np.flatnonzero(good)
                    letters = near[start[:, None] + ones]
                    seed = pa.StringArray.from_buffers(len(start), pa.py_buffer(np.arange(0, letters.size + 1, len(ones), dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(letters)))
                    if keys is not None:
                        true = pc.is_in(seed, value_set=wanted[shape][1]).to_numpy(zero_copy_only=False)
                        start, seed = start[true], seed.filter(pa.array(true))
                    if not len(start):
                        continue
                    of, start = row[start], start + block
                    lo, hi = np.maximum(start - left, at[of]), np.minimum(start + right, at[of + 1])
                    ends = np.concatenate(([0], np.cumsum(hi - lo)))
                    letters = data[np.arange(ends[-1]) + np.repeat(lo - ends[:-1], hi - lo)]
                    win = pa.StringArray.from_buffers(len(start), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(letters))
                    columns = [pa.array(np.full(len(start), shape, dtype=np.int32)), seed, batch.column("oid").take(pa.array(of)), pa.array((start - at[of]).astype(np.int32)), win, pa.array((start - lo).astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, names=["shape", "seed", "oid", "pos", "win", "at"])

    kind = seqs.schema["oid"].dataType.simpleString()
    return seqs.select("oid", F.col("seq").alias("_s")).mapInArrow(gathered, f"shape int, seed string, oid {kind}, pos int, win string, at int")


def shared_seeds(seqs: DataFrame, codes: list[str], query_seeds: DataFrame) -> DataFrame:
    """(shape, seed, oid, pos): seeds of seqs that some query has."""
    keys = key_list(query_seeds)
    if keys is None:
        return only_shared(spaced_seeds(seqs, codes), query_seeds)
    return seeds_around(seqs, codes, keys, left=0, right=0).select("shape", "seed", "oid", "pos")


def windows(seqs: DataFrame, span: int, seq: str = "seq", keep: tuple[str, ...] = ("oid",)) -> DataFrame:
    """(keep.., pos, win): every window of `span` letters; pos counts from 0."""
    return seed_rows(seqs, ["1" * span], seq, keep, "").select(*keep, "pos", F.col("seed").alias("win"))


def distinct_windows(seqs: DataFrame, span: int, seq: str = "seq") -> DataFrame:
    """(win): the different windows of `span` letters; those of many texts are told apart before they leave the task."""
    ones, none = np.arange(span), np.zeros(256, dtype=bool)

    def read(batches):
        for batch in batches:
            for _, at, data in each_text(batch.column("_s").fill_null(""), MANY):
                _, _, letters = windows_of(data, at, ones, none)
                if len(letters):
                    words = words_of(letters)
                    order = np.argsort(words[0]) if len(words) == 1 else np.lexsort(words[::-1])
                    new = np.any([np.append(True, np.diff(x[order]) != 0) for x in words], axis=0)
                    yield pa.RecordBatch.from_arrays([string_rows(letters[order[new]])], names=["win"])

    return seqs.select(F.col(seq).alias("_s")).mapInArrow(read, "win string").distinct()


def spaced_seeds(seqs: DataFrame, codes: list[str], reduction: str = "murphy10", keep: tuple[str, ...] = ("oid",)) -> DataFrame:
    """(shape, seed, keep.., pos): seeds of every shape; a window with X, a stop or a delimiter at a 1-position has none."""
    return seed_rows(seqs.select(*keep, alphabet.reduce_residues(F.col("seq"), reduction).alias("_r")), codes, "_r", keep, "X*_")


def contiguous_seeds(seqs: DataFrame, k: int, reduction: str = "murphy10", keep: tuple[str, ...] = ("oid",)) -> DataFrame:
    return spaced_seeds(seqs, ["1" * k], reduction, keep)


def entropy(seed: Column, weight: int, reduction: str = "murphy10") -> Column:
    """ln(w!) less the sum of ln(n!) over the seed's reduced letters."""
    ln = F.array(*[F.lit(math.lgamma(n + 1)) for n in range(weight + 1)])
    total = F.lit(math.lgamma(weight + 1))
    for group in alphabet.REDUCTIONS[reduction].split():
        total = total - F.get(ln, F.length(seed) - F.length(F.replace(seed, F.lit(group[0]), F.lit(""))))
    return total


def complex_seeds(seeds: DataFrame, weight: int, cut: float, reduction: str = "murphy10") -> DataFrame:
    return seeds.where(entropy(F.col("seed"), weight, reduction) >= cut * math.log(2) * weight)


def frequency_cut(seeds: DataFrame, sd: float) -> DataFrame:
    """(shape, cut): multiplicity above which seeds are masked, mean + sd deviations, truncated."""
    counts = seeds.groupBy("shape", "seed").agg(F.count("*").alias("n"))
    return counts.groupBy("shape").agg(F.floor(F.avg("n") + sd * F.coalesce(F.stddev_pop("n"), F.lit(0.0))).alias("cut"))


def drop_frequent(seeds: DataFrame, sd: float) -> DataFrame:
    """Seeds without those whose key occurs more often than frequency_cut allows; also the guard against hot join keys."""
    counts = seeds.groupBy("shape", "seed").agg(F.count("*").alias("n"))
    hot = counts.join(frequency_cut(seeds, sd), "shape").where("n > cut").select("shape", "seed")
    return seeds.join(hot, ["shape", "seed"], "left_anti")


def seed_hash(seed: Column) -> Column:
    return F.md5(seed)


def minimizers(seeds: DataFrame, w: int) -> DataFrame:
    """Of every w valid seeds in a row the one with the smallest hash (the first of equals), repeats left out."""
    s = seeds.withColumn("_h", seed_hash(F.col("seed")))
    by = Window.partitionBy("shape", "oid").orderBy("pos")
    s = s.withColumn("_best", F.min(F.struct("_h", "pos", "seed")).over(by.rowsBetween(-(w - 1), 0))).withColumn("_k", F.row_number().over(by)).where(F.col("_k") >= w)
    s = s.select("shape", "oid", F.col("pos").alias("_end"), F.col("_best.seed").alias("seed"), F.col("_best.pos").alias("pos"))
    s = s.withColumn("_before", F.lag("seed").over(Window.partitionBy("shape", "oid").orderBy("_end")))
    return s.where(F.col("_before").isNull() | (F.col("_before") != F.col("seed"))).select("shape", "seed", "oid", "pos")


def sketch(seeds: DataFrame, n: int) -> DataFrame:
    """The n seeds with the smallest hashes of each sequence and shape."""
    s = seeds.groupBy("shape", "oid", "seed").agg(F.min("pos").alias("pos"))
    by = Window.partitionBy("shape", "oid").orderBy(seed_hash(F.col("seed")))
    return s.withColumn("_k", F.row_number().over(by)).where(F.col("_k") <= n).drop("_k")


def kmer_counts(seqs: DataFrame, k: int, n: int) -> DataFrame:
    """The n most frequent k-mers of unreduced letters, without masked ones."""
    c = seed_rows(seqs, ["1" * k], "seq", ("oid",), "X*_").groupBy(F.col("seed").alias("kmer")).agg(F.count("*").alias("n"))
    return c.orderBy(F.col("n").desc(), "kmer").limit(n)


def only_shared(target_seeds: DataFrame, query_seeds: DataFrame) -> DataFrame:
    """Target seeds that some query has."""
    return target_seeds.join(query_seeds.select("shape", "seed").distinct(), ["shape", "seed"], "left_semi")


def without_positions(seeds: DataFrame, used: DataFrame) -> DataFrame:
    """Seeds at positions (oid, pos) that no earlier round has paired."""
    return seeds.join(used.select("oid", "pos").distinct(), ["oid", "pos"], "left_anti")


def seed_neighbours(words: DataFrame, k: int, threshold: int, letters: str = "ARNDCQEGHILKMFPSTWYV") -> DataFrame:
    """(word, neighbour, score): words over `letters` that score at least threshold against a word of length k.

    Letters are chosen one by one; a prefix that cannot reach the threshold any more is dropped.
    """
    from seqweave.functions import scores

    m = scores.blosum62()
    index = {c: scores.LETTERS.index(c) for c in letters}
    row = {a: F.array(*[F.lit(int(m[index[a], index[b]])) for b in letters]) for a in letters}
    table = F.create_map(*[x for a in letters for x in (F.lit(a), row[a])])
    best = F.create_map(*[x for a in letters for x in (F.lit(a), F.lit(int(m[index[a], [index[b] for b in letters]].max())))])
    chars = F.split("word", "")
    rest = F.aggregate(F.transform(chars, lambda c: F.element_at(best, c)), F.lit(0), lambda s, x: s + x)
    out = words.select("word").distinct().withColumn("neighbour", F.lit("")).withColumn("score", F.lit(0)).withColumn("_rest", rest)
    for i in range(k):
        c = F.substring("word", i + 1, 1)
        step = F.transform(F.element_at(table, c), lambda s, j: F.struct(F.substring(F.lit(letters), j + 1, F.lit(1)).alias("l"), s.alias("s")))
        out = out.withColumn("_x", F.explode(step)).withColumn("_rest", F.col("_rest") - F.element_at(best, c))
        out = out.select("word", F.concat("neighbour", "_x.l").alias("neighbour"), (F.col("score") + F.col("_x.s")).alias("score"), "_rest").where(F.col("score") + F.col("_rest") >= threshold)
    return out.drop("_rest")
