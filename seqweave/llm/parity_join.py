"""N-gram Jaccard join by parity sketches.

A document's set is its distinct n-word shingles. Every shingle toggles one bit of the document's sketch (a XOR hash), so the
Hamming distance of two sketches is at most the symmetric difference of the sets. Sets that reach the threshold t differ
in at most d elements, d fixed by a size band; a sketch of more than d parts therefore agrees in at least one part
(pigeonhole). Each part's bits, hashed with band and part number, are join keys.

Parts without a bit say little. With spare parts beyond what the pigeonhole needs, a pair agrees in a part with bits unless
both documents have more empty parts than that; only such documents emit their empty parts too. Nothing is lost.

Documents with equal sets are settled by one hash group and only one of them is joined. Keys are range-sorted, so that a key
shared by very many documents is split over tasks; in each run the first document is the hub, and hub pairs are verified
exactly. Documents of a key that hub pairs left in different components are then compared pair by pair, which is what makes
the links complete: pairs inside one component need no test, as only components are returned. The pigeonhole leaves near pairs
more than one common key, as many as spare parts that are not empty; so before that step each document drops that many of its
most frequent open keys (a prefix filter), and groups that only a frequent passage holds together fall apart.

Defined results: words are separated by ASCII white space and A-Z is lower-cased; fewer words than n make one shingle; no
word, or a null text, makes an empty set, linked with nothing; rows that repeat a doc_id are one document with the links of
all their sets (each different set is joined as a node of its own and tied to the id's first); a null doc_id is a document without links; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqweave.sources.files import number_rows

from . import kernel as K
from . import runtime

U = np.uint64
#: Bits of a part: so many that only parts with equal shingles agree. Of a part only its odd bits are kept, never the zeros.
PART_BITS = 1 << 32
SHORT = 32  # 64-bit words of the sketch that pairs of one key are compared by
LEAST_BITS = 11  # two to the power of this: bits of the smallest whole sketch
#: Up to so many rows (two or three numbers each) a list of documents or keys is sent to all executors.
MOST_SENT = 1_000_000


def bands(percent: int, ratio: float = 1.5, most: int = 1 << 40) -> np.ndarray:
    """Lower bounds of size bands; a set and one of at least `percent` of its size lie in one band or in neighbours."""
    low, out = 1, [1]
    while low < most:
        low = max(low + 1, int(low * ratio))
        out.append(low)
    return np.array(out, dtype=np.int64)


def most_difference(high: int, percent: int) -> int:
    """Most elements in which two sets that reach the threshold can differ, if the larger has at most `high`."""
    # |A ^ B| <= (|A| + |B|) (100 - p) / (100 + p)
    return 2 * high * (100 - percent) // (100 + percent)


def spare_parts(d: int, low: int) -> int:
    """More parts than a set of `low` elements is likely to leave empty (the mean and three deviations), and half of d at least:
    spare parts that are not empty are common keys of near pairs, and as many of the most frequent keys need not be compared."""
    spare = 1
    for _ in range(20):
        parts = d + 1 + spare
        empty = parts * math.exp(-low / parts)
        spare = 1 + math.ceil(empty + 3 * math.sqrt(empty))
    return max(spare, -(-d // 2))


class Sketcher:
    def __init__(self, n: int, percent: int):
        self.n, self.percent = n, percent
        self.low = bands(percent)
        # a smaller set of the band before, at least percent of this one's low, is among those that should not emit empties
        self.spare = [spare_parts(most_difference(int(h) - 1, percent), int(a)) for a, h in zip(self.low, self.low[1:], strict=False)]

    def sets(self, text: pa.Array):
        """Sorted distinct shingle hashes of each text."""
        for i, j in K.chunks(text):
            words = K.Words(text.slice(i, j - i), fold_case=True)
            grams = K.windows_hash(words.hash, self.n)
            for d in range(j - i):
                a, b = words.first[d], words.first[d + 1]
                if b - a >= self.n:
                    yield np.unique(grams[a : b - self.n + 1])
                elif b > a:
                    yield K.mix(K.windows_hash(words.hash[a:b], int(b - a)) + U(int(b - a)))
                else:
                    yield np.zeros(0, dtype=np.uint64)

    def band_keys(self, s: np.ndarray, band: int) -> tuple[np.ndarray, int]:
        """Keys of a set in a band, and how many of them any partner that is near enough shares beyond the first."""
        d = most_difference(int(self.low[band + 1]) - 1, self.percent)
        if d == 0:
            parts, spare = 1, 0
        else:
            spare = self.spare[band]
            parts = d + 1 + spare
        salted = K.mix(s ^ U((band * 0x9E3779B97F4A7C15) & (2**64 - 1)))
        part = ((salted >> U(32)) * U(parts)) >> U(32)
        bit = salted & U(PART_BITS - 1)
        order = np.argsort(part, kind="stable")
        part, toggled = part[order], K.mix((part * U(PART_BITS) + bit + U(1)))[order]
        start = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.zeros(0, dtype=np.int64)
        value = np.bitwise_xor.reduceat(toggled, start) if len(start) else np.zeros(0, dtype=np.uint64)
        number = part[start]
        full = value != 0
        value, number = value[full], number[full]
        free = max(0, spare - (parts - len(value)))
        if parts - len(value) > spare:
            empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), number)
            value, number = np.concatenate((value, np.zeros(len(empty), dtype=np.uint64))), np.concatenate((number, empty))
        return K.mix(value ^ K.mix(number * U(4096) + U(band + 1))), free

    def keys(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of a set in its own band and, if a larger partner can lie there, in the next one; and 2 * free + 0 or 1 (next)."""
        if not len(s):
            return s, np.zeros(0, dtype=np.int32)
        band = int(np.searchsorted(self.low, len(s), side="right")) - 1
        out = [self.band_keys(s, band)]
        if len(s) * 100 >= int(self.low[band + 1]) * self.percent:
            out.append(self.band_keys(s, band + 1))
        return np.concatenate([x for x, _ in out]), np.concatenate([np.full(len(x), 2 * free + k, dtype=np.int32) for k, (x, free) in enumerate(out)])


def folded_sketch(s: np.ndarray) -> bytes:
    """Parity bits of a set: each element toggles one of two to four times as many bits as there are elements."""
    bits = 1 << max(LEAST_BITS, (2 * len(s) - 1).bit_length() if len(s) else 0)
    odd = np.bincount((K.mix(s + U(99)) & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def short_sketch(whole: bytes) -> bytes:
    """A sketch folded to SHORT words of 64 bits."""
    a = np.frombuffer(whole, dtype=np.uint64)
    while len(a) > SHORT:
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return a.tobytes()


def distance(x: bytes, y: bytes) -> int:
    """Hamming distance of two sketches; the longer is folded, which keeps it a parity sketch."""
    a, b = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
    while len(a) != len(b):
        if len(a) < len(b):
            a, b = b, a
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def sent(df: DataFrame) -> DataFrame:
    """A table to join with: to all executors if it has at most MOST_SENT rows, else by a shuffle."""
    return F.broadcast(df) if df.count() <= MOST_SENT else df


def sketches(docs: DataFrame, k: Sketcher) -> DataFrame:
    """(doc_id, n, h1, h2, sketch, f0..f3): set size, 128-bit hash of the set, its whole sketch, and that folded short."""

    def made(batches):
        for batch in batches:
            ids, text = batch.column("doc_id"), K.as_strings(batch.column("text"))
            for i, j in K.chunks(text, 8 << 20):
                n, h1, h2, whole = [], [], [], []
                for s in k.sets(text.slice(i, j - i)):
                    n.append(len(s))
                    h1.append(int(K.mix(s).sum(dtype=np.uint64).view(np.int64)))
                    h2.append(int(np.bitwise_xor.reduce(K.mix(s + U(7))).view(np.int64)) if len(s) else 0)
                    whole.append(folded_sketch(s))
                short = np.frombuffer(b"".join(map(short_sketch, whole)), dtype=np.int64).reshape(-1, SHORT)
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(whole, pa.binary()), *(pa.array(np.ascontiguousarray(short[:, c])) for c in range(SHORT))], names=["doc_id", "n", "h1", "h2", "sketch", *(f"f{c}" for c in range(SHORT))])

    return typed(docs).mapInArrow(K.lean(made), "doc_id bigint, n bigint, h1 bigint, h2 bigint, sketch binary" + "".join(f", f{c} bigint" for c in range(SHORT)))


def typed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def join_keys(docs: DataFrame, k: Sketcher) -> DataFrame:
    """(key, doc_id, tag): join keys of every document that has a set. They are made from the texts each time they are read:
    that costs a pass over the texts and saves a table as large as the input."""

    def made(batches):
        for batch in batches:
            ids, text = batch.column("doc_id").to_numpy(zero_copy_only=False), K.as_strings(batch.column("text"))
            for i, j in K.chunks(text):
                keys = [k.keys(s) for s in k.sets(text.slice(i, j - i))]
                if keys:
                    columns = np.concatenate([x for x, _ in keys]).view(np.int64), np.repeat(ids[i:j], [len(x) for x, _ in keys]).astype(np.int64), np.concatenate([x for _, x in keys])
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["key", "doc_id", "tag"])

    return typed(docs).where("doc_id is not null").mapInArrow(K.lean(made), "key bigint, doc_id bigint, tag int")


def key_runs(keyed: DataFrame) -> DataFrame:
    """(key, doc_id, tag, hub, edge) of documents in runs of equal keys, in sorted order; hub is the first of the run.

    A run that a task's edge cuts has a hub on each side; `edge` tells of it.
    """
    n = keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ordered = keyed.repartitionByRange(int(n), "key", "doc_id").sortWithinPartitions("key", "doc_id")

    def runs(batches):
        first, held, hub_before = None, None, None

        def rows(key, doc, tag, edge):
            start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.concatenate((start, [len(key)])))
            hub = np.repeat(doc[start], size)
            if hub_before is not None and key[0] == hub_before[0]:
                hub[: size[0]] = hub_before[1]
            sizes = np.repeat(size, size)
            at_edge = (key == edge) | (key == first)
            out = (sizes > 1) | at_edge
            return pa.RecordBatch.from_arrays([pa.array(key[out]), pa.array(doc[out]), pa.array(tag[out]), pa.array(hub[out]), pa.array(at_edge[out])], names=["key", "doc_id", "tag", "hub", "edge"])

        for batch in batches:
            key, doc, tag = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "doc_id", "tag"))
            if not len(key):
                continue
            if first is None:
                first = key[0]
            if held is not None:
                key, doc, tag = (np.concatenate(x) for x in zip(held, (key, doc, tag), strict=True))
            tail = int(np.searchsorted(key, key[-1], side="left"))
            if len(key) - tail > 1 << 20:  # a long run need not be held; its rows are known to share a key
                yield rows(key, doc, tag, key[-1])
                hub = hub_before[1] if hub_before is not None and hub_before[0] == key[-1] else doc[tail]
                hub_before, held = (key[-1], hub), None
                continue
            if tail:
                yield rows(key[:tail], doc[:tail], tag[:tail], None)
            held = (key[tail:], doc[tail:], tag[tail:])
        if held is not None:
            yield rows(*held, held[0][0])

    return ordered.mapInArrow(K.lean(runs), "key bigint, doc_id bigint, tag int, hub bigint, edge boolean")


def near(pairs: DataFrame, s: DataFrame, percent: int) -> DataFrame:
    """(a, b) of pairs whose sizes and whole sketches allow a link: Hamming distance at most the most difference."""
    for c in ("a", "b"):
        pairs = pairs.join(s.select(F.col("doc_id").alias(c), F.col("n").alias(f"n{c}")), c)
    pairs = pairs.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    for c in ("a", "b"):
        pairs = pairs.join(s.select(F.col("doc_id").alias(c), F.col("sketch").alias(f"s{c}")), c)

    def allowed(batches):
        for batch in batches:
            n, m = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("na", "nb"))
            apart = np.array([distance(x, y) for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True)], dtype=np.int64)
            mask = pa.array(apart * (100 + percent) <= (n + m) * (100 - percent))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return pairs.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(K.lean(allowed), "a bigint, b bigint")


def verified(pairs: DataFrame, docs: DataFrame, k: Sketcher) -> DataFrame:
    """(a, b) of pairs whose sets reach the threshold, by exact sizes of intersection and union."""
    pairs = runtime.materialize(pairs, "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()

    def gathered(batches):
        for batch in batches:
            sets = [s.tobytes() for s in k.sets(K.as_strings(batch.column("text")))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], names=["doc_id", "s"])

    rows = typed(docs).join(sent(wanted), "doc_id", "left_semi")
    sets = runtime.materialize(rows.mapInArrow(K.lean(gathered), "doc_id bigint, s binary"), "sets")
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b")
    percent = k.percent

    def tested(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                both = np.concatenate((p, q))
                both.sort()
                same = int(np.count_nonzero(both[1:] == both[:-1]))
                ok.append(100 * same >= percent * (len(p) + len(q) - same))
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return runtime.materialize(both.mapInArrow(K.lean(tested), "a bigint, b bigint").distinct(), "links")


def settled(pairs: DataFrame, copies: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, with documents of equal sets replaced by the one that stands for them."""
    copies = sent(copies)
    for c in ("a", "b"):
        pairs = pairs.join(copies.select(F.col("doc_id").alias(c), F.col("rep").alias("_r")), c, "left").withColumn(c, F.coalesce("_r", c)).drop("_r")
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def nodes(docs: DataFrame, k: Sketcher) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """docs with `_node`, the sketches with nodes for doc_id, and (_id, _h, _new) of nodes that are not their doc_id.

    A row's node is its doc_id; where an id repeats with different sets, its texts after the first get numbers above all ids.
    """
    s = runtime.materialize(sketches(docs, k), "sketches")
    key = F.col("doc_id").cast("long")
    one = F.struct("h1", "h2", "n")
    odd = s.where("doc_id is not null").groupBy("doc_id").agg(F.min(one).alias("_x"), F.max(one).alias("_y")).where("_x < _y").select(F.col("doc_id").alias("_id"))
    odd = runtime.materialize(odd, "odd-ids")
    if not odd.limit(1).count():
        return docs.withColumn("_node", key), s, None
    words = F.md5(F.btrim(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(" \t\n\v\f\r")).cast("binary"))
    texts = docs.select(key.alias("_id"), words.alias("_h")).join(sent(odd), "_id", "left_semi").distinct()
    texts = runtime.materialize(texts, "odd-texts")
    others = texts.join(texts.groupBy("_id").agg(F.min("_h").alias("_least")), "_id").where("_h > _least").select("_id", "_h")
    top = s.agg(F.max("doc_id")).first()[0]
    if top + others.count() >= 1 << 63:
        raise ValueError("no numbers above the largest doc_id are left for ids that repeat with different texts")
    named = runtime.materialize(number_rows(others, ["_id", "_h"], top + 1).select("_id", "_h", F.col("oid").alias("_new")), "nodes")
    new = sent(named.withColumnRenamed("_h", "_k"))
    wide = docs.withColumn("_h", words).join(new, (key == F.col("_id")) & (F.col("_h") == F.col("_k")), "left")
    wide = wide.withColumn("_node", F.coalesce("_new", key)).select(*docs.columns, "_node")
    again = wide.join(sent(odd), key == F.col("_id"), "left_semi").select(F.col("_node").alias("doc_id"), "text")
    s = s.join(sent(odd), F.col("doc_id") == F.col("_id"), "left_anti").unionByName(sketches(again, k))
    return wide, runtime.materialize(s, "sketches"), named


def components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; component_id is the smallest doc_id that links reach."""
    k = Sketcher(n, percent)
    wide, s, named = nodes(docs, k)
    d = wide.select(F.col("_node").alias("doc_id"), "text")
    if named is None:
        return linked(d, s, k)
    out = linked(d, s, k, named.select(F.col("_id").alias("a"), F.col("_new").alias("b")))
    out = out.join(sent(named.select("_id", "_new")), F.col("doc_id") == F.col("_new"), "left").withColumn("doc_id", F.coalesce("_id", "doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def node_components(docs: DataFrame, n: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """docs with `_node`, and components() of nodes: the different sets of a repeated doc_id count as documents of their own."""
    k = Sketcher(n, percent)
    wide, s, _ = nodes(docs, k)
    return wide, linked(wide.select(F.col("_node").alias("doc_id"), "text"), s, k)


def linked(docs: DataFrame, s: DataFrame, k: Sketcher, ties: DataFrame | None = None) -> DataFrame:
    """components() of documents (doc_id, text) whose ids have one set each, with their sketches; ties (a, b) are links besides."""
    percent = k.percent
    known = s.where("n > 0 and doc_id is not null")
    same = runtime.materialize(known.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("_rows")), "classes")
    copies = known.select("doc_id", "h1", "h2", "n").join(same.where("_rows > 1"), ["h1", "h2", "n"]).where("doc_id <> rep")
    copies = runtime.materialize(copies.groupBy("doc_id").agg(F.min("rep").alias("rep")), "copies")
    whole = known.join(copies.select("doc_id"), "doc_id", "left_anti").select("doc_id", "n", "sketch", *(f"f{c}" for c in range(SHORT)))
    # one document of each set is enough; where copies are too many to be sent, they come along and are settled below
    lone = typed(docs).join(F.broadcast(copies), "doc_id", "left_anti") if copies.count() <= MOST_SENT else docs
    runs = runtime.materialize(key_runs(join_keys(lone, k)), "runs")
    # a run cut by task edges: its hubs meet here, one row per task and key
    cut = runs.where("edge").groupBy("key").agg(F.min("hub").alias("top"), F.max("hub").alias("_other")).where("top < _other")
    hubs = runs.where("edge").select("key", "hub").distinct().join(cut, "key").where("hub <> top").select(F.col("top").alias("a"), F.col("hub").alias("b"))
    pairs = runs.where("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).union(hubs).distinct()
    pairs = runtime.materialize(settled(pairs, copies), "candidates")
    links = verified(near(pairs, whole, percent), docs, k)
    if ties is not None:
        links = links.union(settled(ties, copies))
    found = runtime.materialize(runtime.connected_components(links, "a", "b"), "components")
    more = residual_links(runs, pairs, found, copies, whole, docs, k)
    if more is not None:
        found = runtime.connected_components(links.union(more), "a", "b")
    named = same.join(found, F.col("rep") == F.col("node"), "left").select("h1", "h2", F.col("n").alias("_n"), F.coalesce("component", "rep").alias("component_id"))
    out = s.select("doc_id", F.col("n").alias("n_shingles"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"))
    out = out.join(named, (F.col("_h1") == F.col("h1")) & (F.col("_h2") == F.col("h2")) & (F.col("n_shingles") == F.col("_n")), "left")
    mine = F.when((F.col("n_shingles") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", mine.alias("component_id"))


def residual_links(runs: DataFrame, tested: DataFrame, found: DataFrame, copies: DataFrame, whole: DataFrame, docs: DataFrame, k: Sketcher) -> DataFrame | None:
    """Links between documents that share a key, that no test has compared and that lie in different components."""
    # documents that are not alone: (doc_id, rep, comp)
    placed = copies.join(found, F.col("rep") == F.col("node"), "left").select("doc_id", "rep", F.coalesce("component", "rep").alias("comp"))
    placed = runtime.materialize(placed.union(found.select("node", "node", "component")), "placed")
    r = runs.select("key", "doc_id", "tag").join(sent(placed), "doc_id", "left").select("key", "tag", F.coalesce("rep", "doc_id").alias("doc_id"), F.coalesce("comp", "doc_id").alias("comp"))
    r = r.distinct()
    open_keys = r.groupBy("key").agg(F.min("comp").alias("_x"), F.max("comp").alias("_y"), F.count("*").alias("_n")).where("_x < _y and _n > 2").select("key", "_n")
    open_keys = runtime.materialize(open_keys, "open-keys")
    # near pairs share 1 + free keys at least, and pairs that no test has compared share none but open ones: so each document
    # does without its `free` most frequent, and by the same order of keys in all documents such a pair still shares one
    rank = F.row_number().over(Window.partitionBy("doc_id", "tag").orderBy(F.col("_n").desc(), "key"))
    r = r.join(sent(open_keys), "key").withColumn("_rank", rank).where(F.col("_rank") > F.shiftright("tag", 1)).select("key", "doc_id", "comp")
    bits = [f"f{c}" for c in range(SHORT)]
    r = r.join(whole.select("doc_id", "n", *bits), "doc_id")
    r = runtime.materialize(r, "open")
    side = lambda x: r.select("key", F.col("doc_id").alias(x), *(F.col(c).alias(f"{c}{x}") for c in ("comp", "n", *bits)))
    left, right = side("a"), side("b")
    apart = sum((F.bit_count(F.col(f"{c}a").bitwiseXOR(F.col(f"{c}b"))) for c in bits), F.lit(0))
    fits = (F.col("a") < F.col("b")) & (F.col("compa") != F.col("compb")) & (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * k.percent)
    # the short sketches' distance is a lower bound as well, so a pair beyond it cannot be a link
    fits = fits & (apart * (100 + k.percent) <= (F.col("na") + F.col("nb")) * (100 - k.percent))
    more = left.join(right, "key").where(fits).select("a", "b").distinct().join(tested, ["a", "b"], "left_anti")
    more = runtime.materialize(near(more, whole, k.percent), "more")
    return verified(more, docs, k) if more.limit(1).count() else None
