"""Repeated passages by sparse suffix arrays.

Suffixes (of words) are kept at minimiser positions only: the k-word gram whose hash is smallest in some run of w grams.
A window of min_words words has one anchor, the minimiser of its first w grams, at most w - 1 words inside, so that at least
`reach` = min_words - w + 1 words follow it; equal windows have their anchors at the same place. First, suffixes whose next
`reach` words no other document has are told by a hash and left out. The others are sorted by their words (range
partitions, so no task has them all) and compared with their neighbours: the common prefix is counted in words. From the
anchor matches are extended to the left, word by word, and to the right as far as the neighbours' common prefix goes, which
tells for every window of the anchor which windows in the run of suffixes are equal to it.

Ties in the sort are broken by document and position, so a passage that is everywhere is split over tasks. Windows that
another suffix has too, and all windows of a run that a task's edge cuts (or that is too long to be held), then meet by a
hash of their words, which gives the first document of each, across tasks. Exact copies are
settled first: only the smallest doc_id of equal texts is extended, the others share its passages and their first documents.

Defined results: words are separated by ASCII white space and compared exactly; null and empty texts have no passages; a
text below min_words words has none; repeats inside one document do not count unless another document has them too; rows
that repeat a doc_id are one document (if their texts differ, each row's text is searched under the shared id; only the text
that is a copy steps aside, and cuts are made in the text that they were found in); a null
doc_id is not searched and kept as it is; an empty table gives no passages; other columns are left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as K
from . import runtime

GRAM = 8


def minimiser_suffixes(docs: DataFrame, min_words: int) -> DataFrame:
    """(key, doc_id, at) of kept suffixes; key hashes the words a neighbour must share, led by the gram's own hash bits."""
    w = (min_words - GRAM) // 2 + 1
    reach = min_words - w + 1

    def kept(batches):
        for batch in batches:
            text, ids = K.as_strings(batch.column("text")), batch.column("doc_id").to_numpy(zero_copy_only=False)
            for i, j in K.chunks(text):
                words = K.Words(text.slice(i, j - i))
                n = len(words.hash)
                if n < min_words:
                    continue
                gram = K.windows_hash(words.hash, GRAM)
                doc = np.repeat(np.arange(j - i), np.diff(words.first))
                last = words.first[1:][doc]
                whole = np.arange(n)[: len(gram) - w + 1] + w + GRAM - 1 <= last[: len(gram) - w + 1]
                low = np.where(whole, K.sliding_min(gram, w), np.uint64(0))
                pad = np.zeros(w - 1, dtype=np.uint64)
                best = K.sliding_max(np.concatenate((pad, low, pad)), w)
                at = np.flatnonzero(best == gram)
                key = K.windows_hash(words.hash, reach)
                at = at[at + reach <= last[at]]
                # the gram first, then all the words that a neighbour must share: order of suffixes up to hashing
                value = (gram[at] & np.uint64(0xFFFFFF0000000000)) | (key[at] >> np.uint64(24))
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(ids[i:j][doc[at]], pa.int64()), pa.array((at - words.first[doc[at]]).astype(np.int32))], names=["key", "doc_id", "at"])

    return docs.select("doc_id", "text").mapInArrow(K.lean(kept), "key bigint, doc_id bigint, at int")


def neighbour_candidates(suffixes: DataFrame) -> DataFrame:
    """(doc_id, at) of suffixes that share their key with a neighbour of another document, in sorted order."""
    n = suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ordered = suffixes.repartitionByRange(int(n), "key", "doc_id", "at").sortWithinPartitions("key", "doc_id", "at")

    def compared(batches):
        held = None  # rows of the last key so far
        first_key = None

        def decide(key, doc, at, edge_key):
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            ends = np.concatenate((starts[1:], [len(key)]))
            many = (doc[starts] != doc[ends - 1]) | (key[starts] == edge_key)
            chosen = np.repeat(many, ends - starts)
            return pa.RecordBatch.from_arrays([pa.array(doc[chosen]), pa.array(at[chosen])], names=["doc_id", "at"])

        for batch in batches:
            key, doc, at = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "doc_id", "at"))
            if not len(key):
                continue
            if first_key is None:
                first_key = key[0]
            if held is not None:
                key, doc, at = (np.concatenate(x) for x in zip(held, (key, doc, at), strict=True))
            tail = int(np.searchsorted(key, key[-1], side="left"))
            if tail:
                yield decide(key[:tail], doc[:tail], at[:tail], first_key)
            if len(key) - tail > 1 << 20 and doc[tail] != doc[-1]:
                yield pa.RecordBatch.from_arrays([pa.array(doc[tail:-1]), pa.array(at[tail:-1])], names=["doc_id", "at"])
                tail = len(key) - 1  # a long run of one key need not be held: it has another document already
                first_key = key[-1]
            held = (key[tail:], doc[tail:], at[tail:])
        if held is not None:
            yield decide(*held, held[0][0])

    return ordered.mapInArrow(K.lean(compared), "doc_id bigint, at int")


CONTEXT = "right string, left string, doc_id bigint, row bigint, last bigint, at int, low int, high int"


def suffix_contexts(candidates: DataFrame, min_words: int) -> DataFrame:
    """The candidates that anchor windows: the words from the anchor on, those before it, and how many words (low to high)
    its windows begin before it. Words are followed by one space each."""
    w = (min_words - GRAM) // 2 + 1

    def cut(batches):
        for batch in batches:
            text, found = K.as_strings(batch.column("text")), batch.column("at")
            for i, j in K.chunks(text):
                words = K.Words(text.slice(i, j - i))
                doc = np.repeat(np.arange(j - i), np.diff(words.first))
                window = np.flatnonzero(np.arange(len(doc)) + min_words <= words.first[1:][doc])
                if not len(window):
                    continue
                anchor = K.sliding_argmin(K.windows_hash(words.hash, GRAM), w)[window]
                nominated = np.zeros(len(doc), dtype=bool)
                for d in range(i, j):
                    place = words.first[d - i] + found[d].values.to_numpy(zero_copy_only=False)
                    nominated[place[place < words.first[d - i + 1]]] = True  # an id's places may be those of its other texts
                begin = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
                low, high = window[begin], window[np.concatenate((begin[1:], [len(window)])) - 1]  # first and last window
                a = anchor[begin]
                low, high, a = (x[nominated[a]] for x in (low, high, a))
                size = words.end - words.start
                at = np.concatenate(([0], np.cumsum(size + 1)))
                flat = np.full(at[-1], 32, dtype=np.uint8)
                flat[K.spread(at[:-1], size)] = words.data[~K.SPACE[words.data]]
                pieces = [strings(flat, at[x], at[y]) for x, y in ((a, high + min_words), (low, a))]
                of = pa.array(i + doc[a])
                same = [batch.column(c).take(of) for c in ("doc_id", "row", "last")]
                numbers = [pa.array(x.astype(np.int32)) for x in (a - words.first[doc[a]], a - high, a - low)]
                yield pa.RecordBatch.from_arrays([*pieces, *same, *numbers], names=[c.split()[0] for c in CONTEXT.split(", ")])

    return candidates.select("doc_id", "row", "last", "text", "at").mapInArrow(K.lean(cut), CONTEXT)


def strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.StringArray:
    """data[start:end] of each start and end."""
    size = end - start
    at = np.concatenate(([0], np.cumsum(size)))
    if at[-1] >= 1 << 31:
        raise ValueError("words of one batch are too long to be compared")
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data[K.spread(start, size)]))


def word_rows(text: pa.Array, width: int, backwards: bool = False) -> np.ndarray:
    """Hashes of each text's words in a row of a table, 0 behind the last."""
    words = K.Words(text)
    n = np.diff(words.first)
    table = np.zeros((len(text), width), dtype=np.uint64)
    place = K.spread(np.zeros(len(n), dtype=np.int64), n)
    table[np.repeat(np.arange(len(n)), n), np.repeat(n, n) - 1 - place if backwards else place] = words.hash
    return table


def prefix_hashes(table: np.ndarray) -> np.ndarray:
    """Hash of the first 0, 1, 2 .. words of each row."""
    out = np.zeros((table.shape[1] + 1, len(table)), dtype=np.uint64)
    for k in range(table.shape[1]):
        out[k + 1] = K.mix(out[k] * np.uint64(K.R) + table[:, k])
    return out


WINDOW = "hash bigint, doc_id bigint, row bigint, last bigint, start int"


class Run:
    """Sorted suffixes with their common prefixes, in words, with the suffix before."""

    def __init__(self, rows: pa.RecordBatch, min_words: int):
        self.rows, self.min_words = rows, min_words
        self.right = word_rows(K.as_strings(rows.column("right")), min_words)
        same = (self.right[1:] == self.right[:-1]) & (self.right[1:] != 0)
        self.common = np.concatenate(([0], np.where(same.all(axis=1), min_words, same.argmin(axis=1)))) if rows.num_rows else np.zeros(0, dtype=np.int64)

    def windows(self, a: int, b: int):
        """(suffix, words before the anchor, hash of these) of every window of suffixes a to b."""
        rows = self.rows.slice(a, b - a)
        low, high = (rows.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("low", "high"))
        n = high - low + 1
        which, before = np.repeat(np.arange(b - a), n), K.spread(low, n)
        left = prefix_hashes(word_rows(K.as_strings(rows.column("left")), int(high.max(initial=0)), backwards=True))
        return rows, which, before, left[before, which]

    def batch(self, a: int, b: int, whole_runs: bool) -> pa.RecordBatch:
        """Windows of suffixes a to b by a hash of their words: all, or if the runs are whole those that other suffixes have too."""
        rows, which, before, left = self.windows(a, b)
        if whole_runs:
            # suffixes stand in one block for a number of words if each shares so many with the one before
            block = np.cumsum(self.common[a:b] < np.arange(self.min_words + 1)[:, None], axis=1)[self.min_words - before, which]
            order = np.lexsort((left, block, before))
            x = np.stack((left.view(np.int64), block, before))[:, order]
            same = (x[:, 1:] == x[:, :-1]).all(axis=0)
            one = np.zeros(1, dtype=bool)
            kept = order[np.concatenate((one, same)) | np.concatenate((same, one))] if len(order) else order
            which, before, left = which[kept], before[kept], left[kept]
        right = prefix_hashes(self.right[a:b])[self.min_words - before, which]
        whole = K.mix(right ^ (left * np.uint64(0x9FB21C651E98DF25)) ^ before.astype(np.uint64))
        doc, row, last, at = (rows.column(c).to_numpy(zero_copy_only=False).astype(np.int64)[which] for c in ("doc_id", "row", "last", "at"))
        return pa.RecordBatch.from_arrays([pa.array(whole.view(np.int64)), pa.array(doc), pa.array(row), pa.array(last), pa.array((at - before).astype(np.int32))], names=[c.split()[0] for c in WINDOW.split(", ")])


def extended(contexts: DataFrame, min_words: int, hold: int = 1 << 15) -> DataFrame:
    """Suffixes in sorted order, compared with their neighbours: the windows that another suffix has too, or may have in a run that is cut."""
    reach = min_words - (min_words - GRAM) // 2
    n = contexts.sparkSession.conf.get("spark.sql.shuffle.partitions")
    order = ["right", "doc_id", "row", "at"]
    ordered = contexts.repartitionByRange(int(n), *order).sortWithinPartitions(*order)

    def compared(batches):
        held, edge = None, True  # suffixes not told yet; whether the first of them may belong to a run of the task before
        for batch in batches:
            held = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            if held.num_rows < 4096:
                continue
            run = Run(held, min_words)
            fresh = np.flatnonzero(run.common < reach)  # where runs begin
            head = 0
            if edge:
                head = int(fresh[1]) if len(fresh) > 1 else held.num_rows
                if head == held.num_rows and head < hold:
                    continue
                yield run.batch(0, head, False)
            if head == held.num_rows:
                held = None
                continue
            edge, tail = False, int(fresh[-1])
            if tail > head:
                yield run.batch(head, tail, True)
            held = held.slice(tail)
            if held.num_rows >= hold:
                yield run.batch(tail, tail + held.num_rows, False)
                held, edge = None, True
        if held is not None:
            run = Run(held, min_words)
            fresh = [*np.flatnonzero(run.common < reach).tolist(), held.num_rows]
            head, tail = fresh[1] if edge else 0, fresh[-2]
            if head:
                yield run.batch(0, head, False)
            if tail > head:
                yield run.batch(head, tail, True)
            if held.num_rows > max(head, tail):
                yield run.batch(max(head, tail), held.num_rows, False)

    return ordered.mapInArrow(K.lean(compared), WINDOW)


def repeated_windows(docs: DataFrame, min_words: int = 50) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row, start, owner, owner_start, owner_row, apart): windows that another document has too, owner the first
    (doc_id, place) of all, row a hash of the text, apart whether a document other than exact copies has it;
    and (doc_id, h, row, rep, last): texts that are exact copies, with the first and last doc_id that has them."""
    row = F.xxhash64("text").alias("row")
    docs = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text", row)
    classes = docs.where(F.col("text").isNotNull()).select("doc_id", "row", F.md5(F.col("text")).alias("h"))
    classes = runtime.materialize(classes, "copies")
    groups = classes.groupBy("h").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"))
    copies = classes.join(groups.where(F.col("rep") < F.col("last")), "h").select("doc_id", "h", "row", "rep", "last").distinct()
    copies = runtime.materialize(copies, "copied")
    suffixes = runtime.materialize(minimiser_suffixes(docs, min_words), "suffixes")
    found = neighbour_candidates(suffixes).groupBy("doc_id").agg(F.collect_set("at").alias("at"))
    # by doc_id, so that the texts are dealt once; an id has more than one entry only if it repeats
    found = found.join(copies.groupBy("doc_id").agg(F.collect_list(F.struct("row", "rep", "last")).alias("_copies")), "doc_id", "left")
    rows = docs.join(found, "doc_id").withColumn("_copy", F.try_element_at(F.filter("_copies", lambda c: c["row"] == F.col("row")), F.lit(1)))
    rows = rows.where(F.col("_copy").isNull() | (F.col("doc_id") == F.col("_copy.rep"))).withColumn("last", F.coalesce("_copy.last", "doc_id"))
    windows = runtime.materialize(extended(suffix_contexts(rows, min_words), min_words), "windows")
    place = F.struct("doc_id", "start", "row")
    # a window that only one text has needs no match, even if that text stands for copies: they are reported whole
    shared = windows.groupBy("hash").agg(F.min(place).alias("_own"), F.max("doc_id").alias("_most"), F.max("last").alias("_last"), F.count("*").alias("_n")).where((F.col("_own.doc_id") < F.col("_last")) & (F.col("_n") > 1))
    # written first: the join then deals both sides itself, and a hash that very many documents have can be split over tasks
    shared = runtime.materialize(shared.select("hash", "_own", (F.col("_own.doc_id") < F.col("_most")).alias("apart")), "shared")
    hits = windows.join(shared, "hash").select("doc_id", "row", "start", F.col("_own.doc_id").alias("owner"), F.col("_own.start").alias("owner_start"), F.col("_own.row").alias("owner_row"), "apart")
    return hits, copies


def merged(spans: DataFrame, by: list[str]) -> DataFrame:
    """Spans (.., start, end, owner) of a document joined where they touch: (.., start, end, owner)."""
    order = Window.partitionBy(*by).orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    h = spans.groupBy(*by, "start").agg(F.max("end").alias("end"), F.min("owner").alias("owner"))
    h = h.withColumn("_new", (F.col("start") > F.max("end").over(before)).cast("int"))
    h = h.withColumn("_run", F.sum(F.coalesce("_new", F.lit(0))).over(order))
    return h.groupBy(*by, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("owner").alias("owner")).drop("_run")


def passages(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """One row per passage (doc_id, start, end, n_words, first_doc_id, text), in words, that another document has too."""
    hits, copies = repeated_windows(docs, min_words)
    d = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), runtime.word_count(F.col("text")).cast("int").alias("end"))
    # only the representative is extended: what it shares with an earlier document, all its copies share; written first, see above
    firsts = hits.groupBy(F.col("doc_id").alias("rep"), "row").agg(F.min("owner").alias("_first")).where(F.col("_first") < F.col("rep"))
    copies = copies.join(runtime.materialize(firsts, "firsts"), ["rep", "row"], "left").select("doc_id", "row", F.least("rep", "_first").alias("owner"))
    whole = d.where(F.col("end") >= min_words).join(copies, ["doc_id", "row"]).select("doc_id", F.lit(0).alias("start"), "end", "owner")
    windows = hits.select("doc_id", "start", (F.col("start") + min_words).alias("end"), "owner")
    spans = merged(windows.union(whole), ["doc_id"])
    return spans.select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), (F.col("end") - F.col("start")).cast("long").alias("n_words"), F.col("owner").alias("first_doc_id"))


def without_repeats(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """docs with each passage's repeats cut out, its first occurrence left; documents of which nothing is left go.

    Later exact copies of a text of min_words words or more go as a whole.
    """
    return runtime.aside(docs, ("doc_id", "text", "n_chars"), lambda d: _without(d, min_words))


def _without(docs: DataFrame, min_words: int) -> DataFrame:
    hits, copies = repeated_windows(docs, min_words)
    later = hits.where(F.col("apart") & ((F.col("owner") != F.col("doc_id")) | (F.col("owner_start") != F.col("start")) | (F.col("owner_row") != F.col("row"))))
    later = later.select("doc_id", "row", "start", (F.col("start") + min_words).alias("end"), "owner")
    cut = merged(later, ["doc_id", "row"]).groupBy(F.col("doc_id").alias("_cut")).agg(F.collect_list(F.struct("row", "start", "end")).alias("_spans"))
    gone = copies.where(F.col("doc_id") != F.col("rep")).groupBy(F.col("doc_id").alias("_copy")).agg(F.collect_set("row").alias("_gone"))
    key, row = F.col("doc_id").cast("long"), F.xxhash64("text")
    d = docs.join(cut, key == F.col("_cut"), "left").join(gone, key == F.col("_copy"), "left").withColumn("_spans", F.filter("_spans", lambda x: x["row"] == row))
    d = d.where(F.col("_gone").isNull() | ~F.array_contains("_gone", row) | (runtime.word_count(F.col("text")) < min_words)).select(*docs.columns, "_spans")
    names = docs.columns
    others = [c for c in names if c != "text"]

    def trimmed(batches):
        for batch in batches:
            text, spans = K.as_strings(batch.column("text")), batch.column("_spans")
            out = text.to_pylist()
            for i in range(len(out)):
                if not spans[i].is_valid:
                    continue
                words = K.Words(text.slice(i, 1), hashes=False)
                data, left, at = words.data.tobytes(), [], 0
                for a, b in sorted((s["start"], s["end"]) for s in spans[i].as_py()):
                    left.append(data[at : words.start[a]])
                    at = words.end[min(b, len(words.end)) - 1]
                out[i] = (b"".join(left) + data[at:]).decode()
            columns = {c: batch.column(c) for c in others} | {"text": pa.array(out, pa.string())}
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    out = d.select(*docs.columns, "_spans").mapInArrow(K.lean(trimmed), docs.schema)
    out = out.where(F.col("text").isNull() | (runtime.word_count(F.col("text")) > 0))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
