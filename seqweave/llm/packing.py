"""Sequence packing by minimum bin slack.

Texts are tokenised whole by a public tokenizer; an end id follows each document. A document longer than the window fills
windows of its own; what remains (1 to window - 1 ids) is packed. Remainders are dealt to shards of about shard_docs
documents. In a shard, each sequence starts with the longest remainder; a subset-sum table over bitsets (one Python integer
per distinct length, counts split into powers of two) finds the multiset of remaining lengths that fills the window
closest to capacity, and back-tracking through the tables gives how many of each length to take.

Defined results: a null text is empty and holds the end id alone; rows that repeat are packed each; a null doc_id is kept;
an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from . import runtime

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


# Kinds of bytes: OTHER, LETTER an ASCII letter, MARK an ASCII sign other than the apostrophe, BLANK what parts chunks.
OTHER, LETTER, MARK, BLANK = 0, 1, 2, 3
KIND = np.zeros(256, dtype=np.uint8)
KIND[K.SPACE] = BLANK
KIND[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = LETTER
KIND[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = MARK


class ChunkTokenizer:
    """Ids of texts by way of their chunks between ASCII white space, each different chunk of a block of texts encoded once.

    Only for tokenizers that drop white space, never look across it, fold case, split letters from other characters and end
    each word with a mark (as word_bpe_49k does): a text's ids are then its chunks' ids in a row, and a chunk of letters
    (ASCII or Latin-1) with ASCII signs behind it is its lower-case letters' ids and its signs'. Other chunks are encoded as
    they stand. Words are encoded many to a line and cut at the ids that end a word; as a word ends at most once, as many
    ends as words mean one end each, and otherwise words are encoded one by one. `by_chunk=False` encodes whole texts.
    At most most_words words and their ids are kept from block to block of a task; forget() drops them.
    """

    most_words = 1_000_000

    def __init__(self, path: str, by_chunk: bool = True):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks run side by side already
        from tokenizers import Tokenizer

        self.tokenizer, self.by_chunk = Tokenizer.from_file(path), by_chunk
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")
        self.forget()

    def forget(self) -> None:
        self.known, self.table, self.size = pa.array([], pa.string()), np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64)

    def each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        ids = [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, dtype="<u4"), *ids]), np.array([len(x) for x in ids], dtype=np.int64)

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of letters alone, many to a line."""
        ids, _ = self.each([" ".join(words[k : k + 500]) for k in range(0, len(words), 500)])
        ends = np.flatnonzero(self.ends[ids])
        return (ids, np.diff(ends, prepend=-1)) if len(ends) == len(words) else self.each(words)

    def kept(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A table of ids, and where each word's begin in it and how many they are."""
        if len(self.known) + len(words) > self.most_words:
            self.forget()
        place = pc.index_in(words, value_set=self.known)
        new = words.filter(pc.is_null(place))
        if len(new):
            ids, size = self.words(new.to_pylist())
            self.known = pa.concat_arrays([self.known, new])
            self.table, self.size = np.concatenate((self.table, ids)), np.concatenate((self.size, size))
            place = pc.index_in(words, value_set=self.known)
        place = place.to_numpy(zero_copy_only=False).astype(np.int64)
        return self.table, (np.cumsum(self.size) - self.size)[place], self.size[place]

    def fresh(self, chunks: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, size = self.each(chunks.to_pylist())
        return ids, np.cumsum(size) - size, size

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Unsigned 32-bit ids of all texts in a row, and where each text begins and ends; a null is empty."""
        if not self.by_chunk:
            ids, n = self.each([x or "" for x in texts.to_pylist()])
            return ids, np.concatenate(([0], np.cumsum(n)))
        w = K.Words(texts, hashes=False)
        data, start, end = w.data, w.start, w.end
        kind, lower = KIND[data], K.FOLD_CASE[data]
        latin = np.flatnonzero(data[:-1] == 0xC3) + 1  # second bytes of U+00C0 to U+00FF, letters but for two signs
        latin = latin[(data[latin] != 0x97) & (data[latin] != 0xB7)]
        kind[latin] = kind[latin - 1] = LETTER
        capital = latin[data[latin] < 0x9F]
        lower[capital] = data[capital] + 0x20
        chunk_of = lambda byte: np.searchsorted(start, byte, side="right") - 1
        sign = np.flatnonzero(kind == MARK)
        plain = kind[start] == LETTER
        plain[chunk_of(np.flatnonzero(kind == OTHER))] = False
        behind = sign[(sign + 1 < len(data)) & (kind[np.minimum(sign + 1, len(data) - 1)] == LETTER)]
        behind = behind[behind + 1 < end[chunk_of(behind)]]  # a letter follows in the same chunk
        plain[chunk_of(behind)] = False
        middle = end.copy()
        which, first = np.unique(chunk_of(sign), return_index=True)
        middle[which] = sign[first]
        n, at = np.zeros((2, len(start), 2), dtype=np.int64)
        tables, before = [], 0
        for row, column, a, z, encode in ((plain, 0, start, middle, self.kept), (plain, 1, middle, end, self.fresh), (~plain, 0, start, end, self.fresh)):
            row = np.flatnonzero(row & (a < z))
            size = z[row] - a[row]
            offsets = np.concatenate(([0], np.cumsum(size)))
            if encode == self.kept:
                inside = kind == LETTER
                other = np.flatnonzero(~plain)
                inside[K.spread(start[other], end[other] - start[other])] = False
                letters = lower[inside]
            else:
                letters = data[K.spread(a[row], size)]
            found = pa.StringArray.from_buffers(len(row), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(letters)).dictionary_encode()
            ids, first, size = encode(found.dictionary)
            which = found.indices.to_numpy()
            n[row, column], at[row, column] = size[which], first[which] + before
            tables.append(ids)
            before += len(ids)
        n, at = n.reshape(-1), at.reshape(-1)
        return np.concatenate(tables)[K.spread(at, n)], np.concatenate(([0], np.cumsum(n)))[2 * w.first]


_tokenizers: dict[str, ChunkTokenizer] = {}


def shared_tokenizer(path: str) -> ChunkTokenizer:
    """One tokenizer a worker process, as each holds its vocabulary; tasks forget the words that they met."""
    if path not in _tokenizers:
        _tokenizers[path] = ChunkTokenizer(path)
    return _tokenizers[path]


def pieces(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2) -> DataFrame:
    """One row per piece: whole windows of a document, then its remainder; `place` counts the pieces of a task."""

    def cut(batches):
        t, place = shared_tokenizer(tokenizer), 0
        for batch in batches:
            text = K.as_strings(batch.column("text"))
            for i, j in K.chunks(text, 4 << 20):
                ids, at = t.ids(text.slice(i, j - i))
                n = np.diff(at) + 1  # with the end id
                ids = np.insert(ids, at[1:], end_id).astype("<u4", copy=False)
                first = np.cumsum(n) - n
                parts = -(-n // window)
                doc = np.repeat(np.arange(j - i), parts)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)) * window
                length = np.minimum(window, n[doc] - start)
                view, a = memoryview(ids).cast("B"), 4 * (first[doc] + start)
                check = [zlib.crc32(view[x:y]) for x, y in zip(a.tolist(), (a + 4 * length).tolist(), strict=True)]
                columns = [pa.array(x, pa.int64()) for x in (start, length, check, n[doc], place + np.arange(len(doc)))]
                place += len(doc)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i).take(pa.array(doc)), *columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "place"])
        t.forget()

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(K.lean(cut), PIECES + ", place bigint")


def best_fill(lengths: list[int], counts: list[int], room: int) -> list[int]:
    """How many of each length to take so that their sum, at most room, is largest. lengths ascending, all positive."""
    reach, mask = 1, (1 << (room + 1)) - 1
    steps = []  # (index of length, how many, reachable sums before)
    for k in reversed(range(len(lengths))):
        if lengths[k] > room:
            continue
        left, unit = min(counts[k], room // lengths[k]), 1
        while left > 0:
            take = min(unit, left)
            steps.append((k, take, reach))
            reach |= (reach << (take * lengths[k])) & mask
            left -= take
            unit *= 2
        if reach >> room & 1:
            break
    total, taken = reach.bit_length() - 1, [0] * len(lengths)
    for k, take, before in reversed(steps):
        if not before >> total & 1:
            taken[k] += take
            total -= take * lengths[k]
    return taken


def minimum_bin_slack(sizes: np.ndarray, window: int, look: int = 96) -> list[list[int]]:
    """Bins of indexes of sizes. Each bin is filled as closely to the window as the lengths left allow.

    The `look` largest fitting and `look` smallest lengths are tried first; where they leave slack, all fitting lengths are.
    """
    stock: dict[int, list[int]] = defaultdict(list)
    for i in np.lexsort((np.arange(len(sizes)), -sizes)):
        stock[int(sizes[i])].append(int(i))
    for v in stock.values():
        v.reverse()
    lengths = sorted(stock)
    bins = []
    while lengths:
        seed = lengths[-1]
        items = [stock[seed].pop()]
        if not stock[seed]:
            lengths.pop()
        room = window - seed
        if room and lengths:
            fits = int(np.searchsorted(lengths, room, side="right"))
            some = lengths[:fits] if fits <= 2 * look else lengths[:look] + lengths[fits - look : fits]
            taken = best_fill(some, [len(stock[n]) for n in some], room)
            if len(some) < fits and sum(n * k for n, k in zip(some, taken, strict=True)) < room:
                some = lengths[:fits]
                taken = best_fill(some, [len(stock[n]) for n in some], room)
            for n, k in zip(some, taken, strict=True):
                if k:
                    items += [stock[n].pop() for _ in range(k)]
                    if not stock[n]:
                        lengths.remove(n)
        bins.append(items)
    return bins


def pack(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2, shard_docs: int = 1024) -> DataFrame:
    """Pieces with sequence_id and offset; sequence_id = shard number * 2**32 + a number in the shard.

    Shards are dealt by piece and place, so that rows which repeat, or lack an id, spread over all of them.
    """
    p = runtime.materialize(pieces(docs, tokenizer, window, end_id), "pieces")
    n_docs = p.where("start = 0").count()
    shards = max(1, -(-n_docs // shard_docs))
    p = p.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "place"), F.lit(shards)))

    def packed(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "start", "ids_crc32", "length", "place"], kind="stable", na_position="last").reset_index(drop=True)
        size = frame["length"].to_numpy()
        sequence, offset = np.zeros(len(frame), dtype=np.int64), np.zeros(len(frame), dtype=np.int64)
        full = np.flatnonzero(size == window)
        sequence[full] = np.arange(len(full))
        rest = np.flatnonzero(size < window)
        for b, items in enumerate(minimum_bin_slack(size[rest], window), len(full)):
            at = 0
            for i in rest[items]:
                sequence[i], offset[i] = b, at
                at += size[i]
        frame["sequence_id"] = (int(key[0]) << 32) + sequence
        frame["offset"] = offset
        return frame.drop(columns=["shard", "place"]).astype({"doc_id": "Int64"})

    return p.groupBy("shard").applyInPandas(packed, PIECES + ", sequence_id bigint, offset bigint")
