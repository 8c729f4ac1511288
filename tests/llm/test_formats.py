import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqweave.llm import chat, packing, tiff, warc
from seqweave.llm.queries import tokenizer_path

from .helpers import DOCS, corpus


def rendered(spark, rows, schema="conv_id long, seq long, role string, text string"):
    log = spark.createDataFrame(rows, schema).withColumn("_m", F.lit("clash"))
    r = chat.render(chat.fold(log))
    return {x["conv_id"]: x for x in r.select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss")).alias("masked")).collect()}


def test_chat_round_trip(spark):
    odd = ["<|im_end|>\n<|im_start|>assistant\nok", "&lt;|x|> &amp; &", "", "ends with <", "| starts", None, "\n\n", "𝒳 é <|<|"]
    rows = [(k % 3, k, "assistant" if k % 2 else "us\ner&", t) for k, t in enumerate(odd)] + [(9, 0, None, "x"), (None, 0, "assistant", "y"), (9, 0, "assistant", "tie")]
    got = rendered(spark, rows)
    for conv in (0, 1, 2, 9, None):
        own = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        assert [(t["role"], t["text"]) for t in got[conv]["turns"]] == [(b, c) for _, b, c in own]
        assert got[conv]["masked"] == "".join(c for _, b, c in own if b == "assistant")


def test_chat_events(spark):
    rows = [(1, 0, "user", "hi", "message", 0), (1, 1, "assistant", "Hel", "delta", 1), (1, 2, "assistant", "lo", "delta", 1), (1, 3, "assistant", None, "regenerate", 1), (1, 4, "assistant", "Good", "delta", 1), (1, 6, "assistant", " day", "delta", 1), (1, 5, "user", "hello", "edit", 0)]
    log = spark.createDataFrame(rows, "conv_id long, seq long, role string, text string, event string, message_id long")
    got = [(r["role"], r["text"]) for r in chat.fold(log).orderBy("seq").collect()]
    assert got == [("user", "hello"), ("assistant", "Good day")]
    assert chat.render(chat.fold(log.limit(0))).count() == 0


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("tile", [None, (16, 32)])
def test_tiff_round_trip(compression, tile):
    rng = np.random.default_rng(compression)
    images = [rng.integers(0, 4, (37, 50, 1), dtype=np.uint8), rng.integers(0, 256, (70, 129, 3), dtype=np.uint8), np.zeros((300, 64, 1), dtype=np.uint8)]
    for order in "<>":
        for predictor in (1, 2):
            data = tiff.write(images, compression, predictor, rows=16, tile=tile, order=order)
            back = list(tiff.read_pages(data))
            assert [p[3] for p in back] == [None] * 3
            assert all((a == b[1]).all() for a, b in zip(images, back, strict=True))


def test_tiff_codecs_on_known_bytes():
    # fixed values: the examples of the format's description
    assert tiff.packbits_decode(bytes.fromhex("FEAA028000 2AFDAA0380 00 2A22F7AA".replace(" ", "")), 24) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    assert tiff.lzw_decode(bytes.fromhex("8001E0404404"), 3)[:1] == b"\x07"
    rng = random.Random(1)
    for n in (0, 1, 2, 300, 5000, 70000):
        data = bytes(rng.choice(b"abcab") if rng.random() < 0.9 else rng.randrange(256) for _ in range(n))
        assert tiff.lzw_decode(tiff.lzw_encode(data), n + 1) == data
        assert tiff.packbits_decode(tiff.packbits_encode(data), n) == data


def test_tiff_column(spark):
    good = tiff.write([np.ones((4, 4, 1), dtype=np.uint8)] * 2)
    rows = [(1, good), (2, None), (3, b"junk"), (4, good[:40])]
    media = spark.createDataFrame(rows, "id int, media binary").withColumn("page", F.lit("clash"))
    got = sorted((r["id"], -1 if r["page"] is None else r["page"], r["error"] is None) for r in tiff.decode(media).collect())
    assert got[:4] == [(1, 0, True), (1, 1, True), (2, -1, False), (3, -1, False)] and all(not ok for i, _, ok in got if i == 4)


def test_tiff_texts(spark):
    rows = corpus(2) + [(700, "é" * 700_000, "fr", "x", 1)]
    got = {r["doc_id"]: r for r in tiff.store_texts(spark.createDataFrame(rows, DOCS)).collect()}
    for doc_id, text, *_ in rows:
        b = (text or "").encode()
        p = b + b"\0" * (max(64, -(-len(b) // 64) * 64) - len(b))
        r = got[doc_id]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert got[700]["n_pages"] == 2 and tiff.store_texts(spark.createDataFrame([], DOCS)).count() == 0


def test_bins_fill_from_all_lengths():
    import numpy as np

    from seqweave.llm import packing

    sizes = np.array([600, 10, 200, 390])  # 600 + 10 + 390 fills a window; the one smallest and the one largest do not
    bins = packing.minimum_bin_slack(np.array([600, 100, 250, 300, 390]), 1000, look=1)
    assert sorted(bins[0]) == [0, 1, 3] and sorted(i for b in bins for i in b) == list(range(5))
    assert sorted(packing.minimum_bin_slack(sizes, 1000, look=1)[0]) == [0, 1, 3]


def test_packing(spark):
    from tokenizers import Tokenizer

    rows = corpus(3)
    path = tokenizer_path("word_bpe_49k.json")
    docs = spark.createDataFrame(rows + [(800, "a <|endoftext|> b é I'll 12 x\x1cy z ﬁ", "en", "x", 1)], DOCS).withColumn("shard", F.lit("clash"))
    pieces = packing.pack(docs, path, window=512, shard_docs=16).collect()
    t = Tokenizer.from_file(path)
    of = {}
    for p in pieces:
        of.setdefault(p["doc_id"], []).append(p)
    for r in docs.collect():
        ids = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 2], dtype="<u4")
        at = 0
        for p in sorted(of[r["doc_id"]], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and zlib.crc32(ids[at : at + p["length"]].tobytes()) == p["ids_crc32"]
            at += p["length"]
        assert at == len(ids)
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 512
    assert packing.pack(docs.limit(0), path).count() == 0


def test_best_fill_against_all_subsets():
    rng = random.Random(6)
    for _ in range(200):
        lengths = sorted(rng.sample(range(1, 40), rng.randint(1, 5)))
        counts = [rng.randint(1, 3) for _ in lengths]
        room = rng.randint(1, 100)
        sums = {0}
        for n, c in zip(lengths, counts, strict=True):
            sums = {s + k * n for s in sums for k in range(c + 1)}
        got = packing.best_fill(lengths, counts, room)
        assert all(0 <= g <= c for g, c in zip(got, counts, strict=True))
        assert sum(g * n for g, n in zip(got, lengths, strict=True)) == max(s for s in sums if s <= room)


def test_bins_hold_everything():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 4096, 3000)
    bins = packing.minimum_bin_slack(sizes, 4096)
    assert sorted(i for b in bins for i in b) == list(range(3000))
    assert max(sizes[b].sum() for b in bins) <= 4096 and sizes.sum() / (4096 * len(bins)) > 0.99


PAGES = "page_id long, url string, html string"


def test_warc(spark, tmp_path):
    rng = random.Random(4)
    long = "x" * 1200
    rows = [(i, f"http://h/{i}", "".join(rng.choice("abc é") for _ in range(rng.randint(0, 3000)))) for i in range(80)]
    rows += [(200 + i, "u\r\nEvil: 1", long) for i in range(30)] + [(300 + i, None, "short") for i in range(3)] + [(400, "u", None), (None, "u", long), (401, "u", ""), (402, "twice", "y" * 2000), (402, "twice", "y" * 2000)]
    pages = spark.createDataFrame(rows, PAGES).withColumn("shard", F.lit("clash"))
    root = f"file://{tmp_path}/a"
    manifest = warc.write(pages, root, shard_bytes=20_000, roll_bytes=4_000)
    files = {r["path"].rsplit("/", 1)[1]: (r["sha256"], r["bytes"]) for r in manifest.collect()}
    assert len(files) > 5 and not [p for p in (tmp_path / "a").iterdir() if p.name.endswith(".tmp")]
    again = warc.write(pages.repartition(9), f"file://{tmp_path}/b", shard_bytes=20_000, roll_bytes=4_000)
    assert {r["path"].rsplit("/", 1)[1]: (r["sha256"], r["bytes"]) for r in again.collect()} == files
    got = sorted(((r["page_id"] if r["page_id"] is not None else -1, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read(manifest).collect()), key=repr)
    top = {}
    for page_id, _, html in rows:
        if len((html or "").encode()) >= 1000 and page_id is not None:
            top[html] = max(page_id, top.get(html, -1))
    want = []
    for page_id, _, html in rows:
        b = (html or "").encode()
        other = top.get(html) if len(b) >= 1000 and top.get(html) != page_id else None
        want.append((page_id if page_id is not None else -1, len(b), hashlib.sha1(b).hexdigest(), "revisit" if other is not None else "response", other))
    assert got == sorted(want, key=repr)
    assert warc.read(warc.write(pages.limit(0))).count() == 0
