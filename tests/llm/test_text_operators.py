from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from seqweave.llm import line_rules, parity_join, suffix_dedup

from .helpers import DOCS, corpus, prose, words


def repeat_words(w, k=5):
    c, inside = Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)), set()
    for i in range(len(w) - k + 1):
        if c[tuple(w[i : i + k])] > 1:
            inside.update(range(i, i + k))
    return len(inside)


def test_line_rules(spark):
    rows = corpus(3)
    rows += [(500, "a b c d e f g\n" * 6, "en", "x", 1), (501, "BUY!! NOW!! CHEAP!! THINGS!! TODAY!!\nThis line is fine and it ends well.", "en", "x", 1), (502, "home | about | shop | news\n" * 2, "en", "x", 1), (503, "a a a a a a a a a a a a", "en", "x", 1), (504, "Good words stand here and they end.\nAll rights reserved by nobody at all.", "en", "x", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("kept", F.lit("clash")).withColumn("_lines", F.lit(1))
    got = {r["doc_id"]: r for r in line_rules.judge(docs).collect()}
    assert len(got) == len(rows)
    for doc_id, text, *_ in rows:
        r, w, t = got[doc_id], words(text), text or ""
        lines = [x for x in t.split("\n") if words(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"))
        assert r["n_dup_lines"] == len(lines) - len(set(lines)) and r["n_repeat_words"] == repeat_words(w)
        assert r["base_failed"] == (len(w) < 10 or 100 * r["n_repeat_words"] > 20 * len(w))
        assert not (r["base_failed"] and r["kept"])
    assert got[501]["text_clean"] == "This line is fine and it ends well."
    assert got[504]["text_clean"] == "Good words stand here and they end."
    assert got[502]["text_clean"] == "" and got[0]["kept"]
    assert line_rules.judge(docs.limit(0)).count() == 0


def brute_components(rows, n, percent):
    sets = {}
    for doc_id, text, *_ in rows:
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets[doc_id] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            same = len(sets[a] & sets[b])
            if same and 100 * same >= percent * (len(sets[a]) + len(sets[b]) - same):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_parity_join(spark, n, percent):
    import random

    rng = random.Random(n)
    rows = [r for r in corpus(4) if r[0] is not None]
    for k in range(60):  # chains of ever more distant copies, of all sizes
        t = rows[rng.randrange(len(rows) - 8)][1]
        w = (t or "a b c").split(" ")
        for _ in range(rng.randint(0, max(1, len(w) // 30))):
            w[rng.randrange(len(w))] = rng.choice(["new", "word", "here"])
        rows.append((1000 + k, " ".join(w).upper() if k % 7 == 0 else " ".join(w), "en", "c", 1))
    docs = spark.createDataFrame(rows, DOCS).withColumn("n", F.lit("clash")).withColumn("rep", F.lit(1))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in parity_join.components(docs, n, percent).collect()}
    assert got == brute_components(rows, n, percent)


def test_parity_join_edge_rows(spark):
    assert parity_join.components(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(None, "a b c d e f", "en", "x", 1), (3, "a b c d e f", "en", "x", 1), (3, "a b c d e f", "en", "x", 1), (4, None, None, None, None), (2, "a b c d e f", "en", "x", 1)]
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in parity_join.components(spark.createDataFrame(rows, DOCS)).collect() if r["doc_id"] is not None)
    assert got == [(2, 2, 2), (3, 2, 2), (3, 2, 2), (4, 0, 4)]


def test_repeated_ids_with_different_texts(spark):
    import random

    rng = random.Random(12)
    a, b, c = (prose(rng, 120).split(" ") for _ in range(3))
    near = [*b[:60], "changed", *b[61:]]
    a, b, c, near = (" ".join(x) for x in (a, b, c, near))
    rows = [(3, a), (5, a), (5, b), (9, near), (7, c), (7, ""), (None, a), (None, c)]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], DOCS)
    got = sorted((r["doc_id"], r["component_id"]) for r in parity_join.components(docs).where("doc_id is not null").collect())
    assert got == [(3, 3), (5, 3), (5, 3), (7, 7), (7, 7), (9, 3)]
    rows = [(3, a), (5, a), (5, b), (8, b), (9, near), (10, c)]  # the class of b stands for itself by a row whose id is a copy elsewhere
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], DOCS)
    got = sorted((r["doc_id"], r["component_id"]) for r in parity_join.components(docs).collect())
    assert got == [(3, 3), (5, 3), (5, 3), (8, 3), (9, 3), (10, 10)]


def test_only_the_copied_text_steps_aside(spark):
    import random

    rng = random.Random(13)
    a, b, shared = prose(rng, 90), prose(rng, 90), prose(rng, 60)
    c = " ".join([prose(rng, 20), shared])
    rows = [(3, a), (5, a), (5, b), (6, " ".join([shared, prose(rng, 30)])), (7, c), (7, b[: len(b) // 8]), (8, c), (8, a)]
    rows = [(*r, "en", "s", len(r[1])) for r in rows]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    assert sorted(map(tuple, suffix_dedup.passages(docs).collect())) == brute_spans(rows, 50)
    kept = sorted((r["doc_id"], r["text"]) for r in suffix_dedup.without_repeats(docs).collect())
    cut = c[: -len(shared)]
    assert [(i, t.strip()) for i, t in kept] == sorted([(3, a), (5, b), (6, rows[3][1]), (7, cut.strip()), (7, rows[5][1].strip())])


def test_sketch_distance_is_a_lower_bound():
    import numpy as np

    rng = np.random.default_rng(1)
    for size in (1, 30, 300, 700, 3000):
        for other in (size, size + size // 7):
            a, b = (np.unique(rng.integers(0, 2 * size, n).astype(np.uint64)) for n in (size, other))
            x, y = (parity_join.folded_sketch(parity_join.K.mix(s)) for s in (a, b))
            assert parity_join.distance(x, y) <= len(np.setxor1d(a, b))


def brute_passages(rows, least):
    where = defaultdict(set)
    for doc_id, text, *_ in rows:
        w = words(text)
        for i in range(len(w) - least + 1):
            where[tuple(w[i : i + least])].add(doc_id)
    out = {}
    for doc_id, text, *_ in rows:
        w, inside = words(text), set()
        for i in range(len(w) - least + 1):
            if len(where[tuple(w[i : i + least])]) > 1:
                inside.update(range(i, i + least))
        if inside:
            out[doc_id] = inside
    return out


@pytest.mark.parametrize("least", [50, 24])
def test_repeated_passages(spark, least):
    rows = corpus(5)
    docs = spark.createDataFrame(rows, DOCS).withColumn("at", F.lit("clash")).withColumn("start", F.lit(1)).repartition(5)
    got = defaultdict(set)
    for r in suffix_dedup.passages(docs, least).collect():
        assert r["n_words"] == r["end"] - r["start"] >= least and r["first_doc_id"] <= r["doc_id"]
        got[r["doc_id"]].update(range(r["start"], r["end"]))
    assert got == brute_passages(rows, least)


def brute_spans(rows, least):
    """Rows of passages(): windows that another document has too, joined where they touch, with the first document of all."""
    where, starts = defaultdict(set), defaultdict(dict)
    for doc_id, text, *_ in rows:
        w = words(text)
        for i in range(len(w) - least + 1):
            where[tuple(w[i : i + least])].add(doc_id)
    for doc_id, text, *_ in rows:
        w = words(text)
        for i in range(len(w) - least + 1):
            owners = where[tuple(w[i : i + least])]
            if len(owners) > 1:
                starts[doc_id][i] = min(min(owners), starts[doc_id].get(i, doc_id))
    out = []
    for doc_id, found in starts.items():
        spans = []
        for i in sorted(found):
            if spans and i <= spans[-1][1]:
                spans[-1] = [spans[-1][0], i + least, min(spans[-1][2], found[i])]
            else:
                spans.append([i, i + least, found[i]])
        out += [(doc_id, a, b, b - a, first) for a, b, first in spans]
    return sorted(out)


def test_copies_share_first_documents(spark):
    import random

    rng = random.Random(11)
    shared = prose(rng, 60)
    text = " ".join([prose(rng, 40), shared, prose(rng, 40)])
    rows = [(3, " ".join([prose(rng, 30), shared, prose(rng, 30)])), (10, text), (20, text), (30, prose(rng, 80)), (40, " ".join([prose(rng, 70), shared]))]
    rows = [(*r, "en", "s", len(r[1])) for r in rows] + [(100 + r[0], *r[1:]) for r in corpus(5)]
    got = sorted(map(tuple, suffix_dedup.passages(spark.createDataFrame(rows, DOCS).repartition(3)).collect()))
    assert got == brute_spans(rows, 50)
    assert {r[0]: r[4] for r in got if r[0] < 100} == {3: 3, 10: 3, 20: 3, 40: 3}


def test_cutting_repeats(spark):
    rows = corpus(6)
    docs = spark.createDataFrame(rows, DOCS)
    out = suffix_dedup.without_repeats(docs)
    assert out.columns == docs.columns
    kept = {r["doc_id"]: r["text"] for r in out.collect()}
    left = [(i, t) for i, t in kept.items()]
    assert not brute_passages(left, 50)
    touched = brute_passages(rows, 50)
    texts = {r[0]: r[1] for r in rows}
    for i, t in texts.items():
        if i not in touched and words(t):
            assert kept[i] == t
    assert min(touched) in kept and kept[min(touched)] == texts[min(touched)]
    assert suffix_dedup.without_repeats(docs.limit(0)).count() == 0
