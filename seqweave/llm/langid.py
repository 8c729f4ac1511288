"""Language ID: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

A text's subwords are byte n-grams of 2 to 4 (ASCII case and white space folded, so that n-grams know word edges), hashed
into buckets. Its vector is the mean of their embeddings; a linear layer and a softmax give languages and one class more,
noise. Noise is learnt from corrupted copies of the learning rows: letters shuffled within the text, or each letter replaced
by another throughout (the shape of an unknown language). Crops are learnt beside whole texts, so that short texts are told.

Rejection is calibrated on rows left out of the descent, with their crops and corrupted copies, in bands of text length. A
temperature is fitted to all of them; a band's least score is the smaller of two: the one that at most FALSE_ACCEPT of the
corrupted copies reach, and 0.8 times the one that all but FALSE_REJECT of the true texts reach, so that clean text is kept
where both cannot be had. `score` is the probability of the best language; below the least, `accepted` is false.

Prediction folds embedding and layer into one table of a logit per bucket and class, so whole texts cost a table look-up
per n-gram and no shuffle. The fit takes at most most_rows rows (smallest md5 of their id, one row an id).

Defined results: null text or no letter: `und`, score 0, not accepted; null lang is not learnt from; with no language to
learn, every text is `und`; equal logits go to the language first in code-point order; repeated rows are predicted alike; of
an id that repeats with different texts one (of the smallest hash) is learnt from; columns of the input that are named like
the new ones are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K

BITS = 16
ORDERS = (2, 3, 4)
UNKNOWN = "und"
FALSE_ACCEPT, FALSE_REJECT = 0.01, 0.0005
#: Lower bounds, in n-grams, of the bands of text length that have a least score each.
LENGTHS = (0, 48, 160, 640)
CROP, CORRUPT = 160, 480  # most characters of a crop and of a corrupted copy


def grams(data: np.ndarray) -> list[np.ndarray]:
    folded = K.FOLD_CASE[data]
    return [K.byte_ngrams(folded, n, BITS, 1000 + n) for n in ORDERS]


def counted(array: pa.Array):
    """(buckets, counts) of each text."""
    for i, j in K.chunks(array):
        data, at = K.raw(array.slice(i, j - i))
        of = grams(data)
        for d in range(j - i):
            a, b = at[d], at[d + 1]
            h = np.concatenate([g[a : max(a, b - n + 1)] for n, g in zip(ORDERS, of, strict=True)])
            yield np.unique(h, return_counts=True)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # buckets x classes: logits of one subword; the last class is noise
    bias: np.ndarray
    temperature: float
    least: np.ndarray  # by band of length
    rates: tuple[float, float] = (0.0, 0.0)  # shares of corrupted copies accepted and of true texts rejected, of rows left out

    def logits(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Logits of each text, and its number of n-grams."""
        out, count = np.zeros((len(array), len(self.bias))), np.zeros(len(array))
        for i, j in K.chunks(array):
            data, at = K.raw(array.slice(i, j - i))
            for n, g in zip(ORDERS, grams(data), strict=True):
                a = at[:-1]
                b = np.maximum(a, at[1:] - n + 1)
                count[i:j] += b - a
                for c in range(len(self.bias)):
                    p = np.concatenate(([0.0], np.cumsum(self.table[:, c][g], dtype=np.float64)))
                    out[i:j, c] += p[np.minimum(b, len(g))] - p[np.minimum(a, len(g))]
        return out / np.maximum(count, 1)[:, None] + self.bias, count

    def predict(self, array: pa.Array, letters: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and acceptance of each text; letters tells which texts have one."""
        if not self.langs:
            return [UNKNOWN] * len(array), np.zeros(len(array)), np.zeros(len(array), dtype=bool)
        z, count = self.logits(array)
        p = softmax(z / self.temperature)[:, : len(self.langs)]
        best = p.argmax(axis=1)
        score = np.where(letters, p[np.arange(len(p)), best], 0.0)
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best, letters, strict=True)], score, letters & (score >= self.least[band(count)])


def band(count: np.ndarray) -> np.ndarray:
    return np.searchsorted(LENGTHS, count, side="right") - 1


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], langs: list[str | None], held: np.ndarray, dim: int = 16, sweeps: int = 6, rate: float = 8.0, seed: int = 11) -> Model:
    """rows: (buckets, counts) of texts; langs: their languages, None for noise; held: rows to calibrate on, not to learn."""
    names = sorted({x for x in langs if x is not None})
    if not names:
        return Model([], np.zeros((1 << BITS, 0)), np.zeros(0), 1.0, np.zeros(len(LENGTHS)))
    noise = len(names)
    y = np.array([noise if x is None else names.index(x) for x in langs])
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 1 / dim, (1 << BITS, dim)).astype(np.float32)
    layer = rng.normal(0, 1 / np.sqrt(dim), (dim, noise + 1)).astype(np.float32)
    bias = np.zeros(noise + 1, dtype=np.float32)
    learn, steps = np.flatnonzero(~held) if (~held).any() else np.arange(len(y)), 0
    for _ in range(sweeps):
        for i in rng.permutation(learn):
            found, n = rows[i]
            if not len(found):
                continue
            lr = rate * max(0.02, 1 - steps / (sweeps * len(learn)))
            steps += 1
            share = (n / n.sum()).astype(np.float32)
            mean = share @ embed[found]
            g = softmax(mean @ layer + bias).astype(np.float32)
            g[y[i]] -= 1
            back = layer @ g
            layer -= 0.1 * lr * np.outer(mean, g)
            bias -= 0.01 * lr * g
            embed[found] -= lr * share[:, None] * back[None, :]
    table = (embed @ layer).astype(np.float64)
    model = Model(names, table, bias.astype(np.float64), 1.0, np.zeros(len(LENGTHS)))
    check = [i for i in (np.flatnonzero(held) if held.any() else learn) if len(rows[i][0])]
    if check:
        calibrate(model, np.array([(rows[i][1] / rows[i][1].sum()) @ table[rows[i][0]] for i in check]) + model.bias, y[check], band(np.array([rows[i][1].sum() for i in check])))
    return model


def calibrate(model: Model, z: np.ndarray, y: np.ndarray, bands: np.ndarray) -> None:
    """Temperature and least scores of a model from logits, classes and bands of rows that it has not learnt."""
    heats = np.geomspace(0.05, 200, 145)
    right = np.arange(len(y)), y
    model.temperature = float(heats[np.argmin([-np.log(softmax(z / t)[right] + 1e-12).mean() for t in heats])])
    noise = y == len(model.langs)
    score = softmax(z / model.temperature)[:, :-1].max(axis=1)
    for k in range(len(LENGTHS)):
        true, false = score[(bands == k) & ~noise], score[(bands == k) & noise]
        if len(true):
            wanted = np.quantile(false, 1 - FALSE_ACCEPT) if len(false) else 0.0
            model.least[k] = min(float(wanted), 0.8 * float(np.quantile(true, FALSE_REJECT)))
    accepted = score >= model.least[bands]
    model.rates = (float(accepted[noise].mean()) if noise.any() else 0.0, float((~accepted[~noise]).mean()) if (~noise).any() else 0.0)


def corrupted(text: str, rng: np.random.Generator) -> str:
    """The text with its letters shuffled, or each replaced by another throughout."""
    letters = [c for c in text if c.isalpha()]
    if rng.random() < 0.5:
        mixed = iter(rng.permutation(np.array(letters, dtype=object)))
        return "".join(next(mixed) if c.isalpha() else c for c in text)
    kinds = sorted({c.lower() for c in letters})
    other = dict(zip(kinds, rng.permutation(np.array(kinds, dtype=object)), strict=True))
    return "".join(other.get(c.lower(), c) for c in text)


def crop(text: str, most: int, rng: np.random.Generator) -> str:
    """Some words in a row of a text, up to about `most` characters."""
    n = min(most, len(text))
    size = int(rng.integers(min(8, n), n + 1)) if n else 0
    start = int(rng.integers(0, len(text) - size + 1))
    start = text.find(" ", start, start + 20) + 1 or (0 if start < 20 else start)
    return text[start : start + size]


def train(docs: DataFrame, most_rows: int = 4000) -> Model:
    """docs: (doc_id, text, lang), rows to learn from; at most most_rows are used."""
    d = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    ids = d.select("doc_id").distinct().orderBy(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), "doc_id").limit(most_rows).withColumnRenamed("doc_id", "_id")
    sample = d.join(F.broadcast(ids), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    one = sample.groupBy("doc_id").agg(F.min_by(F.struct("text", "lang"), F.struct(F.xxhash64("text"), "lang")).alias("_row")).select("_row.text", "_row.lang")

    def extract(batches):
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                number = crc32(text.encode())
                rng = np.random.default_rng(number)
                part = crop(text, CROP, rng)
                made = [(text, lang), (part, lang), (corrupted(crop(text, CROP, rng), rng), None)]
                if number & 2:
                    made.append((corrupted(crop(text, CORRUPT, rng), rng), None))
                made = [x for x in made if any(map(str.isalpha, x[0]))]
                bags = list(counted(pa.array([x for x, _ in made], pa.string())))
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(made), pa.int64()), pa.array([x for _, x in made], pa.string()), *(pa.array([np.minimum(x[c], 0xFFFF).astype(np.uint16).tobytes() for x in bags], pa.binary()) for c in (0, 1))], names=["number", "lang", "found", "n"])

    got = one.mapInArrow(K.lean(extract), "number bigint, lang string, found binary, n binary").toArrow().sort_by([(c, "ascending") for c in ("number", "lang", "found")])
    rows = [(np.frombuffer(f.as_buffer(), dtype=np.uint16), np.frombuffer(c.as_buffer(), dtype=np.uint16)) for f, c in zip(got.column("found"), got.column("n"), strict=True)]
    number = got.column("number").to_numpy()
    held = number % 5 == 4 if len(np.unique(number)) >= 50 else np.zeros(len(number), dtype=bool)
    model = fit(rows, got.column("lang").to_pylist(), held)
    del got, rows
    K.give_back()
    return model


def predict(docs: DataFrame, model: Model, keep_text: bool = False) -> DataFrame:
    """docs (without text unless keep_text) with lang_pred, score (0 to 1) and accepted."""
    new = ("lang_pred", "score", "accepted")
    others = [c for c in docs.columns if c not in new and (keep_text or c != "text")]
    m = replace(model, table=model.table.astype(np.float32))

    def predicted(batches):
        for batch in batches:
            lang, score, ok = m.predict(K.as_strings(batch.column("text")), batch.column("_letters").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in others] + [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(ok, pa.bool_())], names=[*others, *new])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others)
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letters")
    columns = list(dict.fromkeys([*others, "text"]))
    return docs.select(*columns, letters).mapInArrow(K.lean(predicted), schema + ", lang_pred string, score double, accepted boolean")
