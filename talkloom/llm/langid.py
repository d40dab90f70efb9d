"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed character n-grams of one to three characters, lower-cased; a feature's value
is its share of the text's n-grams times its inverse document frequency, so that a text's logits
are means of table entries over its positions. Weights are trained with follow-the-regularised-
leader (per-coordinate, proximal) with elastic-net penalties; a temperature fitted on a part of
the sample that training leaves out calibrates the probabilities.

The classifier is fitted on the driver on a bounded sample of labelled rows: of every language that
occurs, PER_LANGUAGE distinct texts (all, where it has fewer), chosen by a hash of the text, so that
copies count once. With more than MANY_LANGUAGES languages each has a smaller share, LEAST_SHARE
at least. Of a longer text the fit sees the first MAX_CHARS characters from its first letter on. Prediction reads every text whole.

Defined results: "und" with score 0 where the text is null or has no letter, and everywhere if
no labelled row exists. Ties go to the language first in order. Repeated rows are judged alike; texts of
any length are read in pieces; an empty table gives no rows; columns named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkloom.llm.common import received, share, small_batches

BITS = 16
ORDERS = (1, 2, 3)
PER_LANGUAGE, MANY_LANGUAGES, LEAST_SHARE, MAX_CHARS = 500, 64, 20, 10_000
UNKNOWN = "und"
#: Characters whose n-grams are looked up at once.
_BLOCK = 1 << 18
_MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def hashed(codes: np.ndarray, n: int) -> np.ndarray:
    """A feature for each n-gram of the code points."""
    m = len(codes) - n + 1
    if m <= 0:
        return np.zeros(0, np.intp)
    h = codes[:m] * np.uint32(_MULTIPLIERS[0])
    for k in range(1, n):
        h = (h ^ (h >> np.uint32(15))) * np.uint32(_MULTIPLIERS[1]) + codes[k : m + k] * np.uint32(_MULTIPLIERS[2])
    h = (h + np.uint32(n)) * np.uint32(_MULTIPLIERS[0])
    return (h >> np.uint32(32 - BITS)).astype(np.intp)


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # by feature and language: inverse document frequency times weight
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, text: str) -> np.ndarray:
        codes = codes_of(text)
        total, n = np.zeros(len(self.languages)), 0
        for i in range(0, len(codes), _BLOCK):
            part = codes[i : i + _BLOCK + max(ORDERS) - 1]
            for k in ORDERS:
                h = hashed(part[: _BLOCK + k - 1], k)
                total += np.take(self.table, h, axis=0).sum(0, dtype=np.float64)
                n += len(h)
        return total / max(1, n) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        k = int(p.argmax())
        return self.languages[k], float(p[k] / p.sum())


def fit(rows: list[tuple[str, str]], epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, scale: float = 30.0) -> Model:
    """rows: (text, language), in an order that doesn't depend on the language."""
    rows = [(t, lang) for t, lang in rows if any(map(str.isalpha, t or ""))]
    languages = sorted({lang for _, lang in rows})
    size, n_lang = 1 << BITS, len(languages)
    if not rows:
        return Model([], np.zeros((size, 0), np.float32), np.zeros(0))
    found = []
    for text, _ in rows:
        codes = codes_of(text)
        grams, counts = np.unique(np.concatenate([hashed(codes, k) for k in ORDERS]), return_counts=True)
        found.append((grams, counts / counts.sum()))
    y = [languages.index(lang) for _, lang in rows]
    held = np.arange(len(rows)) % 5 == 4 if len(rows) >= 20 else np.zeros(len(rows), bool)
    df = np.bincount(np.concatenate([g for g, _ in found]), minlength=size)
    idf = np.log((1 + len(rows)) / (1 + df)) + 1
    z, n = np.zeros((size, n_lang)), np.zeros((size, n_lang))
    bz, bn = np.zeros(n_lang), np.zeros(n_lang)

    def weights(z: np.ndarray, n: np.ndarray, l1: float, l2: float) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for (grams, share), k in ((found[i], y[i]) for i in range(len(rows)) if not held[i]):
            x = share * idf[grams] * scale
            w, b = weights(z[grams], n[grams], l1, l2), weights(bz, bn, 0.0, l2)
            s = x @ w + b
            p = np.exp(s - s.max())
            p /= p.sum()
            p[k] -= 1
            g = x[:, None] * p
            z[grams] += g - (np.sqrt(n[grams] + g * g) - np.sqrt(n[grams])) / alpha * w
            n[grams] += g * g
            bz += p - (np.sqrt(bn + p * p) - np.sqrt(bn)) / alpha * b
            bn += p * p
    model = Model(languages, (weights(z, n, l1, l2) * idf[:, None] * scale).astype(np.float32), weights(bz, bn, 0.0, l2))
    if held.any():
        s = np.array([model.logits(rows[i][0]) for i in np.flatnonzero(held)])
        k = np.array(y)[held]

        def loss(t: float) -> float:
            q = s / t
            q = q - q.max(1, keepdims=True)
            return float((np.log(np.exp(q).sum(1)) - q[np.arange(len(k)), k]).mean())

        model.temperature = float(min(np.geomspace(0.1, 10, 61), key=loss))
    return model


def sample(docs: DataFrame, learn: Column, text: str, lang: str) -> list[tuple[str, str]]:
    """The bounded training sample, of every language, in an order that doesn't depend on the language."""
    rows = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    # by a hash of the text: copies have one mark
    marked = rows.select("lang", "text", F.pmod(F.xxhash64("text"), F.lit(1 << 30)).alias("mark")).where(F.regexp_like("text", F.lit(r"\p{L}")))
    counts = {r["lang"]: r["n"] for r in marked.groupBy("lang").agg(F.approx_count_distinct("mark").alias("n")).collect()}
    if not counts:
        return []
    most = max(LEAST_SHARE, min(PER_LANGUAGE, PER_LANGUAGE * MANY_LANGUAGES // len(counts)))
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, int((1 << 30) * min(1.0, 2 * most / max(1, n))))])
    # about twice as many as are taken, so that the window below sees a bounded number of each language
    some = marked.where(F.col("mark") < F.element_at(share, F.col("lang"))).select("lang", "mark", F.substring(F.regexp_replace("text", r"^\P{L}+", ""), 1, MAX_CHARS).alias("text"))
    some = some.groupBy("lang", "mark").agg(F.min("text").alias("text"))
    chosen = some.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("mark"))).where(F.col("place") <= most)
    got = chosen.select("text", "lang", F.xxhash64("mark", "lang").alias("h")).collect()
    return [(r["text"], r["lang"]) for r in sorted(got, key=lambda r: (r["h"], r["lang"]))]


def train(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang") -> Model:
    return fit(sample(docs, learn, text, lang))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds lang_pred and score (the calibrated probability of lang_pred)."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = share(spark, model)  # 2**BITS floats a language: 256 KB for each
    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    plain = docs.select(*[c for c in docs.columns if c not in ("lang_pred", "score")])
    schema = T.StructType(plain.schema.fields + new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = received(shared)
        for batch in batches:
            got = [m.predict(s.as_py()) for s in batch.column(batch.schema.get_field_index(text))]
            cols = [pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=schema.names)

    return plain.mapInArrow(run, schema)
