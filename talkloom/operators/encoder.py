"""From text to vectors: latent directions of hashed word counts, and a store of vectors by content.

A text is a sparse row: its words hashed to buckets, log(1 + count) times the bucket's inverse document frequency, of length 1. fit finds the
directions of the largest singular values of all rows by a randomised range finder with power steps: each step is one pass in which a
bounded number of tasks sum up A'(A Q) for their rows; Q (buckets x directions, some megabytes whatever the data) is made orthonormal on the
driver and broadcast. A text's vector is its row in these directions.

Vectors are kept by the SHA-256 of their text and by the model, so a text is encoded once, however many records have it and however often it is asked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom.functions import text as X
from talkloom.sources.scratch import written
from talkloom.sources.stores import _exists

#: Buckets of words, directions, directions beyond them while fitting, power steps, tasks of a pass, and entries and rows multiplied at a time.
BUCKETS, DIRECTIONS, SPARE, STEPS, TASKS, ENTRIES, ROWS = 1 << 13, 64, 16, 2, 256, 1 << 14, 512


@dataclass
class Encoder:
    idf: np.ndarray
    directions: np.ndarray  # buckets x directions

    @property
    def name(self) -> str:
        return hashlib.sha256(self.idf.tobytes() + self.directions.tobytes()).hexdigest()[:16]


def buckets_of(text: Column, buckets: int) -> Column:
    return F.transform(X.words(text), lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))


def _rows(lists: pa.Array, idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """The sparse rows of some texts, ENTRIES or one text at a time, and ROWS at most: row, bucket and value of the entries, and the number of rows."""
    offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype(np.int64)
    at = 0
    while at < len(lists):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + ENTRIES, "right")) - 1)
        to = min(to, at + ROWS, len(lists))
        row = np.repeat(np.arange(to - at), np.diff(offsets[at : to + 1]))
        keys, n = np.unique(row * len(idf) + flat[offsets[at] : offsets[to]], return_counts=True)
        row, bucket = np.divmod(keys, len(idf))
        value = np.log1p(n) * idf[bucket]
        norm = np.sqrt(np.bincount(row, value * value, to - at))
        yield row, bucket, value / np.where(norm > 0, norm, 1)[row], to - at
        at = to


def _dense(row: np.ndarray, bucket: np.ndarray, value: np.ndarray, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that the rows have, and the rows as a matrix of those alone, which is multiplied as a whole."""
    has = np.zeros(buckets, bool)
    has[bucket] = True
    used = np.flatnonzero(has)
    out = np.zeros((n, len(used)))
    out[row, (np.cumsum(has) - 1)[bucket]] = value
    return used, out


def _times(row: np.ndarray, bucket: np.ndarray, value: np.ndarray, n: int, q: np.ndarray) -> np.ndarray:
    """The rows in the directions q."""
    used, a = _dense(row, bucket, value, n, len(q))
    return a @ q[used]


def _summed(coded: DataFrame, idf: np.ndarray, q: np.ndarray, inner: bool) -> np.ndarray:
    """A'A q, or with inner q'A'A q, summed over all rows: by task in numpy, over tasks by Spark."""
    shared = coded.sparkSession.sparkContext.broadcast((idf, q))
    size = q.shape[1] if inner else len(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, q = shared.value
        total = np.zeros((size, q.shape[1]))
        for batch in batches:
            for row, bucket, value, n in _rows(batch.column(0), idf):
                used, a = _dense(row, bucket, value, n, len(q))
                y = a @ q[used]
                if inner:
                    total += y.T @ y
                else:
                    total[used] += a.T @ y
        some = np.flatnonzero(np.abs(total).sum(1))
        for i in range(0, len(some), 1024):
            part = some[i : i + 1024]
            values = pa.FixedSizeListArray.from_arrays(pa.array(total[part].ravel()), q.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(part), values], names=["i", "v"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)):
                sums[i] = sums[i] + v if i in sums else v.copy()
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["i", "v"])

    # rows of one bucket meet in one task: as many as there are tasks
    parts = coded.mapInArrow(run, "i long, v array<double>").repartition("i").mapInArrow(added, "i long, v array<double>").toArrow()
    out = np.zeros((size, q.shape[1]))
    if parts.num_rows:
        out[parts.column(0).to_numpy()] = np.concatenate([np.asarray(c.flatten()) for c in parts.column(1).chunks]).reshape(parts.num_rows, -1)
    return out


def fit(texts: DataFrame, text: str = "text", directions: int = DIRECTIONS, buckets: int = BUCKETS, spare: int = SPARE, steps: int = STEPS, tasks: int = TASKS, seed: int = 7) -> Encoder:
    """The encoder of a table's texts. Null and empty texts don't count; with fewer different rows than directions, the last directions are void (zero)."""
    coded = written(texts.select(buckets_of(F.col(text), buckets).alias("b")).where(F.size("b") > 0), "buckets")
    n = coded.count()
    counts = coded.select(F.explode(F.array_distinct("b")).alias("b")).groupBy("b").count().collect()  # a row for each bucket
    df = np.zeros(buckets)
    for r in counts:
        df[r["b"]] = r["count"]
    idf = np.log((1 + n) / (1 + df)) + 1
    coded = coded.coalesce(tasks)
    q = np.random.default_rng(seed).standard_normal((buckets, directions + spare))
    for _ in range(1 + steps):
        q = np.linalg.qr(_summed(coded, idf, q, False))[0]
    values, vectors = np.linalg.eigh(_summed(coded, idf, q, True))
    best = np.argsort(-values)[:directions]
    found = q @ vectors[:, best]
    found[:, values[best] <= 1e-9] = 0.0
    return Encoder(idf, found)


def encode(texts: DataFrame, encoder: Encoder, text: str = "text") -> DataFrame:
    """texts with vec; a text without words has a zero vector. A column named vec is replaced."""
    shared = texts.sparkSession.sparkContext.broadcast((encoder.idf, encoder.directions))
    plain = texts.select(*[c for c in texts.columns if c != "vec"])
    from pyspark.sql import types as T

    coded = plain.withColumn("_b", buckets_of(F.col(text), len(encoder.idf)))
    schema = T.StructType([*plain.schema.fields, T.StructField("vec", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, q = shared.value
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            rows = [_times(*part, q) for part in _rows(lists, idf)]
            flat = np.concatenate(rows).ravel() if rows else np.zeros(0)
            vec = pa.FixedSizeListArray.from_arrays(pa.array(flat), q.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], vec], names=schema.names)

    return coded.mapInArrow(run, schema)


def save(spark: SparkSession, encoder: Encoder, path: str) -> None:
    rows = [(k, float(i), d.tolist()) for k, (i, d) in enumerate(zip(encoder.idf, encoder.directions))]
    spark.createDataFrame(rows, "bucket int, idf double, direction array<double>").write.parquet(path)


def load(spark: SparkSession, path: str) -> Encoder:
    rows = spark.read.parquet(path).orderBy("bucket").collect()  # a row for each bucket
    return Encoder(np.array([r["idf"] for r in rows]), np.array([r["direction"] for r in rows]))


def encoded(records: DataFrame, encoder: Encoder, path: str, text: str = "text") -> DataFrame:
    """records with vec, from the store of vectors at path; texts that it doesn't have are encoded, each once, and added to it. A null text has no vector."""
    spark, at = records.sparkSession, f"{path.rstrip('/')}/model-{encoder.name}"
    keyed = records.select(*[c for c in records.columns if c != "vec"]).withColumn("_key", F.sha2(F.col(text), 256))
    new = keyed.where(F.col("_key").isNotNull()).select("_key", F.col(text).alias("text")).dropDuplicates(["_key"])
    if _exists(spark, at):
        new = new.join(spark.read.parquet(at).select("_key"), "_key", "left_anti")
    new = written(new, "new-texts")
    if not new.isEmpty():
        encode(new, encoder).select("_key", "vec").write.mode("append").parquet(at)
    elif not _exists(spark, at):
        return keyed.drop("_key").withColumn("vec", F.lit(None).cast("array<double>"))
    return keyed.join(spark.read.parquet(at), "_key", "left").drop("_key")
