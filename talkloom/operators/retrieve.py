"""Retrieval of related records: dense by cosine, lexical by shared words.

Queries are a stated set. Dense queries travel to the data in blocks of bounded size; each task
keeps only the best k of a query from all its batches, and a window takes the best of those. Records may
be any number. The score must exceed the threshold; ties go to the smaller record id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkloom.operators import lexical_index

TOP_K, THRESHOLD = 5, 0.3
BLOCK_BYTES = 32 << 20
#: Queries and records that are compared at once.
TILE = 1024


def _normal(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


class _Best:
    """The k best records of each query, of all that a task has seen: highest scores first, ties by the smaller id. It holds k of a query, and one tile of scores."""

    def __init__(self, qid: np.ndarray, k: int, least: float):
        self.qid, self.k = qid, k
        self.score, self.id = np.full((len(qid), k), -np.inf), np.zeros((len(qid), k), np.int64)
        self.least = np.full(len(qid), np.nextafter(least, np.inf))  # what a record must reach to count

    def add(self, first: int, scores: np.ndarray, ids: np.ndarray) -> None:
        rows, cut = slice(first, first + len(scores)), len(ids) - self.k
        if cut > 0:
            self.least[rows] = np.maximum(self.least[rows], np.partition(scores, cut, axis=1)[:, cut])
        r, c = np.nonzero(scores >= self.least[rows, None])
        if not len(r):
            return
        some = np.unique(r)
        query = np.concatenate([r, np.repeat(some, self.k)])
        score = np.concatenate([scores[r, c], self.score[first + some].ravel()])
        record = np.concatenate([ids[c], self.id[first + some].ravel()])
        order = np.lexsort((record, -score, query))
        heads = np.searchsorted(query[order], some)
        top = order[heads[:, None] + np.arange(self.k)]
        self.score[first + some], self.id[first + some] = score[top], record[top]
        self.least[first + some] = np.maximum(self.least[first + some], self.score[first + some, -1])

    def batches(self, names: list[str]) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(self.qid), 1 << 16):
            r, c = np.nonzero(self.score[i : i + (1 << 16)] > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(self.qid[i + r]), pa.array(self.id[i + r, c]), pa.array(self.score[i + r, c])], names=names)


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "record_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def usable(vec: Column) -> Column:
    """Whether a vector can be compared: not null or empty, and all its parts are numbers and finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(vec) > 0) & ~F.exists(vec, bad), F.lit(False))


def dense_top_k(queries: DataFrame, records: DataFrame, k: int = TOP_K, threshold: float | None = THRESHOLD, others_only: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, record_id, similarity, rank. Both sides have id and vec (array of a number).

    A query is compared with the records whose vectors have its length. Vectors that are null or empty, or have a part that is null, NaN or infinite,
    are compared with nothing; a zero vector is similar to nothing (0). others_only leaves out the record with the query's id. Queries
    travel to the data in blocks of so many bytes, of one length each.
    """
    spark = records.sparkSession
    plain, asked = (t.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec")).where(F.col("id").isNotNull() & usable(F.col("vec"))) for t in (records, queries))
    out = spark.createDataFrame([], "query_id long, record_id long, similarity double")
    least, names = -2.0 if threshold is None else threshold, out.columns

    def scorer(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qid, q = shared.value
            best = _Best(qid, k, least)
            for batch in batches:
                if not batch.num_rows:
                    continue
                rid = batch.column(0).to_numpy()
                x = _normal(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(rid), q.shape[1]))
                for i in range(0, len(qid), TILE):
                    for j in range(0, len(rid), TILE):
                        s, other = q[i : i + TILE] @ x[j : j + TILE].T, rid[j : j + TILE]
                        if others_only:
                            s[qid[i : i + TILE, None] == other[None, :]] = -3.0
                        best.add(i, s, other)
            yield from best.batches(names)

        return run

    for length, n in sorted((r["l"], r["count"]) for r in asked.groupBy(F.size("vec").alias("l")).count().collect()):
        n_blocks = -(-n * 8 * length // block_bytes)
        for b in range(n_blocks):
            rows = asked.where((F.size("vec") == length) & (F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == b)).collect()
            if rows:
                block = np.array([r["id"] for r in rows], np.int64), _normal(np.array([r["vec"] for r in rows], np.float64))
                out = out.union(plain.where(F.size("vec") == length).mapInArrow(scorer(spark.sparkContext.broadcast(block)), out.schema))
    return _best(out, k)


def lexical_top_k(queries: DataFrame, records: DataFrame, k: int = TOP_K, threshold: float = THRESHOLD) -> DataFrame:
    """query_id, record_id, similarity, rank by the cosine of word counts. Both sides have id and text.

    Records are indexed in their tasks and answer there (see lexical_index); search_index does the same with an index that was kept.
    """
    return search_index(queries, lexical_index.shards(records), k, threshold)


def search_index(queries: DataFrame, index: DataFrame, k: int = TOP_K, threshold: float = THRESHOLD) -> DataFrame:
    """As lexical_top_k, over an index made by lexical_index.add."""
    return _best(lexical_index.search(queries, index, k, threshold), k)
