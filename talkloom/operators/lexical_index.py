"""A kept index for lexical retrieval: exact top-k by the cosine of word counts.

The index is a table with a row for each shard, some megabytes of records: their ids and norms, and for each word its list
of postings (record in the shard, count). Within a shard records are ordered by their commonest word and their norm, so that like ones are
neighbours, and cut into bands of BAND; a list is cut at the bands, and each of its blocks has the largest weight in it. Making the index
shuffles nothing, records that are added later make further shards. A search reads the shards where they lie; queries travel to them in blocks of bounded
size, and each shard answers with its best k of each query, so that a common word moves no record.

In a shard the blocks of a query's words bound the score of any record of a band. Bands are taken by their bounds, the
highest first, until the next one's is below the bar: the threshold, or the k-th best so far. What is left isn't read, and the result is exact.

Ids are those of rows: rows that repeat an id are records of their own. A null or empty text has no words and is found by nothing; rows without an id are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom.functions import text as X

#: Characters of a shard's records, records of a band, and characters of the queries that travel together.
SHARD, BAND, QUERIES = 4_000_000, 16, 4_000_000
#: A word's blocks are those from its place in starts to the next one's; a block's postings those from its place in firsts to the next one's.
SCHEMA = "ids array<long>, norms array<double>, terms array<string>, starts array<int>, bands array<int>, tops array<double>, firsts array<int>, docs array<int>, counts array<int>, band int"
_NAMES = [f.split()[0] for f in SCHEMA.split(", ")]
#: Scores are rounded to six places: bounds leave so much room.
ROOM = 2e-6


def shard_of(ids: pa.Array, words: pa.ListArray, band: int) -> pa.RecordBatch:
    """One row of the index from some records and their words."""
    lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    coded = words.flatten().dictionary_encode()
    terms, n = coded.dictionary, max(len(lengths), 1)
    order = pc.sort_indices(terms).to_numpy() if len(terms) else np.zeros(0, np.int64)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    code = rank[coded.indices.to_numpy(zero_copy_only=False)]
    pairs, counts = np.unique(code * n + np.repeat(np.arange(len(lengths)), lengths), return_counts=True)
    term, doc = np.divmod(pairs, n)
    norms = np.sqrt(np.bincount(doc, counts.astype(np.float64) ** 2, len(lengths)))
    commonest = np.full(len(lengths), -1)
    by = np.lexsort((-term, counts, doc))
    commonest[doc[by]] = term[by]  # the last one of a record stays
    placed = np.lexsort((norms, commonest))
    place = np.empty(len(placed), np.int64)
    place[placed] = np.arange(len(placed))
    doc, norms = place[doc], norms[placed]
    by = np.lexsort((doc, term))
    term, doc, counts = term[by], doc[by], counts[by]
    key = term * n + doc // band
    firsts = np.flatnonzero(np.concatenate([[True], np.diff(key) != 0])) if len(key) else np.zeros(0, np.int64)
    tops = np.maximum.reduceat(counts / norms[doc], firsts) if len(firsts) else np.zeros(0)
    starts = np.searchsorted(term[firsts], np.arange(len(terms) + 1))
    ints = [x.astype(np.int32) for x in (starts, doc[firsts] // band, np.append(firsts, len(doc)), doc, counts)]
    values = [ids.take(pa.array(placed)), norms, terms.take(pa.array(order)), ints[0], ints[1], tops, *ints[2:]]
    rows = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v if isinstance(v, pa.Array) else pa.array(v)) for v in values]
    return pa.RecordBatch.from_arrays([*rows, pa.array([band], pa.int32())], names=_NAMES)


def shards(records: DataFrame, shard: int = SHARD, band: int = BAND) -> DataFrame:
    """The index of records (id, text) as a table, by runs of a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ends = np.cumsum(batch.column(2).to_numpy())
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + shard - size, "right")))
                held.append(batch.slice(at, to - at))
                size += int(ends[to - 1] - (ends[at - 1] if at else 0))
                at = to
                if size >= shard or at < batch.num_rows:
                    yield shard_of(*_joined(held), band)
                    held, size = [], 0
        if held:
            yield shard_of(*_joined(held), band)

    def _joined(held: list[pa.RecordBatch]) -> tuple[pa.Array, pa.Array]:
        return tuple(pa.concat_arrays([b.column(k) for b in held]) for k in (0, 1))

    worded = records.where("id is not null").select(F.col("id").cast("long").alias("id"), X.words(F.col("text")).alias("words"), F.char_length(X.text_or_empty(F.col("text"))).cast("long").alias("size"))
    return worded.mapInArrow(run, SCHEMA)


def add(records: DataFrame, path: str) -> None:
    """Adds records to the index at path, or makes it."""
    shards(records).write.mode("append").parquet(path)


def kept(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


class Shard:
    def __init__(self, batch: pa.RecordBatch, row: int):
        value = lambda name: batch.column(_NAMES.index(name))[row].values
        self.ids, self.norms, self.starts, self.bands, self.tops, self.firsts, self.docs, self.counts = (
            value(n).to_numpy(zero_copy_only=False) for n in ("ids", "norms", "starts", "bands", "tops", "firsts", "docs", "counts")
        )
        self.place = {t: k for k, t in enumerate(value("terms").to_pylist())}
        self.band = batch.column(_NAMES.index("band"))[row].as_py()
        self.read = self.there = 0

    def top(self, query: list[tuple[str, int]], norm: float, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Records and dot products, among which are the best k by cosine (ties by id), and none that is below least for sure."""
        lists = [(n, slice(self.starts[t], self.starts[t + 1])) for w, n in query if (t := self.place.get(w)) is not None]
        bound = np.zeros(-(-len(self.ids) // self.band))
        for n, blocks in lists:
            bound[self.bands[blocks]] += n / norm * self.tops[blocks]
            self.there += int(self.firsts[blocks.stop] - self.firsts[blocks.start])
        order = np.argsort(-bound, kind="stable")
        dots, best, bar, done, some = np.zeros(len(self.ids), np.int64), np.zeros(0), least, 0, 4
        while done < len(order) and bound[order[done]] > max(bar - ROOM, 0.0):
            chosen = np.zeros(len(bound), bool)
            chosen[order[done : done + some]] = True
            chosen &= bound > max(bar - ROOM, 0.0)
            for n, blocks in lists:
                mine = blocks.start + np.flatnonzero(chosen[self.bands[blocks]])
                a, sizes = self.firsts[mine], self.firsts[mine + 1] - self.firsts[mine]
                at = np.repeat(a - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
                dots[self.docs[at]] += n * self.counts[at]
                self.read += len(at)
            docs = (np.flatnonzero(chosen)[:, None] * self.band + np.arange(self.band)).ravel()
            docs = docs[docs < len(self.ids)]
            docs = docs[dots[docs] > 0]
            best = np.concatenate([best, dots[docs] / (norm * self.norms[docs])])
            if len(best) >= k:
                best = np.partition(best, len(best) - k)[len(best) - k :]
                bar = max(bar, float(best[0]))
            done, some = done + some, 2 * some
        found = np.flatnonzero(dots)
        score = dots[found] / (norm * self.norms[found])
        found, score = found[score > bar - ROOM], score[score > bar - ROOM]
        if len(found) > k:
            by = np.lexsort((self.ids[found], score))
            heads = np.flatnonzero(np.concatenate([[True], np.diff(score[by]) != 0]))
            # of equal scores the k smallest ids are enough
            found = found[by[np.arange(len(by)) - np.repeat(heads, np.diff(np.append(heads, len(by)))) < k]]
        return found, dots[found]


def _blocks(queries: DataFrame, size: int) -> Iterator[list[tuple[int, list[tuple[str, int]], float]]]:
    """The queries with their words' counts, read to the driver in blocks."""
    asked = queries.where("id is not null").select(F.col("id").cast("long").alias("id"), X.words(F.col("text")).alias("words"), F.char_length("text").alias("n"))
    n = -(-(asked.agg(F.sum("n")).first()[0] or 0) // size)
    for b in range(n):
        out = []
        for r in asked.where(F.pmod(F.xxhash64("id"), F.lit(n)) == b).select("id", "words").toLocalIterator():
            counts: dict[str, int] = {}
            for w in r["words"]:
                counts[w] = counts.get(w, 0) + 1
            if counts:
                out.append((r["id"], sorted(counts.items()), float(np.sqrt(float(sum(c * c for c in counts.values()))))))
        yield out


def _told(queries: DataFrame, index: DataFrame, k: int, threshold: float, size: int, schema: str, answer) -> DataFrame:
    spark = index.sparkSession
    out = spark.createDataFrame([], schema)
    for block in _blocks(queries, size):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    yield answer(Shard(batch, row), shared.value, k, threshold)

        out = out.union(index.select(*_NAMES).mapInArrow(run, schema))
    return out


def _best(shard: Shard, block: list, k: int, threshold: float) -> pa.RecordBatch:
    asked, ids, dots, norms = [], [], [], []
    for q, words, norm in block:
        found, dot = shard.top(words, norm, k, threshold)
        asked.append(np.full(len(found), q))
        ids.append(shard.ids[found])
        dots.append(dot)
        norms.append(norm * shard.norms[found])
    cols = [np.concatenate(x) if x else np.zeros(0) for x in (asked, ids, dots, norms)]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(cols, ("i8", "i8", "i8", "f8"))], names=["query_id", "record_id", "dot", "norm"])


def _reads(shard: Shard, block: list, k: int, threshold: float) -> pa.RecordBatch:
    rows = []
    for q, words, norm in block:
        shard.read = shard.there = 0
        shard.top(words, norm, k, threshold)
        rows.append((q, shard.read, shard.there))
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], names=["query_id", "n_read", "n_there"])


def search(queries: DataFrame, index: DataFrame, k: int, threshold: float, size: int = QUERIES) -> DataFrame:
    """query_id, record_id, similarity (six places): what can be among the best k of each query over the threshold, from each shard."""
    told = _told(queries, index, k, threshold, size, "query_id long, record_id long, dot long, norm double", _best)
    score = F.round(F.col("dot").cast("double") / F.col("norm"), 6)
    return told.select("query_id", "record_id", score.alias("similarity")).where(F.col("similarity") > threshold)


def postings_read(queries: DataFrame, index: DataFrame, k: int, threshold: float, size: int = QUERIES) -> DataFrame:
    """query_id, n_read and n_there: the postings a search looks at, and those that its words have."""
    told = _told(queries, index, k, threshold, size, "query_id long, n_read long, n_there long", _reads)
    return told.groupBy("query_id").agg(F.sum("n_read").alias("n_read"), F.sum("n_there").alias("n_there"))
