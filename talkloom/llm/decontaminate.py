"""Benchmark decontamination by spaced-seed hashing.

Tokens are runs of letters, digits and non-ASCII bytes, A-Z lower-cased. Fixed masks select some
positions of a span of tokens and ignore the others, so that a substitution at an ignored position
doesn't hide a match. Hashes of the selected tokens of benchmark items and of documents are joined;
each hit fixes an alignment of a document with an item, and the alignment is verified: the longest
stretch in which at least MIN_IDENTITY of the aligned tokens agree must have MIN_TOKENS tokens, or
be the whole item where it is shorter. Items with fewer than SHORTEST tokens must stand verbatim.

Items too short for the masks to be sure of (under MASKED tokens) are cut into as many equal parts as a
match may have errors, and one more: by pigeonhole one part is intact, and it is the item's
seed. So no match of such an item is missed. Of longer items' matches the masks miss those alone in which
errors touch every place of every mask; the README has the measured share.

The benchmark is a stated query set, run against all documents in blocks of at most BLOCK_BYTES of
item text: a block is made into sorted arrays on the driver, travels to the executors, and is one pass over
the documents, without a shuffle of them. With several blocks each one's matches are
written before the next block is read, so one block is held at a time. Any number of blocks gives the same rows.

Defined results: null or empty texts on either side, and items without tokens, match nothing. Equal items are found
alike; a document with several matches of an item has one row, for its longest stretch (ties: the highest identity, then
the first). Texts of any length are compared whole. Repeated documents each have their rows; columns of the tables other than ids
and texts are not read, whatever their names. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from talkloom.llm.common import received, share, small_batches, written

#: 1: a position that counts. Between them they survive any one substitution in eight tokens or so.
MASKS = ("11011011", "1110010111", "110100101011")
MIN_TOKENS, MIN_IDENTITY, SHORTEST, MASKED = 13, 0.8, 8, 16
BLOCK_BYTES = 4 << 20
_SEPARATORS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_FIELDS = [T.StructField("n_tokens", T.LongType()), T.StructField("identity", T.DoubleType()), T.StructField("first_token", T.LongType())]


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_SEPARATORS).split()


def _offsets(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def _hashes(ids: np.ndarray, mask: str, number: int) -> np.ndarray:
    """A hash for each place of the mask; 0 where a selected token is unknown (id 0)."""
    m = len(ids) - len(mask) + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h, known = np.full(m, number + 1, np.uint64), np.ones(m, bool)
    for o in _offsets(mask):
        part = ids[o : o + m]
        known &= part > 0
        h = (h ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h[~known] = 0
    return h


def stretch(same: np.ndarray, identity: float = MIN_IDENTITY) -> tuple[int, int, float]:
    """Start, length and identity of the longest stretch with at least that share of agreement.

    It must begin and end with an agreement; the first of equals is taken.
    """
    starts = np.flatnonzero(same)
    if not len(starts):
        return 0, 0, 0.0
    score = np.concatenate([[0], np.cumsum(np.where(same, 1.0, 0.0) - identity)]).round(9)
    ends = starts + 1
    latest = np.maximum.accumulate(score[ends][::-1])[::-1]  # the best score at this end or a later one
    best, j, least = (0, 0), 0, np.inf
    for i in starts.tolist():
        if score[i] >= least:
            continue  # an earlier start reaches at least as far
        least = score[i]
        while j + 1 < len(ends) and latest[j + 1] >= least:
            j += 1
        if latest[j] >= least and ends[j] - i > best[1]:
            best = (i, int(ends[j]) - i)
    i, length = best
    return i, length, float(same[i : i + length].mean()) if length else 0.0


def errors(n: int) -> int:
    """The most tokens of an item of n tokens that may disagree, or lie outside the stretch, in a match."""
    if n < SHORTEST:
        return 0
    return max(n - m + math.floor(m * (1 - MIN_IDENTITY) + 1e-9) for m in range(min(MIN_TOKENS, n), n + 1))


class Seeds:
    """The hashes of one block of the benchmark, sorted, with the item and the place of each."""

    def __init__(self, items: list[tuple[object, str]], masks: tuple[str, ...] = MASKS):
        self.vocab: dict[bytes, int] = {}
        self.ids, self.items, by_mask = [], [], {m: [] for m in masks}
        for item_id, text in items:
            words = tokens(text)
            if words:
                self.ids.append(item_id)
                self.items.append(np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words], np.int32))
        for i, item in enumerate(self.items):
            if len(item) >= MASKED:
                for m in masks:
                    by_mask[m].append((i, np.arange(len(item) - len(m) + 1)))
            else:
                parts = errors(len(item)) + 1
                width = len(item) // parts
                by_mask.setdefault("1" * width, []).append((i, np.arange(parts) * width))
        self.masks = tuple(m for m, found in by_mask.items() if found)
        got = []
        for k, m in enumerate(self.masks):
            for i, at in by_mask[m]:
                got.append((_hashes(self.items[i], m, k)[at], np.full(len(at), i, np.int32), at.astype(np.int32)))
        h, item, place = (np.concatenate(x) for x in zip(*got)) if got else (np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32))
        order = np.lexsort((place, item, h))
        self.hash, self.item, self.place = h[order], item[order], place[order]
        self.bits = max(16, int(32 * len(h) - 1).bit_length()) if len(h) else 16
        self.seen = np.zeros(1 << (self.bits - 3), np.uint8)
        low = (self.hash & np.uint64((1 << self.bits) - 1)).astype(np.int64)
        np.bitwise_or.at(self.seen, low >> 3, (1 << (low & 7)).astype(np.uint8))

    def matches(self, text: str | None) -> list[tuple[object, int, float, int]]:
        """(item id, tokens of the stretch, its identity, its first token in the text)."""
        words = tokens(text)
        ids = np.fromiter(map(self.vocab.get, words, repeat(0)), np.int32, len(words))
        found = []
        for k, mask in enumerate(self.masks):
            h = _hashes(ids, mask, k)
            low = (h & np.uint64((1 << self.bits) - 1)).astype(np.int64)
            at = np.flatnonzero((h > 0) & (self.seen[low >> 3] >> (low & 7).astype(np.uint8) & 1).astype(bool))
            lo, hi = np.searchsorted(self.hash, h[at]), np.searchsorted(self.hash, h[at], "right")
            n = hi - lo
            which = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found.append(self.item[which].astype(np.int64) << 40 | np.repeat(at, n) - self.place[which] + (1 << 39))
        best: dict[object, tuple[int, float, int]] = {}
        for code in np.unique(np.concatenate(found)).tolist() if found else ():
            i, shift = code >> 40, (code & ((1 << 40) - 1)) - (1 << 39)
            item = self.items[i]
            a, b = max(0, -shift), min(len(item), len(ids) - shift)
            start, n, same = stretch(item[a:b] == ids[a + shift : b + shift])
            if n >= min(MIN_TOKENS, len(item)) and (len(item) >= SHORTEST or same == 1.0):
                key, told = self.ids[i], (n, same, -(start + a + shift))
                best[key] = max(best.get(key, told), told)
        return [(i, n, same, -first) for i, (n, same, first) in sorted(best.items(), key=lambda x: (x[0] is None, x[0] or 0))]


def blocks(bench: DataFrame, item_id: str, text: str, block_bytes: int = BLOCK_BYTES) -> Iterator[Seeds]:
    """The benchmark in blocks, each of bounded size, read to the driver one by one."""
    rows = bench.where(F.col(text).isNotNull()).select(F.col(item_id).alias("i"), F.col(text).alias("t"))
    size = rows.agg(F.sum(F.octet_length("t")).alias("s")).first()["s"] or 0
    n = -(-size // block_bytes)
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield Seeds([(r["i"], r["t"]) for r in part.orderBy("i", "t").collect()])


def contaminated(
    docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """One row for each document and item it contains: id_col, item_id, n_tokens, identity, first_token."""
    spark = docs.sparkSession
    small_batches(spark)
    plain = docs.select(F.col(id_col).alias(id_col), F.col(text).alias("text"))
    kind = bench.schema[item_id].dataType
    arrow = to_arrow_type(kind)
    schema = T.StructType([plain.schema[0], T.StructField(item_id, kind), *_FIELDS])

    def runner(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seeds = received(shared)
            for batch in batches:
                row, got = [], []
                for k, s in enumerate(batch.column(1)):
                    for m in seeds.matches(s.as_py()):
                        row.append(k)
                        got.append(m)
                cols = [batch.column(0).take(pa.array(row, pa.int64())), pa.array([g[0] for g in got], arrow)]
                cols += [pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.float64()), pa.array([g[3] for g in got], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

        return run

    out, held = None, None
    for seeds in blocks(bench, item_id, item_text, block_bytes):
        if held is not None:  # there are several blocks: the last one's matches are found now, and its seeds let go
            now = written(plain.mapInArrow(runner(held), schema), "matches")
            out = now if out is None else out.union(now)
            held.destroy()
        held = share(spark, seeds)
    if held is None:
        return spark.createDataFrame([], schema)
    last = plain.mapInArrow(runner(held), schema)
    return last if out is None else out.union(last)
