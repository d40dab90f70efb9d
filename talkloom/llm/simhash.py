"""SimHash near-duplicates found with Golay codes.

A text's fingerprint has a bit set where over half of its word shingles' hashes have it. Two
fingerprints that differ in at most three bits are linked. To find links, the 64 bits are cut
into segments A, B and C of 23, 23 and 18 bits. The binary Golay code of length 23 is perfect with
radius three, so the codeword nearest to one text's segment is at most four bits from the other's
if they differ in one bit: the index of the nearest codeword is the one side's key, and the indices
of all codewords within four bits, one or six of them, are the other side's keys.

Of three errors, by pigeonhole, either one segment has none and another one at most, or each has one:
  - any segment as it is, with the codeword of any other (six tables, keys of 30 or 35 bits);
  - the codewords of A and B, with a half of C as it is (two tables, keys of 33 bits).
Both sides' keys are joined, and the join keeps what differs in three bits at most. Equal
fingerprints are one node throughout. Segment C is padded with zeros for the code.

Defined results: lower-casing is of A-Z only; words are maximal runs of characters other than
space and U+0009-U+000D. Without words (null or empty text) the fingerprint is zero, and is linked
like any other. With fewer words than a shingle has, the whole sequence is the only shingle. Repeated
ids and rows are allowed; a null id never becomes a component's id unless all ids in it are null. Texts of any length are read whole; an empty
table gives no rows; columns other than id and text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations, permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkloom.llm.common import small_batches, written
from talkloom.llm.components import components

SEED = 42
#: Shingles whose bits are counted at once.
_BLOCK = 1 << 14
_GENERATOR = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, of the Golay code of length 23
_SEGMENTS = ((41, 23), (18, 23), (0, 18))  # shift, bits: A, B, C
_HALF = 9  # bits of half of C


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit fingerprint, unsigned."""
    import xxhash

    split = (text or "").encode().lower().split()
    if not split:
        return 0
    flat = b" ".join(split)
    if len(split) <= words:
        hashes = [xxhash.xxh64_intdigest(flat, SEED)]
    else:
        ends = list(accumulate(map(len, split), lambda a, n: a + n + 1))
        starts = [0, *[e + 1 for e in ends]]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(flat[a:b], SEED) for a, b in zip(starts, ends[words - 1 :])]
    h = np.array(hashes, dtype=">u8")
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), _BLOCK):
        counts += np.unpackbits(h[i : i + _BLOCK].view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """id and fp (the fingerprint as a signed long)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(s.as_py(), words) for s in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["id", "fp"])

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    return plain.mapInArrow(run, "id long, fp long")


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Check bits of each 12-bit message, and by syndrome the error patterns of at most four bits
    (six slots; a pattern may fill several)."""
    check = np.zeros(1 << 12, np.int64)
    for m in range(1 << 12):
        r = m << 11
        for bit in range(22, 10, -1):
            if r >> bit & 1:
                r ^= _GENERATOR << (bit - 11)
        check[m] = r
    errors: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            errors[check[e >> 11] ^ (e & 0x7FF)].append(e)
    return check, np.array([e + [e[0]] * (6 - len(e)) for e in errors], np.int64)


def golay_keys(segment: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For each 23-bit word the indices of the codewords within four bits, the nearest first."""
    check, errors = tables
    syndrome = check[segment >> 11] ^ (segment & 0x7FF)
    return (segment[:, None] ^ errors[syndrome]) >> 11


def key_rows(fps: np.ndarray, tables: tuple[np.ndarray, np.ndarray], probe: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys: those of all near codewords if probe, else those of the nearest ones."""
    u = fps.view(np.uint64)
    exact = [(u >> np.uint64(s) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in _SEGMENTS]
    near = [golay_keys(x, tables)[:, : None if probe else 1] for x in exact]
    fresh = [(x != x[:, :1]) | (np.arange(x.shape[1]) == 0) for x in near]  # slots that repeat the nearest are void
    rows, keys = [], []

    def add(key: np.ndarray, ok: np.ndarray) -> None:
        row, slot = np.nonzero(ok.reshape(len(fps), -1))
        rows.append(row)
        keys.append(len(keys) << 36 | key.reshape(len(fps), -1)[row, slot])

    for x, y in permutations(range(3), 2):
        add(exact[x][:, None] << 12 | near[y], fresh[y])
    both, ok = near[0][:, :, None] << 12 | near[1][:, None, :], fresh[0][:, :, None] & fresh[1][:, None, :]
    for half in (exact[2] >> _HALF, exact[2] & ((1 << _HALF) - 1)):
        add(half[:, None, None] << 24 | both, ok)
    return np.concatenate(rows), np.concatenate(keys)


def links(nodes: DataFrame, distance: int = 3) -> DataFrame:
    """src, dst: pairs of different fingerprints (column fp, distinct) within the distance, once each."""
    if not 0 <= distance <= 3:
        raise ValueError("the keys are made for at most three differing bits")
    small_batches(nodes.sparkSession)

    def keyed(probe: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = golay_tables()
            for batch in batches:
                fps = batch.column(0).to_numpy(zero_copy_only=False)
                for i in range(0, len(fps), 1024):
                    part = fps[i : i + 1024]
                    rows, keys = key_rows(part, tables, probe)
                    yield pa.RecordBatch.from_arrays([pa.array(part[rows]), pa.array(keys)], names=["fp", "key"])

        return run

    only = nodes.select("fp")
    index = only.mapInArrow(keyed(False), "fp long, key long").withColumnRenamed("fp", "src")
    probe = only.mapInArrow(keyed(True), "fp long, key long").withColumnRenamed("fp", "dst")
    near = (F.col("src") < F.col("dst")) & (F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= distance)
    # Spark takes either side for as small as the fingerprints; a probe side has about ninety rows for each, too many to broadcast
    return index.hint("shuffle_merge").join(probe.hint("shuffle_merge"), (index.key == probe.key) & near).select("src", "dst").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 3, distance: int = 3) -> DataFrame:
    """id_col, fingerprint (16 hexadecimal digits) and component_id: the smallest id reachable by links."""
    prints = written(fingerprints(docs, id_col, text, words), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("id").alias("least")), "fingerprint-nodes")
    edges = links(nodes, distance)
    roots = components(edges)
    by_node = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    least = by_node.groupBy("root").agg(F.min("least").alias("component_id"))
    named = by_node.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
