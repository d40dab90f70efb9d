"""Blocks of documents, and exchanges of packed messages between blocks and buckets of keys.

Corpus-wide questions about many small keys (is this string shared? how often does this word
occur?) are asked by a block of documents at once: a block finds its distinct keys, packs them by
bucket of the key's hash, and sends one message to each bucket it has keys for; a bucket answers
each block in the order of the keys it sent, so that answers need not repeat the keys. A key that
holds a third of all rows costs one entry for each block. Blocks are rows of a table that is bucketed
by block in the shared folder: answers are joined to them without moving the texts again, and a lost task
repeats its block from the files.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkloom.llm.common import scratch_path, small_batches

BLOCK_BYTES = 8 << 20
NO_ID = (1 << 63) - 1  # stands for a null id: no id is greater


@dataclass
class Blocks:
    """df: block, ids, flags, ends (of each text in data), data (the texts' bytes), rest."""

    df: DataFrame
    n_bytes: int
    n_docs: int

    def buckets(self, bytes_each: int) -> int:
        return max(1, math.ceil(self.n_bytes / bytes_each))


def make_blocks(docs: DataFrame, id_col: str, text: str, flag: Column | None = None, block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None) -> Blocks:
    """All documents in blocks of about block_bytes; a longer text is a block by itself.

    keep: further columns that travel with each document, as structs in the column rest.
    """
    spark = docs.sparkSession
    small_batches(spark, rows=2048, size=4 << 20)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), (F.lit(False) if flag is None else flag).alias("flag"), F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b"")).alias("data"), F.struct(F.lit(0).alias("_"), *(keep or [])).alias("rest"))
    size = rows.agg(F.sum(F.length("data").cast("long")).alias("bytes"), F.count("*").alias("docs")).first()
    n_bytes = size["bytes"] or 0
    rest_type = rows.schema["rest"].dataType

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, flags, parts, rest, total = [], [], [], [], 0

        def row() -> pa.RecordBatch:
            ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
            cols = [pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([flags], pa.list_(pa.bool_())), pa.array([ends], pa.list_(pa.int64())), pa.array([b"".join(parts)], pa.binary())]
            cols.append(pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.concat_arrays(rest)))
            return pa.RecordBatch.from_arrays(cols, names=["block", "ids", "flags", "ends", "data", "rest"])

        for batch in batches:
            for k, (i, f, d) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2))):
                d = d.as_py()
                if parts and total + len(d) > block_bytes:
                    yield row()
                    number += 1
                    ids, flags, parts, rest, total = [], [], [], [], 0
                ids.append(NO_ID if i is None else i)
                flags.append(bool(f))
                parts.append(d)
                rest.append(batch.column(3).slice(k, 1))
                total += len(d)
        if parts:
            yield row()

    schema = T.StructType([*T._parse_datatype_string("block long, ids array<long>, flags array<boolean>, ends array<long>, data binary").fields, T.StructField("rest", T.ArrayType(rest_type))])
    packed = rows.mapInArrow(pack, schema)
    options = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1, "parquet.block.size.row.check.min": 1}
    return Blocks(bucketed(packed, "block", math.ceil(n_bytes / (4 * block_bytes)), "blocks", options), n_bytes, size["docs"])


def bucketed(df: DataFrame, key: str, least: int, name: str, options: dict | None = None) -> DataFrame:
    """df, written to the shared folder in buckets of key: groupings and joins by it start where the rows are.

    A table with fewer buckets than a shuffle has partitions would be shuffled again for a join, so there
    are as many at least.
    """
    spark = df.sparkSession
    table = f"talkloom_{name}_{uuid.uuid4().hex}"
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), least)
    writer = df.write.format("parquet").bucketBy(n, key).option("path", scratch_path(spark, name)).option("compression", "zstd")
    for k, v in (options or {}).items():
        writer = writer.option(k, v)
    writer.saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # an external table: its files stay, and the plan above reads them
    return out


Message = tuple[int, list[bytes]]  # bucket, fields


def texts(batch: pa.RecordBatch, k: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """ids, flags, ends and data of a row of the block table."""
    col = lambda name: batch.column(batch.schema.get_field_index(name))[k]
    return (
        np.array(col("ids").values.to_numpy(zero_copy_only=False), np.int64),
        np.array(col("flags").values.to_numpy(zero_copy_only=False), bool),
        np.array(col("ends").values.to_numpy(zero_copy_only=False), np.int64),
        col("data").as_py(),
    )


def replies(batch: pa.RecordBatch, k: int = 0, field: str = "replies") -> dict[int, bytes]:
    got = batch.column(batch.schema.get_field_index(field))[k].as_py() or []
    return {x["bucket"]: x["payload"] for x in got}


def send(blocks: DataFrame, messages: Callable[[pa.RecordBatch, int], Iterator[Message]], fields: list[str]) -> DataFrame:
    """bucket, block and the fields (binary) of every message; messages is called for each block row."""
    names = ["bucket", "block", *fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block = batch.column(batch.schema.get_field_index("block"))[k].as_py()
                got, size = [], 0
                for bucket, parts in messages(batch, k):
                    got.append((bucket, parts))
                    size += sum(map(len, parts))
                    if size > 2 << 20:
                        yield table(block, got)
                        got, size = [], 0
                if got:
                    yield table(block, got)

    def table(block: int, got: list[Message]) -> pa.RecordBatch:
        cols = [pa.array([b for b, _ in got], pa.int32()), pa.array([block] * len(got), pa.int64())]
        cols += [pa.array([p[i] for _, p in got], pa.binary()) for i in range(len(fields))]
        return pa.RecordBatch.from_arrays(cols, names=names)

    return blocks.mapInArrow(run, "bucket int, block long, " + ", ".join(f"{f} binary" for f in fields))


def answer(sent: DataFrame, reply: Callable[[list[list[bytes]]], tuple[list[bytes], list[int]]], n_stats: int = 0) -> DataFrame:
    """block, bucket, payload and stats: reply gets the messages of one bucket, in the order of their
    blocks, and returns as many payloads and n_stats numbers; the numbers come with one row of the bucket."""
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("payload", T.BinaryType()), T.StructField("stats", T.ArrayType(T.LongType()))])

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("block")
        names = [n for n in t.column_names if n not in ("bucket", "block")]
        messages = [list(row) for row in zip(*(t.column(n).to_pylist() for n in names))]
        bucket, blocks = t.column("bucket")[0].as_py(), t.column("block")
        payloads, stats = reply(messages)
        none = [None] * (len(payloads) - 1)
        return pa.table(
            [blocks, pa.array([bucket] * len(payloads), pa.int32()), pa.array(payloads, pa.binary()), pa.array([stats, *none], pa.list_(pa.int64()))], names=schema.names
        )

    return sent.groupBy("bucket").applyInArrow(run, schema)


def with_replies(blocks: DataFrame, answers: DataFrame, field: str = "replies") -> DataFrame:
    """The blocks with their answers; the blocks' rows stay where they are."""
    mine = answers.groupBy(F.col("block").alias("_block")).agg(F.collect_list(F.struct("bucket", "payload")).alias(field))
    return blocks.join(mine.hint("shuffle_hash"), blocks.block == mine["_block"], "left").drop("_block")
