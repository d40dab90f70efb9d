"""The record store as a Spark data source: batch and streaming reads by record number, appends that are whole or not at all.

    spark.dataSource.register(StoreSource)
    spark.read.format("records").load(path)            # seq, line
    spark.readStream.format("records").load(path)      # the same, from record 0 on
    lines.write.format("records").mode("append").save(path)
    stream.writeStream.format("records").option("txn", "...").option("checkpointLocation", ...).start(path)

A record is a line of JSON; its number, seq, is given when its append is committed and never changes. Tasks write part files to a
staging folder. The driver's commit adds a manifest (the number of the first record, parts and their lengths) and renames the folder to
that of the next append; of two writers that meet at one number one finds it taken and takes the next. Readers see named
appends only. A write that is killed leaves at most a staging folder, which no reader sees.

A stream's epoch is named in its append's manifest together with txn, the stream's own name: an epoch that is committed again writes nothing. Offsets
are record numbers, so a stream goes on after the last record it has seen, wherever appends begin and end.

Paths are what pyarrow's file systems can reach, the same from the driver and all executors; a missing store is empty.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage

from talkloom.sources.stores import RECORD, good, parsed_records

SCHEMA = "seq long, line string"
MANIFEST = "_manifest.json"
#: Lines of an Arrow batch that a reader hands on, and records that one task reads.
BATCH, SLICE = 4096, 1_000_000


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    at, p = fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")
    return at, p.rstrip("/")


def _number(name: str) -> int | None:
    head, _, n = name.partition("-")
    return int(n) if head == "append" and n.isdigit() else None


@dataclass
class Append:
    """One committed append: its number, the number of its first record, and its parts (name and records)."""

    n: int
    first: int
    parts: list[list]
    epoch: str | None = None

    @property
    def end(self) -> int:
        return self.first + sum(count for _, count in self.parts)


def appends(path: str, after: int = 0) -> list[Append]:
    """The committed appends with numbers above after, in their order."""
    at, p = _opened(path)
    found = at.get_file_info(fs.FileSelector(p, allow_not_found=True))
    numbers = sorted(n for f in found if f.type == fs.FileType.Directory and (n := _number(f.base_name)) is not None and n > after)
    out = []
    for n in numbers:
        with at.open_input_stream(f"{p}/append-{n}/{MANIFEST}") as f:
            out.append(Append(n, **json.loads(f.read())))
    return out


@dataclass
class Slice(InputPartition):
    """Records of one part file: the first begins at its line skip."""

    file: str
    skip: int
    first: int
    count: int


def slices(found: list[Append], start: int, end: int) -> list[Slice]:
    """The part files, cut to the records start <= seq < end and to SLICE records at most."""
    out = []
    for a in found:
        seq = a.first
        for name, count in a.parts:
            for at in range(seq, seq + count, SLICE):
                lo, hi = max(at, start), min(at + SLICE, seq + count, end)
                if lo < hi:
                    out.append(Slice(f"append-{a.n}/{name}", lo - seq, lo, hi - lo))
            seq += count
    return out


def read_slice(path: str, part: Slice) -> Iterator[pa.RecordBatch]:
    at, p = _opened(path)
    with at.open_input_stream(f"{p}/{part.file}") as raw:
        seq, lines, left = part.first, [], part.count
        for k, line in enumerate(_lines(raw)):
            if k < part.skip:
                continue
            lines.append(line)
            left -= 1
            if len(lines) == BATCH or not left:
                yield pa.RecordBatch.from_arrays([pa.array(range(seq, seq + len(lines)), pa.int64()), pa.array(lines, pa.string())], names=["seq", "line"])
                seq, lines = seq + len(lines), []
            if not left:
                return


def _lines(raw: pa.NativeFile, size: int = 1 << 20) -> Iterator[str]:
    tail = b""
    while chunk := raw.read(size):
        *whole, tail = (tail + chunk).split(b"\n")
        for line in whole:
            yield line.decode("utf-8")


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: its staging folder and file, its place among the tasks, and the number of records."""

    folder: str
    name: str
    partition: int
    count: int


class _Writer:
    """Two phases: tasks write to a staging folder, the driver's commit makes it an append or its abort deletes it."""

    def __init__(self, path: str, txn: str | None):
        self.path, self.txn, self.staging = path, txn, f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        partition, attempt = (context.partitionId(), context.taskAttemptId()) if context else (0, 0)
        at, p = _opened(self.path)
        at.create_dir(f"{p}/{self.staging}", recursive=True)
        name, count = f"part-{partition}-{attempt}.jsonl", 0
        with at.open_output_stream(f"{p}/{self.staging}/{name}") as out:
            for batch in iterator:
                lines = [x for x in batch.column(0).to_pylist() if x is not None]
                if lines:
                    out.write(("\n".join(lines) + "\n").encode())
                    count += len(lines)
        return Written(self.staging, name, partition, count)

    def publish(self, messages: list[Written | None], epoch: str | None) -> None:
        at, p = _opened(self.path)
        told = sorted((m for m in messages if m is not None and m.count), key=lambda m: m.partition)
        seen = appends(self.path)
        if epoch is not None and any(a.epoch == epoch for a in seen) or not told:
            self.discard(messages)
            return
        folder = told[0].folder  # a stream's commit may be another writer than its tasks': what they tell counts
        own = {m.name for m in told}
        for f in at.get_file_info(fs.FileSelector(f"{p}/{folder}")):  # of attempts that were given up
            if f.base_name not in own:
                at.delete_file(f.path)
        while True:
            last = seen[-1] if seen else Append(0, 0, [])
            manifest = {"first": last.end, "parts": [[m.name, m.count] for m in told], "epoch": epoch}
            with at.open_output_stream(f"{p}/{folder}/{MANIFEST}") as out:
                out.write(json.dumps(manifest).encode())
            try:
                at.move(f"{p}/{folder}", f"{p}/append-{last.n + 1}")
                return
            except OSError:  # the number is taken: another writer was first
                newer = appends(self.path, last.n)
                if not newer:
                    raise
                if epoch is not None and any(a.epoch == epoch for a in newer):
                    self.discard(messages)
                    return
                seen += newer

    def discard(self, messages: list[Written | None]) -> None:
        at, p = _opened(self.path)
        for folder in {self.staging, *(m.folder for m in messages if m is not None)}:
            if at.get_file_info(f"{p}/{folder}").type == fs.FileType.Directory:
                at.delete_dir(f"{p}/{folder}")


class _BatchWriter(_Writer, DataSourceArrowWriter):
    def commit(self, messages: list[Written | None]) -> None:
        self.publish(messages, None)

    def abort(self, messages: list[Written | None]) -> None:
        self.discard(messages)


class _StreamWriter(_Writer, DataSourceStreamArrowWriter):
    def commit(self, messages: list[Written | None], batchId: int) -> None:
        self.publish(messages, f"{self.txn}/{batchId}")

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self.discard(messages)


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Slice]:
        found = appends(self.path)
        return slices(found, 0, found[-1].end) if found else []

    def read(self, partition: Slice | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:
            yield from read_slice(self.path, partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, path: str, first: int):
        self.path, self.first = path, first

    def initialOffset(self) -> dict:
        return {"record": self.first}

    def latestOffset(self) -> dict:
        found = appends(self.path)
        return {"record": max(self.first, found[-1].end if found else 0)}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        return slices(appends(self.path), start["record"], end["record"])

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        yield from read_slice(self.path, partition)


class StoreSource(DataSource):
    """Options: path; for streams also from (the first record read, 0) and txn (the name under which a written stream's epochs count)."""

    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        return SCHEMA

    def _path(self) -> str:
        if not self.options.get("path"):
            raise ValueError("a store needs a path")
        return self.options["path"]

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self._path())

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _StreamReader(self._path(), int(self.options.get("from", 0)))

    @staticmethod
    def _one_text(schema: T.StructType) -> None:
        if [f.dataType for f in schema.fields] != [T.StringType()]:
            raise ValueError("what is written to a store is one column of JSON lines: see as_lines")

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        self._one_text(schema)
        if overwrite:
            raise ValueError("a store is appended to; clear it to begin anew")
        return _BatchWriter(self._path(), None)

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        self._one_text(schema)
        if not self.options.get("txn"):
            raise ValueError("a stream that is written to a store needs a name of its own: the option txn")
        return _StreamWriter(self._path(), self.options["txn"])


def as_lines(records: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """line: the records as JSON with all fields present, null or not, as a store is written."""
    return records.select(F.to_json(F.struct(*(columns or records.columns)), {"ignoreNullFields": "false"}).alias("line"))


def from_lines(lines: DataFrame, schema: T.StructType = RECORD) -> DataFrame:
    """seq and the fields of a store's records, batch or stream; lines that aren't JSON objects are skipped, and
    missing or null fields filled, as stores.read_jsonl does."""
    return parsed_records(good(lines), schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(StoreSource)
