"""Calls of a model that is reached by a function: each distinct call is made once, and its response is kept.

A call is known by the SHA-256 of its kind and inputs. Before any call is made the requests are reduced to distinct ones and to those
that the table of calls doesn't have. What is left goes to a bounded number of tasks, each of which makes a bounded number
of calls at a time; a call that fails or takes longer than the time limit has no response, and the judgement its default.

A task keeps the responses of each part of its requests in a file of the table's folder before it goes on, so that a task that is
run again, on whatever executor, calls only for the part it was in. Calls without a response aren't kept after the run: the next asks again.
"""

from __future__ import annotations

import hashlib
import threading
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.operators.judge import Model
from talkloom.sources.scratch import written
from talkloom.sources.stores import _exists, clear

Call = Callable[[str, str], str | None]
_COLUMNS = ["call_key", "response"]


def timed(call: Call, kind: str, inputs: str, seconds: float) -> str | None:
    """The response, or None if there is none in time; a call that hangs is left behind."""
    box: list[str | None] = []

    def run() -> None:
        try:
            box.append(call(kind, inputs))
        except Exception:  # whatever a service throws, there is no response
            box.append(None)

    t = threading.Thread(target=run, daemon=True)
    t.start()
    t.join(seconds)
    return box[0] if box else None


def _kept(folder: str, keys: list[str]) -> tuple[fs.FileSystem, str]:
    """The file system and path of the file with the responses to these calls."""
    name = hashlib.sha256("\n".join(keys).encode()).hexdigest()[:32]
    at, path = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    return at, f"{path}/{name}.parquet"


def answered(rows: list[tuple[str, str, str]], call: Call, folder: str, at_once: int, seconds: float) -> pa.RecordBatch:
    """The responses to one part of a task's requests (key, kind, inputs): the kept ones, else those of calls, which are then kept."""
    at, path = _kept(folder, [r[0] for r in rows])
    if at.get_file_info(path).type == fs.FileType.File:
        return pq.read_table(path, filesystem=at).combine_chunks().to_batches()[0]
    with ThreadPoolExecutor(at_once) as pool:
        told = list(pool.map(lambda r: timed(call, r[1], r[2], seconds), rows))
    out = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array(told, pa.string())], names=_COLUMNS)
    at.create_dir(path.rsplit("/", 1)[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}"
    pq.write_table(pa.Table.from_batches([out]), own, filesystem=at)
    at.move(own, path)  # whole or not at all
    return out


class CallTable(Model):
    """A model that is called through its table at path. At most tasks * at_once calls are under way at any time."""

    def __init__(self, call: Call, path: str, tasks: int = 8, at_once: int = 8, seconds: float = 30.0, part: int = 64):
        self.call, self.path, self.tasks, self.at_once, self.seconds, self.part = call, path.rstrip("/"), tasks, at_once, seconds, part

    def respond(self, kind: str, inputs: Column) -> Column:
        raise TypeError("responses of a call table are columns of its results: use column()")

    def column(self, df: DataFrame, name: str, judged: Callable[[Model], Column]) -> DataFrame:
        asked: list[tuple[str, Column]] = []

        def note(kind: str, inputs: Column) -> Column:
            asked.append((kind, inputs))
            return F.col("_response")

        value = judged(Model(note))
        if len(asked) != 1:
            raise ValueError("a judgement of a call table makes one call")
        kind, inputs = asked[0]
        rows = df.withColumn("_inputs", inputs).withColumn("_key", F.sha2(F.concat(F.lit(f"{kind}\n"), F.col("_inputs")), 256))
        rows = written(rows, "asked")
        told = self.responses(rows.select(F.col("_key").alias("call_key"), F.lit(kind).alias("kind"), F.col("_inputs").alias("inputs")))
        joined = rows.join(told.select(F.col("call_key").alias("_key"), F.col("response").alias("_response")), "_key", "left")
        return joined.withColumn(name, value).drop("_key", "_inputs", "_response")

    def responses(self, requests: DataFrame) -> DataFrame:
        """call_key and response of the requests (call_key, kind, inputs) that have one; calls for those that aren't in the table."""
        spark, table = requests.sparkSession, f"{self.path}/responses"
        new = requests.dropDuplicates(["call_key"])
        if _exists(spark, table):
            new = new.join(spark.read.parquet(table).select("call_key"), "call_key", "left_anti")
        parts = f"{self.path}/parts-{uuid.uuid4().hex}"
        call, at_once, seconds, part = self.call, self.at_once, self.seconds, self.part

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple[str, str, str]] = []
            for batch in batches:
                held += zip(*(batch.column(k).to_pylist() for k in range(3)))
                while len(held) >= part:
                    yield answered(held[:part], call, parts, at_once, seconds)
                    held = held[part:]
            if held:
                yield answered(held, call, parts, at_once, seconds)

        # in the order of keys, so that a task that is run again has the same parts
        dealt = new.select("call_key", "kind", "inputs").repartition(self.tasks, "call_key").sortWithinPartitions("call_key")
        dealt.mapInArrow(run, "call_key string, response string").where("response is not null").write.mode("append").parquet(table)
        clear(spark, parts)
        return spark.read.schema("call_key string, response string").parquet(table)
