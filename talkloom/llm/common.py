"""What the operators share: tables, the shared folder, Arrow limits."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes and rows of one Arrow batch sent to Python: this bounds what a worker holds.
BATCH_BYTES = 8 << 20
BATCH_ROWS = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Arrow batches are limited by bytes as well as rows: texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def share(spark: SparkSession, value: object) -> Broadcast:
    """Broadcasts a value with its classes by value: plain broadcasts name classes, which executors would have to import."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(shared: Broadcast) -> object:
    return cloudpickle.loads(shared.value)


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a temporary one if all runs on
    one machine (tests, benches); else an error, as executors would write to disks of their own."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="talkloom-")
        sc.setCheckpointDir(at)
    return at.rstrip("/")


#: Scratch folders made within `passing`, by thread.
_PASSING: dict[int, list[str]] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/talkloom-{name}-{uuid.uuid4().hex}"
    if (made := _PASSING.get(threading.get_ident())) is not None:
        made.append(path)
    return path


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Scratch folders that are made within it go at its end. What is read later must be written to a path from before."""
    me = threading.get_ident()
    outer = _PASSING.get(me)
    made = _PASSING[me] = []
    try:
        yield
    finally:
        if outer is None:
            del _PASSING[me]
        else:
            _PASSING[me] = outer
        for path in made:
            remove(spark, path)


#: Spark's setting by which a job's shuffle files go when the job has ended.
_LET_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def save(df: DataFrame, path: str) -> None:
    """Writes df as Parquet. The job's shuffle files go with its end, as later jobs start from what it has written;
    else those of all steps would lie on the disks until the driver collects its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(_LET_GO, None)
    conf.set(_LET_GO, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.unset(_LET_GO) if before is None else conf.set(_LET_GO, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: later jobs start from the files."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    save(df, path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder that no later plan reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, UPPER, UPPER.lower())
