"""Profiles that are refreshed from records as they come: only those that are due, and have new records, reach the model.

A store of profiles is a folder of runs, each with the rows it has changed: id, user, own, seen (the highest number of the records that
count in it) and refreshed (when it was made). What is current is the last run's row of each id. So a refresh writes what it has
changed and no more; compact makes one run of all. A run that wasn't finished isn't read.
"""

from __future__ import annotations

import re
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom.operators.judge import Model
from talkloom.sources.scratch import written
from talkloom.sources.stores import _exists, _fs, latest

COLUMNS = ["id", "user", "own", "seen", "refreshed"]


def _runs(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Number and name of the runs that are complete, in order."""
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(p)]
    return sorted((int(m[1]), n) for n in names if (m := re.fullmatch(r"run-(\d+)-\w+", n)) and _exists(spark, f"{path}/{n}/_SUCCESS"))


def _write(rows: DataFrame, path: str) -> None:
    spark = rows.sparkSession
    n = max((k for k, _ in _runs(spark, path)), default=0) + 1
    rows.select(*COLUMNS).write.parquet(f"{path}/run-{n}-{uuid.uuid4().hex}")


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """id, user, own, seen, refreshed of every profile; None where there is no store."""
    path = path.rstrip("/")
    runs = _runs(spark, path)
    if not runs:
        return None
    name = F.regexp_extract(F.col("_metadata.file_path"), r"/run-(\d+)-(\w+)/", 1).cast("long")
    rows = spark.read.parquet(*[f"{path}/{n}" for _, n in runs]).select("*", F.struct(name.alias("n"), F.col("_metadata.file_path").alias("file")).alias("_run"))
    return rows.drop("_run") if len(runs) == 1 else latest(rows, "id", order="_run").select(*COLUMNS)


def compact(spark: SparkSession, path: str) -> None:
    """One run of all; the runs before it are deleted."""
    path = path.rstrip("/")
    old = _runs(spark, path)
    if len(old) > 1:
        _write(current(spark, path), path)
        for _, name in old:
            p, fs = _fs(spark, f"{path}/{name}")
            fs.delete(p, True)


def refresh(path: str, defaults: DataFrame, records: DataFrame, model: Model, now: datetime, hours: int = 24, only_new: bool = False) -> DataFrame:
    """Refreshes the store and returns what is current.

    defaults: id, user, own of the profiles there should be; those the store doesn't have are entered as they are, as made now. records: id,
    seq (numbers that grow) and any other columns. A profile is refreshed when it was made so many hours ago or longer, and records have
    come since; from all its records, or only_new from those. The agent's part is updated after the user's, which it sees. A response that is
    broken leaves its part as it is, but the records count as seen. Records of no profile, and those without an id or a number, are left out.
    """
    spark, path = defaults.sparkSession, path.rstrip("/")
    at = F.lit(now).cast("timestamp")
    have = current(spark, path)
    new = defaults.select("id", "user", "own", F.lit(None).cast("long").alias("seen"), at.alias("refreshed"))
    if have is not None:
        new = new.join(have.select("id"), "id", "left_anti")
    new = written(new, "new-profiles")
    if have is None or not new.isEmpty():
        _write(new, path)
    if have is None:
        return current(spark, path)
    due = have.where(at - F.col("refreshed") >= F.expr(f"INTERVAL {hours} HOURS"))
    told = records.where("id is not null and seq is not null")
    last = told.groupBy("id").agg(F.max("seq").cast("long").alias("last"))
    due = written(due.join(last, "id").where((F.col("last") > F.col("seen")) | F.col("seen").isNull()), "due-profiles")
    others = [c for c in records.columns if c not in ("id", "seq")]
    mine = told.join(due.select("id", "seen"), "id")
    if only_new:
        mine = mine.where((F.col("seq") > F.col("seen")) | F.col("seen").isNull())
    lists = mine.groupBy("id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("seq", *others)))).alias("_records"))
    seen = model.column(due.join(lists, "id"), "_user", lambda m: m.update_user(F.col("user"), F.col("_records")))
    seen = model.column(written(seen, "updated-users"), "_own", lambda m: m.update_own(F.col("own"), F.col("_user"), F.col("_records")))
    changed = written(seen.select("id", F.col("_user").alias("user"), F.col("_own").alias("own"), F.col("last").alias("seen"), at.alias("refreshed")), "refreshed")
    if not changed.isEmpty():
        _write(changed, path)
    return current(spark, path)
