"""Clamped running trust.

Trust after an event is clamp(trust before + change). Functions of the form x -> min(h, max(l, x + a))
are closed under composition, so a user's events are folded in parts first, each part to one such
function, and the parts' functions are composed after that. No task sees more of a user than one
part's events or the list of parts, however large the user is. For final scores the parts are time
slices; for running scores they are the partitions of a sort.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkloom.functions.text import clamp
from talkloom.sources.scratch import written

_FAR = 1 << 30


def _then(f: Column, change: Column) -> Column:
    """The function f followed by one event."""
    return F.struct(clamp(f["l"] + change).alias("l"), clamp(f["h"] + change).alias("h"), (f["a"] + change).alias("a"))


def _apply(x: Column, f: Column) -> Column:
    return F.least(f["h"], F.greatest(f["l"], x + f["a"]))


def _slices(events: DataFrame, user: str, order: list[str], change: str, unit: str) -> DataFrame:
    """user, slice, es (the slice's events in order) and f (what they do together)."""
    rows = events.withColumn("slice", F.date_trunc(unit, F.col(order[0])))
    cols = [*order, *[c for c in events.columns if c not in (user, *order)]]
    grouped = rows.groupBy(user, "slice").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("es"))
    start = F.struct(F.lit(-_FAR).alias("l"), F.lit(_FAR).alias("h"), F.lit(0).alias("a"))
    return grouped.withColumn("f", F.aggregate("es", start, lambda f, e: _then(f, F.coalesce(e[change], F.lit(0)).cast("int"))))


def final_trust(events: DataFrame, user: str = "user_id", order: tuple[str, ...] = ("ts", "event_id"), change: str = "change", unit: str = "hour") -> DataFrame:
    """user and trust_score after the last event. A change that is null counts as 0."""
    slim = events.select(user, *order, change)
    fs = _slices(slim, user, list(order), change, unit).groupBy(user).agg(F.array_sort(F.collect_list(F.struct("slice", "f"))).alias("fs"))
    return fs.select(user, F.aggregate("fs", F.lit(0), lambda x, s: _apply(x, s["f"])).alias("trust_score"))


def _with_prefixes(events: DataFrame, user: str, change: str) -> DataFrame:
    """Events, sorted within their partitions, with what the user's events before each one (f0), and with it (f1),
    in the same partition do together."""
    triple = T.StructType([T.StructField(k, T.IntegerType()) for k in ("l", "h", "a")])
    schema = T.StructType([*events.schema.fields, T.StructField("f0", triple), T.StructField("f1", triple)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whose, f = None, (-_FAR, _FAR, 0)
        for batch in batches:
            before, after = [], []
            for u, c in zip(batch.column(user).to_pylist(), batch.column(change).to_pylist()):
                if u != whose:
                    whose, f = u, (-_FAR, _FAR, 0)
                before.append(f)
                f = max(0, min(100, f[0] + c)), max(0, min(100, f[1] + c)), f[2] + c
                after.append(f)
            packed = [pa.StructArray.from_arrays([pa.array([x[k] for x in fs], pa.int32()) for k in range(3)], ["l", "h", "a"]) for fs in (before, after)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *packed], names=schema.names)

    return events.mapInArrow(run, schema)


def running_trust(events: DataFrame, user: str = "user_id", order: tuple[str, ...] = ("ts", "event_id"), change: str = "change") -> DataFrame:
    """Every event with trust_before and trust_score (after it).

    Events are dealt out by ranges of user and time, so that a large user spans many partitions;
    each partition finds its events' prefixes, and the partitions' totals give each one's start.
    """
    keys = [user, *order]
    ranged = events.withColumn("_c", F.coalesce(F.col(change).cast("int"), F.lit(0))).repartitionByRange(*keys).sortWithinPartitions(*keys)
    told = written(_with_prefixes(ranged.withColumn("_part", F.spark_partition_id()), user, "_c"), "trust")
    parts = told.groupBy(user, "_part").agg(F.max_by("f1", F.struct(*order)).alias("f"))
    lists = parts.groupBy(user).agg(F.array_sort(F.collect_list(F.struct("_part", "f"))).alias("fs"))
    # a user's partitions are few: their start states are appended one by one
    seed = F.struct(F.lit(0).alias("x"), F.array().cast("array<struct<_part:int,x:int>>").alias("done"))
    step = lambda acc, s: F.struct(_apply(acc["x"], s["f"]).alias("x"), F.array_append(acc["done"], F.struct(s["_part"].alias("_part"), acc["x"].alias("x"))).alias("done"))
    starts = lists.select(F.col(user).alias("_user"), F.inline(F.aggregate("fs", seed, step, lambda acc: acc["done"]))).withColumnRenamed("_part", "_part2")
    placed = told.join(starts, told[user].eqNullSafe(starts["_user"]) & (F.col("_part") == F.col("_part2")))
    return placed.select(*events.columns, _apply(F.col("x"), F.col("f0")).alias("trust_before"), _apply(F.col("x"), F.col("f1")).alias("trust_score"))
