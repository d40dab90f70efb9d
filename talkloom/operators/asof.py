"""As-of join: each row of one table with the values of the last row of another that comes before it, within a key.

Both tables' rows are dealt together by ranges of key and time, so that a large key spans many partitions. Within a partition a task
carries the last value along; it holds one Arrow batch and one value. A row before which its partition has no
value of its key takes the last one of the partitions before, of which there is one value for each key and partition. No window stands over a
whole key, and no side is sent to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkloom.sources.scratch import written


def asof_join(left: DataFrame, right: DataFrame, by: list[str], time: str, values: list[str], tie: list[str] | None = None, exact: bool = False) -> DataFrame:
    """All rows of left, with the columns values of the last row of right that has the same key (by) and an earlier time; with exact
    also the same time. Both have the columns by and time. Of right's rows at one time the last by tie counts (then any).

    Where there is no such row, or a key or time is null, the values are null. Repeated rows of left are each answered; columns of left that are named like a value are replaced.
    """
    kept = [c for c in left.columns if c not in values]
    plain, known = left.select(*kept), right.where(" and ".join(f"`{c}` is not null" for c in [*by, time]))
    none = [F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values]
    keys, packed = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.struct(*values)
    nulls = " or ".join(f"`{c}` is null" for c in [*by, time])
    tie_kind = known.select(F.struct(F.lit(0).alias("_"), *(tie or [])).alias("t")).schema["t"].dataType
    row_kind, value_kind = plain.select(F.struct(*kept).alias("r")).schema["r"].dataType, known.select(packed.alias("v")).schema["v"].dataType
    asks, tells = (1, 0) if exact else (0, 1)
    a = plain.where(f"not ({nulls})").select(*keys, F.col(time).alias("_t"), F.lit(asks).alias("_kind"), F.lit(None).cast(tie_kind).alias("_tie"), F.struct(*kept).alias("_row"), F.lit(None).cast(value_kind).alias("_value"))
    b = known.select(*keys, F.col(time).alias("_t"), F.lit(tells).alias("_kind"), F.struct(F.lit(0).alias("_"), *(tie or [])).alias("_tie"), F.lit(None).cast(row_kind).alias("_row"), packed.alias("_value"))
    names = [f"_k{i}" for i in range(len(by))]
    # many rows of one time are dealt over partitions too
    both = a.unionByName(b).withColumn("_salt", F.when(F.col("_kind") == asks, F.xxhash64("_row")).otherwise(0))
    order = [*names, "_t", "_kind", "_tie", "_salt"]
    ranged = both.repartitionByRange(*order).sortWithinPartitions(*order).drop("_salt").withColumn("_part", F.spark_partition_id())
    told = written(_carried(ranged, names, asks), "as-of")

    found, open_ = told.where((F.col("_kind") == asks) & ~F.col("_open")), told.where((F.col("_kind") == asks) & F.col("_open"))
    last = told.where(F.col("_kind") == tells).groupBy(*names, "_part").agg(F.max_by("_value", F.struct("_t", "_tie")).alias("_last"))
    lists = last.groupBy(*names).agg(F.array_sort(F.collect_list(F.struct("_part", F.col("_last").alias("v"))), lambda x, y: x["_part"] - y["_part"]).alias("_lists"))
    earlier = F.filter("_lists", lambda p: p["_part"] < F.col("_part"))
    starts = open_.select(*names, "_part").distinct().join(lists, names).select(*names, "_part", F.try_element_at(earlier, F.lit(-1))["v"].alias("_start"))
    late = open_.join(starts, [*names, "_part"], "left").select("_row", F.col("_start").alias("_value"))
    out = found.select("_row", "_value").unionByName(late).select("_row.*", *[F.col(f"_value.{v}").alias(v) for v in values])
    return out.unionByName(plain.where(nulls).select("*", *none))


def _carried(ranged: DataFrame, names: list[str], asks: int) -> DataFrame:
    """The rows that ask, with the value before them in their partition, or open; of the rows that tell, the last of each key in a batch."""
    schema = T.StructType([*ranged.schema.fields, T.StructField("_open", T.BooleanType())])
    columns = ranged.columns
    at_kind, at_value = columns.index("_kind"), columns.index("_value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whose, carried = None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            value = batch.column(at_value)
            fresh = np.zeros(n, bool)
            for k in range(len(names)):
                c = batch.column(k)
                fresh[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            first = tuple(batch.column(k)[0].as_py() for k in range(len(names)))
            begins = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
            tells = batch.column(at_kind).to_numpy() != asks
            last = np.maximum.accumulate(np.where(tells, np.arange(n), -1))
            has = last >= begins
            if first != whose:
                carried = None
            # the carried value stands before the batch's own ones
            source = pa.concat_arrays([pa.nulls(1, value.type) if carried is None else carried, value])
            old = (begins == 0) & ~has & (carried is not None)
            index = np.where(has, last + 1, 0)
            got = source.take(pa.array(index, mask=~(has | old)))
            final = np.append(fresh[1:], True)
            ends = np.zeros(n, bool)
            ends[last[final & has]] = True
            keep = pa.array(~tells | ends)
            cols = [*batch.columns]
            cols[at_value] = got
            yield pa.RecordBatch.from_arrays([*cols, pa.array(~(has | old))], names=schema.names).filter(keep)
            whose = tuple(batch.column(k)[n - 1].as_py() for k in range(len(names)))
            if has[-1]:
                carried = value.slice(int(last[-1]), 1)
            elif begins[-1] > 0:
                carried = None

    return ranged.mapInArrow(run, schema)
