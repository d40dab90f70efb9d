"""Runs a stream to its present end, for tables that are derived by a streaming operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame

from talkloom.sources.scratch import shared_dir

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PARTITIONS = "spark.sql.shuffle.partitions"


def drained(parts: list[DataFrame], operator: Callable[[DataFrame], DataFrame], name: str, partitions: int | None = None) -> DataFrame:
    """The operator's output when these tables arrive one after the other, each followed by a restart on one checkpoint.

    State goes to the store that timers and maps need, in as many partitions as a shuffle has, or those given. The session's settings are restored.
    """
    spark = parts[0].sparkSession
    at = f"{shared_dir(spark)}/talkloom-{name}-{uuid.uuid4().hex}"
    own = {_PROVIDER: _ROCKS} | ({_PARTITIONS: str(partitions)} if partitions else {})
    before = {k: spark.conf.get(k, None) for k in own}
    for part in parts:
        part.write.mode("append").parquet(f"{at}/in")
        try:
            for k, v in own.items():
                spark.conf.set(k, v)
            stream = operator(spark.readStream.schema(part.schema).parquet(f"{at}/in"))
            q = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")
