"""The store as a data source: numbers that last, appends that are whole or not there, epochs that count once, streams that go on."""

import json
import os

import pytest
from pyspark.sql import functions as F

from talkloom.sources import store_source as S
from talkloom.sources import stores


def lines(spark, *records):
    return S.as_lines(spark.createDataFrame([(k, v) for k, v in records], "topic string, content string").coalesce(1))


def append(df, path):
    df.write.format("records").mode("append").save(path)


def read(spark, path):
    return [(r["seq"], json.loads(r["line"])["topic"]) for r in spark.read.format("records").load(path).orderBy("seq").collect()]


@pytest.fixture
def store(spark, tmp_path):
    S.register(spark)
    return str(tmp_path / "store")


def test_records_keep_their_numbers(spark, store):
    assert read(spark, store) == []
    append(lines(spark, ("a", "1"), ("b", "é\n2")), store)
    append(lines(spark, ("c", None)).where("false"), store)
    append(lines(spark, ("d", None)), store)
    assert read(spark, store) == [(0, "a"), (1, "b"), (2, "d")]
    many = spark.range(0, 3000, 1, 4).select(F.col("id").cast("string").alias("topic"))
    append(S.as_lines(many), store)
    got = read(spark, store)
    assert [k for k, _ in got] == list(range(3003)) and [t for _, t in got[3:]] == [str(k) for k in range(3000)]
    records = S.from_lines(spark.read.format("records").load(store))
    assert stores.latest(records).first()["topic"] == "2999"
    told = records.where("seq = 1").first()
    assert (told["content"], told["keywords"], told["user_risk"]) == ("é\n2", [], "")
    assert [x.name for x in os.scandir(store) if x.name.startswith("_staging")] == []
    with pytest.raises(Exception, match="as_lines"):
        spark.range(2).write.format("records").mode("append").save(store)


def test_slices_cut_parts_to_ranges(spark, store, monkeypatch):
    append(S.as_lines(spark.range(0, 100, 1, 3)), store)
    append(S.as_lines(spark.range(100, 130, 1, 2)), store)
    monkeypatch.setattr(S, "SLICE", 7)
    found = S.appends(store)
    for start, end in ((0, 130), (13, 14), (95, 118), (129, 500), (50, 50)):
        got = [(seq, json.loads(line)["id"]) for s in S.slices(found, start, end) for b in S.read_slice(store, s) for seq, line in zip(*(c.to_pylist() for c in b.columns))]
        assert got == [(k, k) for k in range(start, min(end, 130))]


def test_a_write_that_fails_leaves_nothing(spark, store):
    append(lines(spark, ("a", "1")), store)
    bad = spark.range(0, 100, 1, 2).select(F.when(F.col("id") == 90, F.raise_error(F.lit("lost"))).otherwise(F.to_json(F.struct("id"))).cast("string").alias("line"))
    with pytest.raises(Exception, match="lost"):
        append(bad, store)
    assert read(spark, store) == [(0, "a")]
    # a writer that is killed between its tasks and its commit
    w = S._BatchWriter(store, None)
    import pyarrow as pa

    w.write(iter([pa.RecordBatch.from_arrays([pa.array(['{"topic": "x"}'])], names=["line"])]))
    assert read(spark, store) == [(0, "a")]


def test_two_writers_take_two_numbers_and_an_epoch_counts_once(spark, store):
    import pyarrow as pa

    batch = lambda t: iter([pa.RecordBatch.from_arrays([pa.array([json.dumps({"topic": t})])], names=["line"])])
    one, two = S._BatchWriter(store, None), S._BatchWriter(store, None)
    a, b = one.write(batch("one")), two.write(batch("two"))
    seen = S.appends
    try:
        S.appends = lambda path, *after: seen(path, *after) if after else []  # both have looked before either was there
        two.commit([b])
        one.commit([a])
    finally:
        S.appends = seen
    assert read(spark, store) == [(0, "two"), (1, "one")]
    for _ in range(2):
        w = S._StreamWriter(store, "s")
        w.commit([w.write(batch("epoch"))], 0)
    other = S._StreamWriter(store, "other")
    other.commit([other.write(batch("another stream"))], 0)
    assert [t for _, t in read(spark, store)] == ["two", "one", "epoch", "another stream"]
    assert [x.name for x in os.scandir(store) if x.name.startswith("_staging")] == []


def test_streams_go_on_after_the_last_record(spark, store, tmp_path):
    def copy(check):
        s = spark.readStream.format("records").load(store).select("line")
        s.writeStream.format("records").option("txn", "copy").option("checkpointLocation", str(tmp_path / check)).trigger(availableNow=True).start(store + "-copy").awaitTermination()

    append(lines(spark, ("a", "1"), ("b", "2")), store)
    copy("c1")
    append(lines(spark, ("c", "3")), store)
    copy("c1")
    copy("c1")
    assert read(spark, store + "-copy") == [(0, "a"), (1, "b"), (2, "c")]
    copy("c2")  # its checkpoint is lost: epoch 0 comes again, and is known
    assert [t for _, t in read(spark, store + "-copy")] == ["a", "b", "c"]
    late = spark.readStream.format("records").option("from", 2).load(store)
    late.writeStream.format("memory").queryName("late_records").trigger(availableNow=True).start().awaitTermination()
    assert [r["seq"] for r in spark.table("late_records").collect()] == [2]
