"""Streaming operators with timers, buffers and carried bytes: any order and any cut gives the batch result, also over restarts."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from talkloom.operators import events, rounds, stream_text
from talkloom.streaming import stateful

START = datetime(2024, 3, 1, 12)


def run(spark, tmp_path, name, schema, parts, start):
    """Runs the operator once for each part of the input, on one checkpoint: each run is a restart."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src, out, check = (str(tmp_path / f"{name}-{x}") for x in ("in", "out", "check"))
    told = []
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        q = start(spark.readStream.schema(schema).parquet(src)).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        q.awaitTermination()
        told.append(spark.read.parquet(out).count())
    return spark.read.parquet(out), told


ROUNDS = "conv_id long, round_no int, ts timestamp, round_dialog string, topic_changed boolean, is_noise boolean, user_prediction string, user_risk string, agent_empathy string, agent_action string"


@pytest.fixture
def far(spark):
    """A session whose time zone isn't the one that watermarks count in."""
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    yield
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_idle_topics_are_closed_once(spark, tmp_path, far):
    rng = random.Random(21)
    rows = []
    for conv in range(8):
        t = START + timedelta(minutes=rng.randint(0, 20))
        for k in range(1, rng.randint(3, 9)):
            rows.append((conv, k, t, f"{conv}.{k}", rng.choice([True, False, None]), rng.choice([True, False, False, None]), f"p{k}", "", "e", None))
            t += timedelta(minutes=rng.choice([1, 5, 30, 31, 50]))
    # the last ones only move the watermark on
    end = START + timedelta(hours=12)
    rows.sort(key=lambda r: (r[2], r[0]))
    third = len(rows) // 3
    parts = [rows[:third], rows[third : 2 * third], rows[2 * third :], [(99, 1, end, "later", None, None, "", "", "", "")], [(99, 2, end + timedelta(hours=1), "last", None, None, "", "", "", "")]]
    got, told = run(spark, tmp_path, "idle", ROUNDS, parts, lambda s: stateful.closed_topics(s.withWatermark("ts", "1 minute"), idle="30 minutes"))
    df = spark.createDataFrame(rows, ROUNDS).withColumn("fresh", rounds.after_silence("30 minutes"))
    batch = rounds.build_records(rounds.segment(df, F.col("topic_changed"), F.col("is_noise"), F.col("fresh")))
    columns = ["conv_id", "topic_no", "n_rounds", "topic", "content", *rounds.ANALYSES]
    wanted = sorted(tuple(r[c] for c in columns) for r in batch.collect())
    assert sorted(tuple(r[c] for c in columns) for r in got.where("conv_id < 99").collect()) == wanted
    assert told[1] < len(wanted)  # not all of it came from the last restart
    assert sorted(tuple(r[c] for c in columns)[:4] for r in got.where("conv_id = 99").collect()) == [(99, 0, 1, "later")]  # the other one is open


DONE = "stream_id long, segment_id int, done_seq long, ok boolean, ts timestamp"


def test_any_order_is_released_as_in_batch(spark, tmp_path):
    rng = random.Random(22)
    rows = [(s, k, rng.randrange(1000), rng.choice([True, True, False, None]), START) for s in range(6) for k in range(1, 12)]
    seen = rows + rng.sample(rows, 10) + [(1, None, 5, True, START)]
    rng.shuffle(seen)
    parts = [seen[:25], seen[25:50], seen[50:]]
    got, told = run(spark, tmp_path, "order", DONE, parts, lambda s: stateful.in_order(s, "stream_id", "segment_id", highest="done_seq"))
    got = got.collect()
    batch = {(r["stream_id"], r["segment_id"]): r["released_after"] for r in stream_text.release_in_order(spark.createDataFrame(rows, DONE)).collect()}
    assert {(r["stream_id"], r["segment_id"]): r["released_after"] for r in got if r["ok"] is not False} == batch
    assert all(r["release"] == r["segment_id"] - 1 for r in got) and len(got) == len(rows) and told[0] < told[2]


def test_a_gap_is_given_up_after_its_limit(spark, tmp_path, far):
    at = lambda m: START + timedelta(minutes=m)
    parts = [
        [(1, 1, 1, True, at(0)), (1, 3, 3, True, at(2)), (1, 4, 4, True, at(3)), (1, 7, 7, True, at(9)), (2, 2, 2, True, at(14))],
        [(9, 1, 0, True, at(15))],  # the watermark passes the twelfth minute
        [(1, 2, 2, True, at(15)), (1, 5, 5, True, at(15))],  # too late, and in time
        [(9, 2, 0, True, at(40))],
        [(9, 3, 0, True, at(50))],
    ]
    got, _ = run(spark, tmp_path, "gap", DONE, parts, lambda s: stateful.in_order(s.withWatermark("ts", "1 minute"), "stream_id", "segment_id", limit="10 minutes"))
    told = sorted((r["stream_id"], r["release"], r["segment_id"]) for r in got.where("stream_id < 9").collect())
    assert told == [(1, 0, 1), (1, 1, 3), (1, 2, 4), (1, 3, 5), (1, 4, 7), (2, 0, 2)]


def test_late_rounds_make_the_same_topics(spark, tmp_path):
    rng = random.Random(23)
    rows = [(c, k, START, f"{c}.{k}", rng.choice([True, False]), rng.choice([True, False, False]), f"p{k}", "", "e", None) for c in range(6) for k in range(1, 8)]
    seen = list(rows)
    rng.shuffle(seen)
    start = lambda s: stateful.closed_topics(stateful.in_order(s, "conv_id", "round_no"))
    got, _ = run(spark, tmp_path, "late", ROUNDS, [seen[:20], seen[20:]], start)
    batch = rounds.build_records(rounds.segment(spark.createDataFrame(rows, ROUNDS), F.col("topic_changed"), F.col("is_noise")), emit_open=False)
    columns = ["conv_id", "topic_no", "n_rounds", "topic", "content", *rounds.ANALYSES]
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(tuple(r[c] for c in columns) for r in batch.collect())


def test_every_cut_of_a_stream_gives_the_same_frames(spark, tmp_path):
    rng = random.Random(24)
    text = 'data: {"type":"thinking","content":"é中😀"}\n\n: comment\n\ndata: {"type":"chunk","content":"a\\n\\nb"}\n\ndata: broken\n\n\n\ndata: {"type":"done"}\n\ndata: {"type":"chu'
    raw = text.encode()
    cuts = [[], list(range(1, len(raw))), *[sorted(rng.sample(range(1, len(raw)), rng.randint(1, 20))) for _ in range(30)]]
    reads = [(s, n, bytearray(raw[a:b])) for s, cut in enumerate(cuts) for n, (a, b) in enumerate(zip([0, *cut], [*cut, len(raw)]))]
    reads.append((50, 0, None))
    rng.shuffle(reads)
    third = len(reads) // 3
    parts = [reads[:third], reads[third : 2 * third], reads[2 * third :] + reads[:5]]
    got, told = run(spark, tmp_path, "frames", "stream_id long, read_seq long, data binary", parts, stateful.frames)
    whole = [tuple(r)[1:] for r in events.parse_frames(spark.createDataFrame([(0, text)], "stream_id long, text string")).orderBy("seq").collect()]
    of = {}
    for r in got.orderBy("stream_id", "seq").collect():
        of.setdefault(r["stream_id"], []).append(tuple(r)[1:])
    assert len(whole) == 4 and of == {s: whole for s in range(len(cuts))} and told[0] < told[2]


class _Store:
    """A map state that counts what it is asked."""

    def __init__(self):
        self.kept, self.asked = {}, 0

    def containsKey(self, k):  # noqa: N802
        self.asked += 1
        return k in self.kept

    def getValue(self, k):  # noqa: N802
        self.asked += 1
        return self.kept[k]

    def updateValue(self, k, v):  # noqa: N802
        self.asked += 1
        self.kept[k] = v

    def removeKey(self, k):  # noqa: N802
        self.asked += 1
        del self.kept[k]

    def iterator(self):
        return iter(self.kept.items())


@pytest.mark.parametrize("n", [10, 5000, 20_000])
def test_waiting_rows_ask_the_store_by_pages(n):
    rng = random.Random(n)
    store, out, few, paged, at = _Store(), [], [], 0, 0
    numbers = rng.sample(range(n), n)
    for batch in (numbers[: n // 2], numbers[n // 2 :]):
        w = stateful._Waiting(store, 0).open(few, paged)
        for k in batch:
            w.add(k, (k, "first"))
            w.add(k, (k, "again"))
            while k == at and (row := w.take(at)) is not None:
                out.append(row)
                at = k = at + 1
        few, paged = w.close()
        assert paged == sum(len(v[0]) for v in store.kept.values()) and len(few) <= stateful.FEW
    assert out == [(k, "first") for k in range(n)] and not few and not store.kept
    assert store.asked < n / 2  # a row for itself asks four times


def test_many_waiting_rows_and_gaps_over_pages(spark, tmp_path):
    at = lambda m: START + timedelta(minutes=m)
    numbers = [k for k in range(1, 400) if k % 50 and k != 1]
    rows = [(1, k, k, True, at(1)) for k in numbers]
    random.Random(5).shuffle(rows)
    parts = [rows[:200], rows[200:], [(9, 1, 0, True, at(20))], [(9, 2, 0, True, at(40))]]
    got, told = run(spark, tmp_path, "pages", DONE, parts, lambda s: stateful.in_order(s.withWatermark("ts", "1 minute"), "stream_id", "segment_id", limit="10 minutes"))
    assert [r["segment_id"] for r in got.where("stream_id = 1").orderBy("release").collect()] == numbers and told[1] == 0
