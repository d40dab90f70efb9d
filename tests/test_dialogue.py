"""Rounds, segmentation, trust and retrieval against plain sequential versions; streaming forms against batch."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkloom.operators import retrieve, rounds, trust
from talkloom.streaming import stateful


def machine(rows):
    """The state machine, one conversation, one round at a time: (topic rounds, analyses) of each topic."""
    out, buffer, gathered = [], [], []
    for k, (changed, noise, said, analysis) in enumerate(rows):
        if analysis:
            gathered.append(analysis)
        if k and changed and noise:
            continue
        if k and changed:
            out.append((buffer, gathered))
            buffer, gathered = [], []
        buffer.append(said)
    return out + [(buffer, gathered)] if buffer else out


def random_rounds(seed, n=40):
    rng = random.Random(seed)
    out = []
    for conv in range(n):
        for k in range(1, rng.randrange(2, 14)):
            out.append((conv, k, f"r{conv}.{k}", rng.choice([True, False, None]), rng.choice([True, False, False, None]), rng.choice(["", "p", "q", f"x{k}"]), "", "e", None))
    return out


COLUMNS = "conv_id long, round_no int, round_dialog string, topic_changed boolean, is_noise boolean, user_prediction string, user_risk string, agent_empathy string, agent_action string"


def expected_records(rows, emit_open=True):
    out = {}
    for conv in {r[0] for r in rows}:
        topics = machine([(r[3], r[4], r[2], r[5]) for r in sorted(r for r in rows if r[0] == conv)] if True else [])
        for k, (said, analyses) in enumerate(topics if emit_open else topics[:-1]):
            out[conv, k] = (len(said), said[0][:30], "\n".join(said[-3:]), " | ".join(dict.fromkeys(analyses)))
    return out


@pytest.mark.parametrize("emit_open", [True, False])
def test_segmentation_equals_the_state_machine(spark, emit_open):
    rows = random_rounds(1)
    rows = [(*r[:3], bool(r[3]), bool(r[4]), *r[5:]) for r in rows] if emit_open else rows
    seg = rounds.segment(spark.createDataFrame(rows, COLUMNS), F.col("topic_changed"), F.col("is_noise"))
    got = {(r["conv_id"], r["topic_no"]): (r["n_rounds"], r["topic"], r["content"], r["user_prediction"]) for r in rounds.build_records(seg, emit_open=emit_open).collect()}
    assert got == expected_records(rows, emit_open)


def test_own_topic_attribution(spark):
    rows = [(1, 1, "a", False, False, "p1", "", "", ""), (1, 2, "b", True, False, "p2", "", "", ""), (1, 3, "c", True, True, "p3", "", "", "")]
    seg = rounds.segment(spark.createDataFrame(rows, COLUMNS), F.col("topic_changed"), F.col("is_noise"))
    of = lambda own: {r["topic_no"]: r["user_prediction"] for r in rounds.accumulate(seg, own).collect()}
    assert of(False) == {0: "p1 | p2", 1: "p3"} and of(True) == {0: "p1", 1: "p2 | p3"}


def test_pairing(spark):
    conv = [(1, 0, "system", "s"), (1, 1, "user", " u1 "), (1, 2, "assistant", "a1"), (1, 3, "user", "u2"), (1, 4, "user", "u3"), (1, 5, "assistant", "a3"), (1, 6, "user", "u4"), (2, 0, "assistant", "a")]
    got = rounds.pair_rounds(spark.createDataFrame(conv, "conv_id long, turn long, role string, text string")).orderBy("round_no").collect()
    assert [(r["round_no"], r["round_dialog"]) for r in got] == [(1, "user: u1\nagent: a1"), (2, "user: u3\nagent: a3")]


def scores(seed, n=400):
    rng = random.Random(seed)
    return [(rng.randrange(4), f"2024-01-0{1 + k // 100} {k % 24:02d}:{rng.randrange(60):02d}:00", k, rng.choice([-40, -5, 0, 3, 30, None])) for k in range(n)]


def test_trust_is_the_clamped_fold(spark):
    rows = scores(2)
    df = spark.createDataFrame(rows, "user_id long, t string, event_id long, change int").withColumn("ts", F.col("t").cast("timestamp_ntz")).drop("t")
    state, after = {}, {}
    for user, t, event, change in sorted(rows, key=lambda r: (r[1], r[2])):
        before = state.get(user, 0)
        state[user] = max(0, min(100, before + (change or 0)))
        after[event] = (before, state[user])
    assert {r["user_id"]: r["trust_score"] for r in trust.final_trust(df).collect()} == state
    assert {r["user_id"]: r["trust_score"] for r in trust.final_trust(df, unit="day").collect()} == state
    for n in ("1", "4", "40"):  # users in one partition, and spread over many
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = trust.running_trust(df).collect()
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert {r["event_id"]: (r["trust_before"], r["trust_score"]) for r in got} == after
    none = df.withColumn("user_id", F.lit(None).cast("long")).where("event_id < 9")
    assert trust.running_trust(none).count() == 9 and trust.running_trust(df.limit(0)).count() == 0


def test_dense_retrieval(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8))
    x[7] = x[3]
    x[9] = 0
    rec = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    queries = rec.where("id % 5 = 0")
    n = np.linalg.norm(x, axis=1, keepdims=True)
    unit = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
    for threshold in (None, 0.3):
        got = {}
        for r in retrieve.dense_top_k(queries, rec, threshold=threshold).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["record_id"], round(r["similarity"], 9)))
        for q in range(0, 60, 5):
            s = sorted(((-round(float(unit[q] @ unit[i]), 9), i) for i in range(60)))
            s = [(k + 1, i, -v) for k, (v, i) in enumerate(s[:5]) if threshold is None or -v > threshold]
            assert sorted(got.get(q, [])) == s
    assert retrieve.dense_top_k(queries.limit(0), rec).count() == 0 and retrieve.dense_top_k(queries, rec.limit(0)).count() == 0


def test_lexical_retrieval(spark):
    rec = spark.createDataFrame([(1, "red apple pie"), (2, "Red, apple!"), (3, "blue"), (4, None), (5, "red apple")], "id long, text string")
    q = spark.createDataFrame([(1, "red apple"), (2, ""), (3, "green")], "id long, text string")
    got = [(r["query_id"], r["record_id"], r["similarity"], r["rank"]) for r in retrieve.lexical_top_k(q, rec).orderBy("query_id", "rank").collect()]
    assert got == [(1, 2, 1.0, 1), (1, 5, 1.0, 2), (1, 1, round(2 / 6**0.5, 6), 3)]


# -- streaming


def stream(spark, tmp_path, df, order, start, name):
    """Runs a stateful operator twice on one checkpoint: the first half of the input, then the rest."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src, out, check = (str(tmp_path / f"{name}-{x}") for x in ("in", "out", "check"))
    cut = df.count() // 2
    numbered = df.orderBy(*order).collect()
    for part in (numbered[:cut], numbered[cut:]):
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(src)
        q = start(spark.readStream.schema(df.schema).parquet(src)).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(out)


def test_streaming_topics_equal_batch(spark, tmp_path):
    rows = random_rounds(5, 12)
    got = stream(spark, tmp_path, spark.createDataFrame(rows, COLUMNS), ["round_no", "conv_id"], stateful.closed_topics, "topics").collect()
    told = {(r["conv_id"], r["topic_no"]): (r["n_rounds"], r["topic"], r["content"], r["user_prediction"]) for r in got}
    assert len(told) == len(got) and told == expected_records(rows, emit_open=False)


def test_streaming_trust_equals_batch(spark, tmp_path):
    rows = [(u, t, e, c or 0) for u, t, e, c in scores(3, 120)]
    df = spark.createDataFrame(rows, "user_id long, t string, event_id long, change int").withColumn("ts", F.col("t").cast("timestamp_ntz")).drop("t")
    got = stream(spark, tmp_path, df, ["ts", "event_id"], stateful.running_trust, "trust").collect()
    assert {r["event_id"]: r["trust_score"] for r in got} == {r["event_id"]: r["trust_score"] for r in trust.running_trust(df).collect()}


def test_streaming_pieces_equal_batch(spark, tmp_path):
    from talkloom.operators import stream_text

    texts = ["Well, hello. How are you (today)? Fine, thanks", "一。二。三。" + "四" * 16 + "，五五", ""]
    rows = [(k, i, c, i == len(t) - 1) for k, t in enumerate(texts) for i, c in enumerate(t)]
    df = spark.createDataFrame(rows, "stream_id long, chunk_seq int, chunk string, last boolean")
    got = stream(spark, tmp_path, df, ["chunk_seq", "stream_id"], stateful.pieces, "pieces").collect()
    batch = stream_text.segment_streams(df.select("stream_id", "chunk_seq", "chunk")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch))
