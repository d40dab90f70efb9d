"""Judgements by a model: in waves over conversations, through a table of calls, and only where they are due."""

import json
import os
import random
import sys
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkloom.operators import calls, judge, rounds, wavefront

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def answer(kind, inputs):
    """A model in Python, whose judgements depend on the open topic."""
    told = json.loads(inputs)
    if kind == "topic_boundary":
        return json.dumps({"topic_changed": (len(told["history"].split("\n\n")) + len(told["dialog"])) % 3 == 0})
    if kind == "noise":
        return json.dumps({"is_noise": (len(told["topic"]) + len(told["dialog"])) % 2 == 0})
    if kind == "topic_init":
        return None if "no name" in told["dialog"] else json.dumps({"topic": f"about {told['dialog'][:5]}"})
    return json.dumps({"topic": "t", "content": f"{len(told['rounds'])} rounds", "keywords": ["k"]})


def counting(folder, reply=answer):
    """The model, with a file for each call; and a function that tells the calls so far."""
    os.makedirs(folder, exist_ok=True)

    def call(kind, inputs):
        import uuid

        with open(f"{folder}/{kind}-{uuid.uuid4().hex}", "w"):
            pass
        return reply(kind, inputs)

    return call, lambda kind="": sum(n.startswith(kind) for n in os.listdir(folder))


def one_by_one(conv):
    """The state machine, one conversation: (boundary, dropped, topic_no, analysis_topic, open topic) of each round, and the calls."""
    history, name, number, out, made = [], None, 0, [], 0

    def first(d):
        told = answer("topic_init", json.dumps({"dialog": d}))
        return (json.loads(told)["topic"] if told else d[:30]).strip()

    for d in conv:
        before = number
        if not history:
            history, name, made = [d], first(d), made + 1
            out.append((False, False, 0, 0, name))
            continue
        made += 1
        changed = json.loads(answer("topic_boundary", json.dumps({"history": "\n\n".join(history), "dialog": d})))["topic_changed"]
        noise = False
        if changed:
            made += 1
            noise = json.loads(answer("noise", json.dumps({"dialog": d, "topic": name})))["is_noise"]
            if not noise:
                history, name, number, made = [d], first(d), number + 1, made + 1
        else:
            history.append(d)
        out.append((changed and not noise, changed and noise, number, before, name))
    return out, made


def conversations(seed, n):
    rng = random.Random(seed)
    return {c: ["no name " * rng.randint(0, 1) + f"{c}.{k}" + "x" * rng.randint(0, 9) for k in range(rng.randint(1, 9))] for c in range(n)}


SCHEMA = "conv_id long, round_no int, round_dialog string, user_prediction string, user_risk string, agent_empathy string, agent_action string"


def table(spark, convs):
    return spark.createDataFrame([(c, k + 1, d, f"p{k}", "", "", "") for c, ds in convs.items() for k, d in enumerate(ds)], SCHEMA)


def test_waves_equal_the_state_machine(spark, tmp_path):
    convs = conversations(1, 25)
    call, made = counting(str(tmp_path / "calls"))
    udf = F.udf(lambda kind, inputs: call(kind, inputs), T.StringType())
    got = wavefront.segment_with(table(spark, convs), judge.Model(lambda kind, inputs: udf(F.lit(kind), inputs)))
    expected = {c: one_by_one(ds) for c, ds in convs.items()}
    assert made() == sum(n for _, n in expected.values())  # results are kept: no call was made twice, none for a round that needs none
    told = {(r["conv_id"], r["round_no"]): (r["boundary"], r["dropped"], r["topic_no"], r["analysis_topic"], r["open_topic"]) for r in got.collect()}
    assert told == {(c, k + 1): x for c, (xs, _) in expected.items() for k, x in enumerate(xs)}
    assert made() == sum(n for _, n in expected.values())
    assert any(x[1] for x in told.values()) and any(x[0] for x in told.values())
    records = {(r["conv_id"], r["topic_no"]): r for r in rounds.build_records(got).collect()}
    for c, (xs, _) in expected.items():
        for number in {x[2] for x in xs}:
            assert records[c, number]["n_rounds"] == sum(x[2] == number and not x[1] for x in xs)
            assert records[c, number]["user_prediction"] == " | ".join(f"p{k}" for k, x in enumerate(xs) if x[3] == number)


def test_waves_go_on_after_a_break(spark, tmp_path):
    convs = {7: [f"7.{k}" for k in range(6)], None: ["a", "b"]}
    folder, state = str(tmp_path / "waves"), {"left": 3}

    class Breaks(judge.Model):
        def column(self, df, name, judged):
            if name == "changed":
                state["left"] -= 1
                if not state["left"]:
                    raise RuntimeError("lost")
            return super().column(df, name, judged)

    call, made = counting(str(tmp_path / "calls"))
    udf = F.udf(lambda kind, inputs: call(kind, inputs), T.StringType())
    respond = lambda kind, inputs: udf(F.lit(kind), inputs)
    with pytest.raises(RuntimeError, match="lost"):
        wavefront.segment_with(table(spark, convs), Breaks(respond), folder)
    got = wavefront.segment_with(table(spark, convs), judge.Model(respond), folder).collect()
    assert sorted((str(r["conv_id"]), r["round_no"], r["topic_no"]) for r in got) == sorted((str(c), k + 1, x[2]) for c, ds in convs.items() for k, x in enumerate(one_by_one(ds)[0]))
    assert made() == sum(one_by_one(ds)[1] for ds in convs.values())
    empty = wavefront.segment_with(table(spark, {}), judge.Model(respond))
    assert empty.count() == 0 and "open_topic" in empty.columns


def test_calls_are_made_once(spark, tmp_path):
    call, made = counting(str(tmp_path / "calls"))
    model = calls.CallTable(call, str(tmp_path / "table"), tasks=3, at_once=2, part=4)
    convs = {c: ["same opening", "then this", f"and {c % 3}"] for c in range(12)}
    got = wavefront.segment_with(table(spark, convs), model)
    told = {(r["conv_id"], r["round_no"]): (r["boundary"], r["dropped"], r["topic_no"], r["analysis_topic"], r["open_topic"]) for r in got.collect()}
    assert told == {(c, k + 1): x for c, ds in convs.items() for k, x in enumerate(one_by_one(ds)[0])}
    n = made()
    assert n <= sum(one_by_one(convs[c])[1] for c in range(3))  # twelve conversations, three different ones
    records = rounds.build_records(got, model=model).collect()
    assert {r["content"] for r in records} <= {"1 rounds", "2 rounds", "3 rounds"} and {tuple(r["keywords"]) for r in records} == {("k",)}
    m = made()
    wavefront.segment_with(table(spark, convs), model).collect()
    rounds.build_records(got, model=model).collect()
    assert made() == m > n  # a second run calls for nothing


def test_calls_that_fail_or_hang_have_no_response_and_are_asked_again(spark, tmp_path):
    def slow(kind, inputs):
        if "hangs" in inputs:
            time.sleep(30)
        if "fails" in inputs:
            raise ValueError("no service")
        return '{"score": 2}'

    call, made = counting(str(tmp_path / "calls"), slow)
    model = calls.CallTable(call, str(tmp_path / "table"), tasks=1, seconds=1.0)
    df = spark.createDataFrame([("fine",), ("hangs",), ("fails",), ("fine",)], "message string")
    began = time.time()
    got = model.column(df, "score", lambda m: m.score(F.col("message"), F.lit("stage")))
    assert sorted((r["message"], r["score"]) for r in got.collect()) == [("fails", 0), ("fine", 2), ("fine", 2), ("hangs", 0)] and time.time() - began < 25
    assert made() == 3
    model.column(df, "score", lambda m: m.score(F.col("message"), F.lit("stage"))).collect()
    assert made() == 5


def test_a_task_that_is_run_again_repeats_no_kept_call(tmp_path):
    call, made = counting(str(tmp_path / "calls"))
    rows = [(f"k{k}", "topic_init", json.dumps({"dialog": f"d{k}"})) for k in range(6)]
    folder = str(tmp_path / "parts")
    first = calls.answered(rows[:3], call, folder, 2, 5.0)
    again = [calls.answered(rows[k : k + 3], call, folder, 2, 5.0) for k in (0, 3)]
    assert made() == 6 and again[0].to_pylist() == first.to_pylist() and len(os.listdir(folder)) == 2


def test_profiles_without_records_are_not_judged(spark, tmp_path):
    call, made = counting(str(tmp_path / "calls"), lambda kind, inputs: json.dumps({"Meta_Layer": kind}))
    udf = F.udf(lambda kind, inputs: call(kind, inputs), T.StringType())
    model = judge.Model(lambda kind, inputs: udf(F.lit(kind), inputs))
    profiles = spark.createDataFrame([(k, '{"Meta_Layer": "m"}', "{}") for k in range(10)], "id long, user string, own string")
    records = spark.createDataFrame([(4, 1, "a"), (4, 2, "b")], "id long, seq int, topic string")
    got = {r["id"]: json.loads(r["user"])["Meta_Layer"] for r in judge.update_profiles(profiles, records, model).collect()}
    assert got == {k: "user_update" if k == 4 else "m" for k in range(10)} and made("user_update") >= 1 and made() <= 4


def test_a_model_is_a_provider(spark, tmp_path):
    from talkloom.operators import providers

    def reply(kind, inputs):
        told = json.loads(inputs)
        if kind == "user_analysis":
            return json.dumps({"future": {"prediction": f"after {told['message']}", "risk": "r"}})
        if kind == "persona_analysis":
            return json.dumps({"present": {"empathy": json.loads(told["profile"])["future"]["prediction"]}, "future": {"action": "a"}})
        return answer(kind, inputs)

    convs = conversations(3, 6)
    df = table(spark, convs).drop("user_prediction", "user_risk", "agent_empathy", "agent_action").withColumn("user_text", F.concat(F.lit("u"), F.col("round_no")))
    p = providers.provider("model", model=calls.CallTable(reply, str(tmp_path / "table"), tasks=2))
    judged = rounds.segment(p.analyses(p.flags(df)), F.col("topic_changed"), F.col("is_noise"))
    told = {(r["conv_id"], r["round_no"]): r for r in judged.collect()}
    assert {k: (r["boundary"], r["dropped"], r["topic_no"], r["analysis_topic"]) for k, r in told.items()} == {(c, k + 1): x[:4] for c, ds in convs.items() for k, x in enumerate(one_by_one(ds)[0])}
    assert all((r["user_prediction"], r["user_risk"], r["agent_empathy"], r["agent_action"]) == (f"after u{k}", "r", f"after u{k}", "a") for (_, k), r in told.items())
    with pytest.raises(ValueError, match="no provider"):
        providers.provider("unknown")


def test_profile_updates_make_the_records_once(spark):
    from talkloom.plans import catalog

    read = catalog.model_profile_updates(spark, "/root/testdata/sf0.001").inputFiles()
    assert read and all("talkloom-records-" in f for f in read)  # not the conversations, once for each use
