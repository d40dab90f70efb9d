"""Contracts and profile updates."""

import json

from pyspark.sql import functions as F

from talkloom.operators import profiles
from talkloom.sources import stores


def test_contracts(spark):
    row = spark.range(1).select(
        profiles.contract(F.lit('```json\n{"topic_changed": true, "confidence": 0.5, "more": 1}\n```'), "topic_boundary").alias("a"),
        profiles.contract(F.lit("no json"), "keywords").alias("b"),
        profiles.contract(F.lit('{"future": {"risk": "r"}}'), "user_analysis")["future"]["risk"].alias("c"),
        *[profiles.flag(F.lit(None).cast("string"), n, f).alias(f) for n, f in (("topic_boundary", "topic_changed"), ("noise", "is_noise"), ("worthiness", "is_worthy"))],
    ).first()
    assert tuple(row["a"]) == (True, 0.5) and (row["b"] is None or row["b"]["keywords"] is None) and row["c"] == "r"
    assert (row["topic_changed"], row["is_noise"], row["is_worthy"]) == (False, False, True)


def test_profile_updates(spark):
    old = spark.createDataFrame([(1, '{"Meta_Layer":"m","Concrete_Layer":"c"}', True), (2, '{"Meta_Layer":"n"}', True), (3, '{"Meta_Layer":"o"}', False)], "id long, document string, due boolean")
    records = spark.createDataFrame([(1, 2, "later"), (1, 1, "first"), (3, 1, "x")], "id long, seq int, topic string")
    judge = lambda ms: F.to_json(F.struct(F.element_at(ms, -1)["topic"].alias("Concrete_Layer")))
    of = lambda df: {r["id"]: (r["Meta_Layer"], r["Concrete_Layer"]) for r in df.collect()}
    assert of(profiles.update_profiles(old, records, judge)) == {1: ("m", "later"), 2: ("n", None), 3: ("o", "x")}
    assert of(profiles.update_profiles(old, records, judge, F.col("due"))) == {1: ("m", "later"), 2: ("n", None), 3: ("o", None)}


def test_activation(spark):
    doc = '{"Meta_Layer":"m","Behavior_Layer":"b"}'
    chosen = ['{"Meta_Layer":"m"}', "broken", "{}", "[1]"]
    got = spark.createDataFrame([(c,) for c in chosen], "c string").select(profiles.activated(F.lit(doc), F.col("c")).alias("a")).collect()
    told = [{k: v for k, v in json.loads(r["a"]).items() if v is not None} for r in got]
    assert told == [{"Meta_Layer": "m"}, json.loads(doc), json.loads(doc), json.loads(doc)]


def test_two_writers_of_profiles_take_two_versions(spark, tmp_path):
    path = str(tmp_path / "profiles")
    row = lambda v: spark.createDataFrame([(1, v)], "id int, v string")
    stores.save_profile(row("a"), path)
    assert stores._claimed(spark, path, "version-") == 2  # another writer is at it
    stores.save_profile(row("b"), path)
    assert stores.load_profile(spark, path, row("d")).first()["v"] == "b" and stores._version(spark, path) == 3


def test_stale_files_are_found_by_their_times(spark, tmp_path):
    import os
    import time

    from pyspark.sql import functions as F

    from talkloom.operators import events

    for name, age in (("recording_1.wav", 30), ("recording_2.wav", 2), ("other.wav", 90), ("recording_3.txt", 90)):
        (tmp_path / name).write_text("x")
        os.utime(tmp_path / name, (time.time() - age * 3600,) * 2)
    assert [r["name"] for r in events.stale_files(spark, str(tmp_path), F.current_timestamp()).collect()] == ["recording_1.wav"]
    assert events.stale_files(spark, str(tmp_path / "none"), F.current_timestamp()).count() == 0
