"""As-of joins against a plain search, and profiles that are refreshed only where they are due."""

import json
import os
import random
import sys
from datetime import datetime, timedelta

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from talkloom.operators import asof, calls, refresh

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@pytest.mark.parametrize("exact", [False, True])
def test_asof_equals_a_search(spark, exact):
    rng = random.Random(31)
    users = [0, 0, 0, 0, 1, 2, 3, None]
    left = [(k, rng.choice(users), rng.choice([None, *range(60)]) if k % 9 == 0 else rng.randrange(60), "x") for k in range(400)]
    right = [(rng.choice([0, 0, 0, 1, 2, 9, None]), rng.choice([None, *range(60)]), e, rng.choice([None, f"v{e}"])) for e in range(150)]
    a = spark.createDataFrame(left, "k int, user int, ts int, value string").repartition(5)
    b = spark.createDataFrame(right, "user int, ts int, event int, value string").repartition(3)
    got = {r["k"]: (r["value"], r["event"]) for r in asof.asof_join(a, b, ["user"], "ts", ["value", "event"], tie=["event"], exact=exact).collect()}
    want = {}
    for k, user, ts, _ in left:
        before = [r for r in right if user is not None and ts is not None and r[0] == user and r[1] is not None and (r[1] < ts or exact and r[1] == ts)]
        best = max(before, key=lambda r: (r[1], r[2]), default=None)
        want[k] = (best[3], best[2]) if best else (None, None)
    assert got == want and len(got) == 400


def test_asof_carries_over_batches_and_partitions(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        a = spark.range(300).select(F.lit(1).alias("user"), F.col("id").alias("ts"), F.lit(2).alias("more"))
        b = spark.createDataFrame([(1, 5, "a"), (1, 100, "b"), (1, 101, "c"), (2, 200, "d")], "user int, ts long, v string")
        got = [r["v"] for r in asof.asof_join(a.unionByName(a), b, ["user"], "ts", ["v"]).orderBy("ts").collect()]
        assert got == [v for k in range(300) for v in [None if k <= 5 else "a" if k <= 100 else "b" if k == 101 else "c"] * 2]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert asof.asof_join(a, b.limit(0), ["user"], "ts", ["v"]).where("v is null").count() == 300
    assert asof.asof_join(a.limit(0), b, ["user"], "ts", ["v"]).count() == 0


def test_only_due_profiles_with_new_records_reach_the_model(spark, tmp_path):
    folder = str(tmp_path / "calls")
    os.makedirs(folder)

    def call(kind, inputs):
        import uuid

        with open(f"{folder}/{kind}-{uuid.uuid4().hex}", "w"):
            pass
        told = json.loads(inputs)
        return json.dumps({"Meta_Layer": f"{kind} {len(json.loads(told['records']))} {told['user'][:1]}"})

    made = lambda: len(os.listdir(folder))
    store, start = str(tmp_path / "profiles"), datetime(2024, 1, 1)
    profiles = spark.createDataFrame([(k, '{"Meta_Layer": "m"}', "{}") for k in range(8)], "id long, user string, own string")
    records = lambda *rows: spark.createDataFrame(list(rows), "id long, seq int, topic string")
    none, one, two = records(), records((1, 1, "a"), (2, 1, "b"), (None, 1, "x"), (99, 1, "y"), (3, None, "z")), records((1, 1, "a"), (2, 1, "b"), (2, 2, "c"))

    def run(hours, there, **options):
        # a new table of calls each time: what isn't called now isn't called at all
        model = calls.CallTable(call, str(tmp_path / f"table-{hours}"), tasks=2)
        return {r["id"]: json.loads(r["user"])["Meta_Layer"] for r in refresh.refresh(store, profiles, there, model, start + timedelta(hours=hours), **options).collect()}

    plain = dict.fromkeys(range(8), "m")
    assert run(0, one) == plain and run(23, one) == plain and run(24, none) == plain and made() == 0
    assert run(25, one) == plain | {1: "user_update 1 {", 2: "user_update 1 {"} and made() == 4
    assert run(26, two)[2] == "user_update 1 {" and made() == 4  # new records, but not due
    assert run(60, two) == plain | {1: "user_update 1 {", 2: "user_update 2 {"} and made() == 6  # due, and new records for one
    assert run(100, two)[2] == "user_update 2 {" and made() == 6  # due, nothing new: no call
    more = records((1, 1, "a"), (2, 2, "c"), (2, 3, "d"), (2, 4, "e"))
    assert run(101, more, only_new=True)[2] == "user_update 2 {" and made() == 8
    assert len(os.listdir(store)) == 4
    before = sorted(map(tuple, refresh.current(spark, store).collect()))
    refresh.compact(spark, store)
    assert len(os.listdir(store)) == 1 and sorted(map(tuple, refresh.current(spark, store).collect())) == before
    assert refresh.current(spark, str(tmp_path / "nothing")) is None
