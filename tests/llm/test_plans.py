"""What is exploded in a step is never broadcast: Spark's estimates are those of the rows before it."""

import pytest

from talkloom.llm import near_copies, simhash


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_simhash_keys_are_shuffled(spark, tmp_path):
    spark.createDataFrame([(i * 0x1234567,) for i in range(50)], "fp long").write.parquet(str(tmp_path / "nodes"))
    plan = plan_of(simhash.links(spark.read.parquet(str(tmp_path / "nodes"))))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


@pytest.mark.parametrize("step", ["near-keys", "near-rest"])
def test_shingles_are_shuffled(spark, documents, monkeypatch, step):
    plans = {}

    def written(df, name, real=near_copies.written):
        plans[name] = plan_of(df)
        return real(df, name)

    monkeypatch.setattr(near_copies, "written", written)
    text = "one two three four five six seven eight nine ten eleven twelve"
    got = near_copies.near_duplicates(documents([(1, text, "a"), (2, text + " more", "a"), (3, "else", "a")])).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 1, 3: 3}
    joins = [line for line in plans[step].splitlines() if "Join" in line and "shingle" in line]
    assert joins and all("SortMergeJoin" in j for j in joins)
