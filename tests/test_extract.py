"""Extractive summaries against the walk over the whole matrix of similarities."""

import random
import re

import numpy as np

from talkloom.operators import extract

SCHEMA = "conv_id long, topic_no int, round_no int, dropped boolean, user_text string, agent_text string"


def dense(said, steps, damping):
    """Ranks of a topic's sentences, by the matrix."""
    words = [re.findall(r"[a-z0-9]+", s.lower()) for s in said]
    vocabulary = sorted({w for ws in words for w in ws})
    x = np.array([[ws.count(v) for v in vocabulary] for ws in words], float)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    w = x @ x.T
    w /= w.sum(1, keepdims=True)
    p = np.full(len(said), 1 / len(said))
    for _ in range(steps):
        p = (1 - damping) / len(said) + damping * (w.T @ p)
    return p


def test_ranks_equal_the_dense_walk(spark):
    rng = random.Random(51)
    word = lambda: f"w{rng.randrange(25)}"
    rows = []
    for conv in range(6):
        for k in range(1, rng.randint(2, 6)):
            talk = lambda: ". ".join(" ".join(word() for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 5)))
            rows.append((conv, k // 3, k, rng.random() < 0.1, talk() + "! ", f"?\n {talk()}"))
    got = {}
    for r in extract.ranked(extract.sentences(spark.createDataFrame(rows, SCHEMA)), 11, 0.8).collect():
        got.setdefault((r["conv_id"], r["topic_no"]), []).append((r["round_no"], r["pos"], r["sentence"], r["rank"]))
    assert len(got) > 6 and {k for k in got} == {(r[0], r[1]) for r in rows if not r[3]}
    for told in got.values():
        told.sort()
        assert np.allclose([t[3] for t in told], dense([t[2] for t in told], 11, 0.8), atol=1e-12) and abs(sum(t[3] for t in told) - 1) < 1e-9


def test_summaries(spark):
    long = "the cat sat on the mat " * 30
    rows = [
        (1, 0, 1, False, "The cat sat on the mat. Dogs bark", "The cat sat on a mat! Nothing else"),
        (1, 0, 2, True, "The cat sat on the mat. The cat sat on the mat", ""),
        (2, 0, 1, False, long, None),
        (3, 0, 1, False, "!?", " . "),
        (4, 0, 1, False, "same words. same words", "other"),
    ]
    got = {r["conv_id"]: (r["topic"], r["content"]) for r in extract.summaries(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == {1, 2, 4}
    assert got[1][0] in ("The cat sat on the mat", "The cat sat on a mat") and got[1][1].split("\n") == ["The cat sat on the mat", "Dogs bark", "The cat sat on a mat", "Nothing else"]
    assert got[2] == (long[:30].strip(), long[:300])
    assert got[4][0] == "same words" and got[4][1] == "same words\nsame words\nother"
    assert extract.summaries(spark.createDataFrame([], SCHEMA)).count() == 0


def test_steps_deal_numbers_not_words(spark, monkeypatch):
    plans = []

    def written(df, name, real=extract.written):
        if name == "sentence-ranks":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(extract, "written", written)
    extract.ranked(extract.sentences(spark.createDataFrame([(1, 0, 1, False, "one two. two three", "")], SCHEMA)), 1).count()
    assert len(plans) == 1 and not {"word#", "conv_id#", "round_no#"} & set(re.findall(r"\w+#", plans[0]))
