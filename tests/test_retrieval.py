"""Lexical retrieval over a kept index, and vectors that can't be compared."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from talkloom.operators import lexical_index, retrieve


def by_hand(queries, records, k, threshold):
    words = lambda t: Counter((t or "").lower().split())
    norm = lambda c: math.sqrt(sum(n * n for n in c.values()))
    out = {}
    for q, text in queries:
        a, told = words(text), []
        for i, other in records:
            b = words(other)
            dot = sum(n * b[w] for w, n in a.items())
            s = round(dot / (norm(a) * norm(b)), 6) if dot else 0.0
            if s > threshold:
                told.append((-s, i))
        out[q] = [(i, -s) for s, i in sorted(told)[:k]]
    return {q: x for q, x in out.items() if x}


def told(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["record_id"], r["similarity"]))
    return out


def collection(seed, n, copies=0):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    weights = [1 / (k + 1) for k in range(300)]
    text = lambda m: " ".join(rng.choices(vocabulary, weights, k=m))
    records = [(k, text(rng.randrange(0, 40))) for k in range(n)] + [(n + k, "w0 w1 w250") for k in range(copies)]
    rng.shuffle(records)
    queries = [(k, text(rng.randrange(0, 12))) for k in range(30)] + [(90, "w0 w1 w250"), (91, "w0"), (92, None), (93, "unknown words")]
    return queries, [*records, (n + copies, None), (n + copies + 1, "")]


@pytest.mark.parametrize("shard, band, threshold", [(4_000_000, 16, 0.3), (900, 2, 0.3), (900, 3, -1.0), (2_000, 1, 0.6)])
def test_search_equals_brute_force(spark, shard, band, threshold):
    queries, records = collection(41, 300, copies=60)
    q, r = spark.createDataFrame(queries, "id long, text string"), spark.createDataFrame(records, "id long, text string").repartition(3)
    index = lexical_index.shards(r, shard, band)
    wanted = by_hand(queries, records, 5, max(threshold, 0.0) if threshold < 0 else threshold)
    got = told(retrieve.search_index(q, index, 5, threshold))
    assert got == wanted
    assert (index.count() > 5) == (shard < 4_000_000)


def test_a_kept_index_grows_and_reads_little(spark, tmp_path):
    queries, records = collection(42, 3000)
    path = str(tmp_path / "index")
    q, r = spark.createDataFrame(queries, "id long, text string"), spark.createDataFrame(records, "id long, text string")
    for part in (r.where("id % 3 = 0"), r.where("id % 3 > 0")):
        lexical_index.add(part, path)
    index = lexical_index.kept(spark, path)
    assert told(retrieve.search_index(q, index)) == by_hand(queries, records, 5, 0.3) == told(retrieve.lexical_top_k(q, r))
    reads = lexical_index.postings_read(q, index, 5, 0.3).collect()
    assert sum(x["n_read"] for x in reads) < 0.95 * sum(x["n_there"] for x in reads) and all(x["n_read"] <= x["n_there"] for x in reads)
    plan = retrieve.search_index(q, index)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") <= 1
    assert retrieve.search_index(q.limit(0), index).count() == 0 and retrieve.lexical_top_k(q, r.limit(0)).count() == 0


def test_vectors_that_cannot_be_compared(spark):
    nan, inf = float("nan"), float("inf")
    vecs = [(1, [1.0]), (2, [0.0, 0.0, 5.0]), (3, [1.0, 0.0]), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 0.0]), (7, None), (8, []), (9, [0.0, 0.0]), (10, [0.6, 0.8]), (None, [1.0, 0.0])]
    records = spark.createDataFrame(vecs, "id long, vec array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0, 1.0]), (3, [nan, 0.0]), (4, None), (5, [1.0])], "id long, vec array<double>")
    for size in (32 << 20, 16):
        got = told(retrieve.dense_top_k(queries, records, threshold=None, block_bytes=size))
        assert got == {1: [(3, 1.0), (10, 0.6), (9, 0.0)], 2: [(2, 1.0)], 5: [(1, 1.0)]}


@pytest.mark.parametrize("n, copies", [(3, 0), (3000, 0), (2500, 1500)])
def test_a_task_keeps_the_best_of_all_its_batches(spark, monkeypatch, n, copies):
    monkeypatch.setattr(retrieve, "TILE", 64)
    rng = np.random.default_rng(n)
    vecs = rng.integers(-3, 4, (n, 8)).astype(float)  # with many ties
    vecs[n - copies :] = [1.0, 2, 0, 0, 0, 0, 0, 1]
    best = retrieve._Best(np.arange(n), 5, -2.0)
    s = vecs @ vecs.T
    order = rng.permutation(n)
    for i in range(0, n, 1000):
        for j in range(0, n, 700):
            best.add(i, s[i : i + 1000, order[j : j + 700]], order[j : j + 700])
    wanted = np.argsort(-s, axis=1, kind="stable")[:, :5]
    got = np.where(best.score > -np.inf, best.id, -1)[:, : wanted.shape[1]]
    # ids of scores that do not count are not told
    told = np.take_along_axis(s, wanted, 1) > -2.0
    assert (got[told] == wanted[told]).all() and (got[~told] == -1).all()
    assert sum(b.num_rows for b in best.batches(["q", "r", "s"])) == told.sum()
