"""What steps make and leave behind, on small tables whose groups would make it grow."""

import os
import random

from talkloom.llm import near_copies


def unlike_copies(n, edits=4):
    """Texts of 200 words, edited so often that hardly two of them are near copies, though all share most of their shingles."""
    rng = random.Random(21)
    base = [f"w{k}" for k in range(200)]
    out = []
    for i in range(n):
        words = list(base)
        for k, at in enumerate(rng.sample(range(200), edits)):
            words[at] = f"x{i}-{k}"
        out.append(" ".join(words))
    return out


def test_texts_below_the_similarity_are_not_compared_pair_by_pair(spark, documents, monkeypatch):
    made = {}

    def written(df, name, real=near_copies.written):
        out = real(df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(near_copies, "written", written)
    texts = unlike_copies(40)
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_duplicates(documents([(i, t, None) for i, t in enumerate(texts)])).collect()}
    sets = [near_copies.shingle_set(t) for t in texts]
    linked = [(a, b) for a in range(40) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    root = list(range(40))
    for _ in root:
        for a, b in linked:
            root[a] = root[b] = min(root[a], root[b])
    assert got == dict(enumerate(root)) and len(set(root)) > 20
    assert made["near-rest"] < 3 * len(linked) + 40  # of 780 pairs


def test_a_group_at_the_limit_of_similarity_is_merged_before_its_pairs_are_made(spark, documents, monkeypatch):
    made = {}

    def written(df, name, real=near_copies.written):
        out = real(df, name)
        made.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(near_copies, "written", written)
    rng = random.Random(22)
    texts = []
    for i in range(120):
        words = [f"w{k}" for k in range(265)]
        for k, at in enumerate(rng.sample(range(265), 3)):
            words[at] = f"x{i}-{k}"
        texts.append(" ".join(words))
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_duplicates(documents([(i, t, None) for i, t in enumerate(texts)])).collect()}
    sets = [near_copies.shingle_set(t) for t in texts]
    linked = [(a, b) for a in range(120) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    root = list(range(120))
    for _ in root:
        for a, b in linked:
            root[a] = root[b] = min(root[a], root[b])
    assert got == dict(enumerate(root))
    assert 1000 < len(linked) < 6000  # of 7,140 pairs, so that the first text has not linked all
    assert sum(made["near-rest"]) < 2 * len(texts) and sum(made["near-drawn"]) < 10 * len(texts), {k: v for k, v in made.items()}


def test_texts_apart_by_their_sketches_are_not_moved(spark, documents, monkeypatch):
    moved = []

    def written(df, name, real=near_copies.written):
        out = real(df, name)
        if name == "near-texts":
            moved.append(out.count())
        return out

    monkeypatch.setattr(near_copies, "written", written)
    texts = [*unlike_copies(40), "a b c d e f g h i j k l m n o p q r s t", "a b c d e f g h i j k l m n o p q r s t u"]
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_duplicates(documents([(i, t, None) for i, t in enumerate(texts)])).collect()}
    assert got[41] == 40 and len(set(got.values())) > 20
    sets = [near_copies.shingle_set(t) for t in texts]
    linked = {i for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j and len(a & b) >= 0.8 * len(a | b) - 1e-9}
    assert sum(moved) <= 2 * len(linked) + 4  # each of 42 texts met the first one's shingles


def test_prefixes_are_shuffled_once(spark):
    nodes = spark.createDataFrame([(k, 10 + k, [1, k, 100 + k % 2]) for k in range(2, 8)], "node long, n int, prefix array<long>")
    found = near_copies.shared_keys(nodes)
    got = {(r["shingle"], r["node"]): tuple(r)[2:] for r in found.collect()}
    assert got == {(s, k): (10 + k, at, hub, 10 + hub, at) for k in range(2, 8) for s, at, hub in ((1, 0, 2), (100 + k % 2, 2, 2 + k % 2))}
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(shingle" in line]
    assert sorted("ReusedExchange" in line for line in dealt) == [False, True]


def test_places_do_not_depend_on_tasks(spark, documents):
    docs = documents([(i, f"{i} a b c d e", None) for i in range(64)])
    one, many = (near_copies.place_steps(docs.repartition(n), "text", 5) for n in (1, 32))
    assert (one == many).all()
    common = near_copies.place_of(near_copies.Hasher()("a b c d e"))
    assert one[common].tolist() == [48]  # 8 log2 64
    prefixes = [r["prefix"] for r in near_copies.shingled(docs.repartition(32), "doc_id", "text", 5, 0.8).collect()]
    assert all(int(near_copies.Hasher()("a b c d e").view("int64")[0]) != p[0] for p in prefixes)
    assert not near_copies.place_steps(documents([]), "text", 5).any()


def test_near_dedup_leaves_only_names_behind(spark, documents):
    import corpus_pipeline

    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    kept = corpus_pipeline.near_dedup(spark, documents([(i, t, None) for i, t in enumerate(unlike_copies(5, 1))]), "")
    left = set(os.listdir(folder)) - before
    assert len(left) == 1 and "near-duplicates" in left.pop()
    assert [r["doc_id"] for r in kept.collect()] == [0]


def test_pieces_are_looked_up_where_one_begins_and_once_for_all_components(monkeypatch):
    import numpy as np

    from talkloom.llm import lm_score

    v = lm_score.Vocabulary({"\u2581": 0.1, "\u2581ab": 0.2, "a": 0.1, "b": 0.1, "abcabcabcabc": 0.1}, 0.001)
    asked, swept, real, sweep = [], [], np.searchsorted, lm_score._sweep
    monkeypatch.setattr(np, "searchsorted", lambda a, x, *more: asked.append(len(x)) or real(a, x, *more))
    monkeypatch.setattr(lm_score, "_sweep", lambda *a: swept.append(1) or sweep(*a))
    logs = np.log(np.repeat(v.weight[:, None], 3, axis=1))
    got = lm_score.expected(v, ["ba" * 20] * 4, logs, np.ones((4, 3), bool))
    assert np.allclose(got, got[:, :1]) and np.isclose(got[v.number["b"], 0], 80)
    assert len(swept) == 2 and sum(asked) <= 12 * (41 + 41 + 20 + 20)  # of places: 41 in a word, 20 where "ab" begins

    far = np.log(np.array([[1e-30]] * 6))  # of 40 characters, beyond what a float can hold
    assert np.isclose(lm_score.marginals(v, ["b" * 40], far)[0, 0], 41 * far[0, 0])


def test_sums_of_pairs_travel_in_few_rows(spark, monkeypatch):
    from talkloom.llm import lm_score

    texts = [bytes(32 + (i * k) % 90 for k in range(300)) for i in range(1, 30)]
    docs = spark.createDataFrame([(bytearray(t), i) for i, t in enumerate(texts)], "t binary, h long")
    frame = type(docs)
    made, real = [], frame.mapInArrow

    def run(self, func, schema, *more, **named):
        out = real(self, func, schema, *more, **named)
        made.append(out) if "sums" in out.columns or "pair" in out.columns else None
        return out

    monkeypatch.setattr(frame, "mapInArrow", run)
    kinds = lm_score.fit_kinds_of(docs, 2)
    plain = lm_score.fit_kinds(texts, 2)
    assert (kinds.table == plain.table).all() and (kinds.share == plain.share).all()
    assert made and all(set(d.columns) <= {"first", "rows", "sums"} for d in made)
