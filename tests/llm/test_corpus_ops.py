"""Suffix dedup, language-model scores, SimHash, product quantisation, components, the pipeline."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkloom.llm import lm_score, pq, simhash, suffix_dedup
from talkloom.llm.components import components


def least_reachable(nodes, linked):
    """By repeated relaxation."""
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return label


# -- components


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(60)], [(5, 5), (None, 3), (7, 3), (7, 3), (3, 9)], [(random.Random(1).randrange(90), random.Random(k).randrange(90)) for k in range(70)]])
def test_components(spark, edges):
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    assert got == least_reachable({n for e in real for n in e}, real)


# -- suffix dedup


def cut(rows, length):
    """By looking at every string of every text."""
    first = {}
    key = lambda i: math.inf if i is None else i
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            first[b[k : k + length]] = min(first.get(b[k : k + length], math.inf), key(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < key(i):
                gone[k : k + length] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=lambda r: (key(r[0]), r))


def repetitive(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7)))
    pool = [" ".join(word() for _ in range(rng.randrange(3, 40))) for _ in range(12)]
    texts = [" ".join(rng.choice(pool) if rng.random() < 0.6 else word() for _ in range(rng.randrange(0, 12))) for _ in range(n)]
    return texts + ["a" * 400, "a" * 90, "ab" * 100, "", None, "x" * 49, "x" * 50, "x" * 50, pool[0] * 30]


@pytest.mark.parametrize("options", [{}, {"block_bytes": 700, "bucket_bytes": (900, 500), "hot": 200}, {"length": 20, "anchor": 9, "block_bytes": 2000, "bucket_bytes": (4000, 4000)}])
def test_suffix_dedup_matches_brute_force(spark, documents, options):
    texts = repetitive(3, 50)
    rng = random.Random(9)
    ids = rng.sample(range(1000), len(texts))
    rows = list(zip(ids, texts)) + [(None, texts[0]), (None, "a" * 400), (ids[0], texts[0]), (ids[1], texts[2])]
    got = suffix_dedup.dedup(documents([(i, t, None) for i, t in rows]).repartition(3), **options).collect()
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) for r in got), key=lambda r: (math.inf if r[0] is None else r[0], r))
    assert got == cut(rows, options.get("length", 50))


def test_suffix_dedup_of_little(spark, documents):
    assert suffix_dedup.dedup(documents([])).count() == 0
    one = suffix_dedup.dedup(documents([(1, None, None)]), keep=["lang", "source", "n_bytes"]).collect()
    assert len(one) == 1 and one[0]["n_bytes"] == 0 and one[0]["source"] == "s"
    two = suffix_dedup.dedup(documents([(1, "é" * 40, None), (2, "x" + "é" * 40, None)]), decode=True).orderBy("doc_id").collect()
    assert [r["kept"] for r in two] == ["é" * 40, "x"]


# -- language-model scores

PIECES = {"▁": 0.1, "▁a": 0.2, "a": 0.05, "b": 0.1, "ab": 0.2, "▁ab": 0.1, "ba": 0.05}


def segmentations(s, pieces):
    """All ways to spell a string: lists of pieces, a character that is none as None."""
    if not s:
        yield []
    for p in [*[x for x in pieces if s.startswith(x)], *([None] if s and s[0] not in pieces else [])]:
        for rest in segmentations(s[len(p) if p else 1 :], pieces):
            yield [p or (None, len(s[0].encode())), *rest]


def plain_lattice(word, weights, byte):
    """The marginal probability and the expected pieces of a word, by listing its segmentations."""
    total, expected = 0.0, Counter()
    ways = []
    for way in segmentations("▁" + word, weights):
        p = math.prod(byte ** x[1] if isinstance(x, tuple) else weights[x] for x in way)
        ways.append((p, way))
        total += p
    for p, way in ways:
        for x in way:
            expected[None if isinstance(x, tuple) else x] += p / total * (x[1] if isinstance(x, tuple) else 1)
    return total, expected


def test_lattice_sums_over_all_segmentations():
    v = lm_score.Vocabulary(PIECES, 0.001)
    weights = dict(zip(PIECES, v.weight))
    words = ["a", "ab", "abab", "bbaab", "aéb", "c", "abcab", "中a", "😀"]
    logs = np.log(np.stack([v.weight, v.weight**1.5 / (v.weight**1.5).sum()], axis=1))
    got = lm_score.marginals(v, words, logs)
    for k in (0, 1):
        own = dict(zip(PIECES, np.exp(logs[:, k])))
        told = [plain_lattice(w, own, math.exp(logs[-1, k])) for w in words]
        assert got[:, k] == pytest.approx([math.log(t) for t, _ in told])
        present = np.zeros((len(words), 2), bool)
        present[:, k] = True
        expected = lm_score.expected(v, words, logs, present)[:, k]
        total = sum((c for _, c in told), Counter())
        assert expected == pytest.approx([total[p] for p in [*PIECES, None]])
    assert sum(weights.values()) + 256 * v.weight[-1] == pytest.approx(1)
    long = lm_score.marginals(v, ["ab" * 20000], np.log(v.weight)[:, None])
    assert np.isfinite(long).all() and long[0, 0] < -10000


@pytest.mark.parametrize("options", [{"classes": 1, "parts": ()}, {"classes": 2, "parts": (2, 1)}, {"classes": 3, "parts": (1,), "block_bytes": 300}])
def test_scores_match_brute_force(spark, documents, options):
    v = lm_score.Vocabulary(PIECES, 0.001)
    rng = random.Random(2)
    rows = [(i, " ".join("".join(rng.choice("abC" if i % 2 else "abb") for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(0, 30))), None) for i in range(40)]
    rows += [(40, None, None), (41, "", None), (42, "é\u2028É  x\ty", None), (43, "z" * 9, None), (None, "a b", None), (3, rows[3][1], None), (3, rows[3][1], None)]
    learns = lambda i: i is None or i % 5 != 1
    words = lambda t: [w.decode() for w in (t or "").encode().lower().split()]
    texts = {t for i, t, _ in rows if learns(i) and t is not None}
    kinds = lm_score.fit_kinds([t.encode() for t in in_hash_order(spark, texts)], options["classes"])
    k = len(kinds.share)
    member = [kinds.of((t or "").encode().lower()) for _, t, _ in rows]
    counts, ends = [Counter() for _ in range(k)], [0] * k
    for (i, t, _), m in zip(rows, member):
        if learns(i):
            counts[m].update(words(t))
            ends[m] += 1
    all_counts = sum(counts, Counter())
    n_k = [sum(c.values()) + e for c, e in zip(counts, ends)]
    v_k = [len(c) + (e > 0) for c, e in zip(counts, ends)]
    n, distinct = sum(n_k), len(all_counts) + 1
    weights = [dict(zip([*PIECES, None], v.weight)) for _ in range(k)]
    for part in options["parts"]:
        found, mine = [], lambda c: [w for w in c if zlib.crc32(w.encode()) % part == 0]  # noqa: B023
        for m in range(k):
            found.append(sum((plain_lattice(w, {p: weights[m][p] for p in PIECES}, weights[m][None])[1] for w in mine(counts[m])), Counter()))
        pooled = {p: sum(f[p] for f in found) + lm_score.PRIOR * x * (256 if p is None else 1) for p, x in zip([*PIECES, None], v.weight)}
        for m in range(k):
            mass = {p: found[m][p] + lm_score.POOLED * pooled[p] / sum(pooled.values()) for p in pooled}
            weights[m] = {p: x / sum(mass.values()) / (256 if p is None else 1) for p, x in mass.items()}

    def p_word(w, m):
        c, c_k = (sum(ends), ends[m]) if w is None else (all_counts[w], counts[m][w])
        lattice = 0.0 if w is None else plain_lattice(w, {p: weights[m][p] for p in PIECES}, weights[m][None])[0]
        p0 = (max(c - lm_score.D, 0) + lm_score.D * distinct * lattice) / n
        return (max(c_k - lm_score.D, 0) + lm_score.D * v_k[m] * p0) / n_k[m] if n_k[m] else p0

    expected = []
    for i, t, _ in rows:
        each = [*words(t), None]
        base = sum(math.log10(((sum(ends) if w is None else all_counts[w]) + 0.5) / (n + 0.5 * (distinct + 1))) for w in each)
        ways = [math.log10((ends[m] + 1) / (sum(ends) + k)) + sum(math.log10(p_word(w, m)) for w in each) for m in range(k)]
        score = max(ways) + math.log10(sum(10 ** (x - max(ways)) for x in ways))
        known = sum(w is None or all_counts[w] > 0 for w in each)
        expected.append((-1 if i is None else i, not learns(i), len(each), known, n, pytest.approx(base), pytest.approx(score, abs=len(each) / 2 / lm_score.UNITS + 1e-4)))
    got = lm_score.score(documents(rows), v, F.col("doc_id") % 5 != 1, **options).collect()
    told = sorted((-1 if r[0] is None else r[0], *tuple(r)[1:]) for r in got)
    assert told == sorted(expected, key=lambda r: (r[0], r[2]))


def in_hash_order(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return [r["t"] for r in df.orderBy(F.xxhash64("t")).collect()]


def test_model_is_a_distribution():
    """What words, seen and unseen, get in all: the pieces spell strings over two letters up to a length."""
    import itertools

    v = lm_score.Vocabulary({"▁": 0.2, "▁a": 0.2, "a": 0.1, "b": 0.1, "ab": 0.1}, 1e-9)
    words = ["".join(x) for n in range(0, 13) for x in itertools.product("ab", repeat=n)]
    assert np.exp(lm_score.marginals(v, words, np.log(v.weight)[:, None])).sum() == pytest.approx(1, abs=0.02)


def test_scores_without_training_rows(spark, documents):
    v = lm_score.Vocabulary(PIECES, 0.001)
    r = lm_score.score(documents([(1, "a a", None)]), v, F.lit(False)).first()
    one = math.log10(plain_lattice("a", dict(zip(PIECES, v.weight)), v.weight[-1])[0] * (1 - lm_score.END))
    assert (r["n_known"], r["train_tokens"], r["base_score"]) == (0, 0, 0.0) and r["score"] == pytest.approx(2 * one + math.log10(lm_score.END), abs=2e-3)
    assert lm_score.score(documents([]), v, F.lit(True)).count() == 0


def test_held_out_texts_score_above_the_base(spark):
    """On the table of 10,000 documents (with a tenth of it, the base, which takes any unseen word for one of equal probability, is 1% above)."""
    import os

    from talkloom.llm import queries

    if not os.path.isdir("/root/testdata/sf0.1"):
        pytest.skip("the test tables are not here")
    r = queries.op2_lm_score(spark, "/root/testdata/sf0.1").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


# -- SimHash


def plain_fingerprint(text):
    import xxhash

    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_near_fingerprints_share_a_key():
    tables = simhash.golay_tables()
    rng = np.random.default_rng(0)
    x = rng.integers(-(2**63), 2**63 - 1, 1500)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for _ in x], np.uint64)
    y = (x.view(np.uint64) ^ flips).view(np.int64)
    sets = []
    for fps, probe in ((x, False), (y, True)):
        keys = [set() for _ in x]
        for r, k in zip(*simhash.key_rows(fps, tables, probe)):
            keys[r].add(k)
        sets.append(keys)
    assert all(a & b for a, b in zip(*sets))


def test_golay_code_is_perfect():
    _, errors = simhash.golay_tables()
    weights = np.bitwise_count(errors)
    assert (weights[:, 0] <= 3).all() and ((weights[:, 1:] == 4) | (errors[:, 1:] == errors[:, :1])).all()


def test_simhash_groups_match_brute_force(spark, documents):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(300)]
    texts = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randrange(20, 400))]
        for _ in range(rng.randrange(1, 5)):
            copy = list(base)
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(len(copy))] = "edit"
            texts.append(" ".join(copy))
    texts += ["", None, "   ", "one", "ONE", "one two", "one two three", "é É", "word " * 30000]
    rows = [(1000 - i, t, None) for i, t in enumerate(texts)] + [(None, "", None), (None, "lonely text that none has", None), (5, texts[0], None), (5, texts[0], None)]
    fps = [plain_fingerprint(t) for _, t, _ in rows]
    linked = [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3]
    root = least_reachable(range(len(rows)), linked)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[root[k]] = min(least.get(root[k], i), i)
    expected = sorted((-1 if i is None else i, f"{fps[k]:016x}", least.get(root[k], -1)) for k, (i, _, _) in enumerate(rows))
    got = simhash.near_duplicates(documents(rows)).collect()
    assert sorted((-1 if r[0] is None else r[0], r[1], -1 if r[2] is None else r[2]) for r in got) == expected
    assert simhash.near_duplicates(documents([])).count() == 0


# -- product quantisation


def test_embedding_links_match_brute_force(spark):
    rng = np.random.default_rng(3)
    rows, dim = [], 16
    for c in range(40):
        centre = rng.normal(size=dim)
        for _ in range(int(rng.integers(1, 12))):
            rows.append(((centre + rng.normal(size=dim) * 0.12).astype(np.float32).tolist(), int(rng.integers(0, 3))))
    rows += [((centre[:8] + rng.normal(size=8) * 0.05).tolist(), int(k % 2)) for k in range(12)] + [([1.0, 0.0], 1), ([1.0, -0.0], 1), ([2.0, 0.0], 1), ([1.0, 0.5], 1), ([5.0], 0)]
    rows += [(rows[0][0], rows[0][1])] * 30 + [(rows[1][0], None), (None, 1), ([0.0] * dim, 1), ([math.nan] + [1.0] * (dim - 1), 1), ([None] + [1.0] * (dim - 1), 1), ([math.inf] * dim, 1), ([1.0] * 3, 1), ([], 1)]
    ids = rng.permutation(len(rows)).tolist()
    table = spark.createDataFrame([(i, v, lab, "x") for i, (v, lab) in zip(ids, rows)], "vec_id long, embedding array<float>, label int, n_links string")
    ok = [v is not None and len(v) > 0 and lab is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for v, lab in rows]
    unit = [np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) if good else None for (v, _), good in zip(rows, ok)]
    linked = [(a, b) for a in range(len(rows)) for b in range(a) if ok[a] and ok[b] and len(unit[a]) == len(unit[b]) and rows[a][1] == rows[b][1] and unit[a] @ unit[b] >= 0.93]
    degree = Counter(x for e in linked for x in e)
    root = least_reachable(ids, [(ids[a], ids[b]) for a, b in linked])
    expected = sorted((i, degree[k], root[i], root[i] == i) for k, i in enumerate(ids))
    for block in (2048, 3):
        assert sorted(tuple(r) for r in pq.near_duplicates(table, block=block).collect()) == expected
    assert pq.near_duplicates(table.limit(0)).count() == 0


@pytest.mark.parametrize("rank, second", [(64, False), (6, False), (64, True)])
def test_recall_with_many_cells(monkeypatch, rank, second):
    """The share of links whose cells are searched, by brute force; vectors of low rank among them."""
    rng = np.random.default_rng(rank)
    base = rng.normal(size=(3000, rank)) @ rng.normal(size=(rank, 64))
    near = base[:1500] + rng.normal(size=(1500, rank)) @ rng.normal(size=(rank, 64)) * 0.3
    x = pq.unit(np.concatenate([base, near]))
    if second:
        monkeypatch.setattr(pq, "FIRST", 12)
    index = pq.Index(x[rng.permutation(len(x))[:4000]], 240, 0.93)
    assert len(index.first) * len(index.second) >= 240
    home, _, error, search = index.encode(x)
    assert all(h in s for h, s in zip(home, search))
    i, j = np.nonzero(x @ x.T >= 0.93)
    i, j = i[i < j], j[i < j]
    found = sum(home[b] in search[a] or home[a] in search[b] for a, b in zip(i.tolist(), j.tolist()))
    assert len(i) > 100 and found >= 0.97 * len(i)
    assert np.mean([len(s) for s in search]) < 200  # and not by searching everything


# -- the pipeline


def test_pipeline_matches_its_stages_by_brute_force(spark, tmp_path, documents):
    import public_tokenizers
    import tiktoken

    import corpus_pipeline
    from talkloom.llm.bpe import load_ranks

    rng = random.Random(11)
    syllables = {"aa": ["ka", "lo", "mi", "ta", "re"], "bb": ["ß", "sch", "ei", "un", "gd"]}
    word = lambda lang: "".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 6)))
    prose = lambda lang, n: " ".join(word(lang) for _ in range(n))
    passage, item = prose("aa", 60), prose("aa", 30)
    texts = [(prose(lang, rng.randrange(30, 200)), lang) for lang in ["aa", "bb"] * 30]
    texts[10] = texts[4]  # an exact copy
    base = prose("aa", 150).split()
    texts[6] = (" ".join(base), "aa")
    texts[14] = (" ".join("kalo" if k in (20, 70, 120) else w for k, w in enumerate(base)), "aa")  # a near copy, alike by 0.8 or more
    assert (plain_fingerprint(texts[6][0]) ^ plain_fingerprint(texts[14][0])).bit_count() > 3
    texts[12] = (passage + " " + prose("aa", 50), "aa")
    texts[20] = (prose("aa", 50) + " " + passage, "aa")
    texts[22] = (prose("aa", 40) + " " + item + " " + prose("aa", 40), "aa")
    texts += [("12 34", "aa"), (None, None), ("", "bb")]
    docs = documents([(i, t, lang) for i, (t, lang) in enumerate(texts)])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    alive = [(i, t) for i, (t, _) in enumerate(texts) if t and any(map(str.isalpha, t))]
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in alive for w in [t.encode().lower().split()]}
    root = least_reachable(sets, [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9])
    alive = [(i, t) for i, t in alive if root[i] == i]
    left = [(r[0], r[5].decode("utf-8", "ignore")) for r in cut(alive, 50)]
    left = [(i, t) for i, t in left if t.strip() and item not in t]
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    assert {i: library.encode_ordinary(t) for i, t in left} == {i: r["token_ids"] for i, r in got.items()}
    assert 10 not in got and 14 not in got and 22 not in got and 20 in got
    staged = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        staged = stage(spark, staged, str(tmp_path))
        assert staged.columns == docs.columns, name
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.count() == 0 and empty.columns == docs.columns, name


# -- near copies


def test_near_copies_match_brute_force(spark, documents):
    from talkloom.llm import near_copies

    rng = random.Random(12)
    words = [f"w{k}" for k in range(400)]
    footer = " ".join(rng.choice(words) for _ in range(25))
    texts = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randrange(20, 300))]
        for _ in range(rng.randrange(1, 6)):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 30)):
                copy[rng.randrange(len(copy))] = "edit"
            texts.append(" ".join(copy) + (" " + footer if rng.random() < 0.3 else ""))
    texts += ["", None, "   ", "one", "ONE", "one two", "a b c d e", "A b  c\td e", "a b c d e f", "é É", "word " * 3000]
    ids = rng.sample(range(1000), len(texts))
    rows = [(i, t, None) for i, t in zip(ids, texts)] + [(None, texts[0], None), (None, "lonely text that none else has", None), (ids[3], texts[3], None)]

    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for _, t, _ in rows]
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b) - 1e-9
    linked = [(a, b) for a in range(len(rows)) for b in range(a) if alike(sets[a], sets[b])]
    far = sum((plain_fingerprint(rows[a][1]) ^ plain_fingerprint(rows[b][1])).bit_count() > 3 for a, b in linked)
    assert far > 10  # pairs that op4's fingerprints don't link
    root = least_reachable(range(len(rows)), linked)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[root[k]] = min(least.get(root[k], i), i)
    expected = sorted((-1 if i is None else i, least.get(root[k], -1)) for k, (i, _, _) in enumerate(rows))
    got = near_copies.near_duplicates(documents(rows).repartition(3)).collect()
    assert sorted((-1 if r[0] is None else r[0], -1 if r[1] is None else r[1]) for r in got) == expected
    assert near_copies.near_duplicates(documents([])).count() == 0


def test_tally_keeps_the_commonest():
    from talkloom.llm import near_copies

    rng = np.random.default_rng(4)
    stream = np.concatenate([rng.integers(1 << 40, 1 << 41, 30_000), np.repeat(np.arange(20), 2_000)]).astype(np.uint64)
    rng.shuffle(stream)
    small, whole = near_copies.Tally(512), near_copies.Tally(1 << 20)
    for part in np.array_split(stream, 300):
        small.add(part)
        whole.add(part)
    small.merge()
    whole.merge()
    exact = Counter(stream.tolist())
    assert dict(zip(whole.keys.tolist(), whole.counts.tolist())) == exact
    got = dict(zip(small.keys.tolist(), small.counts.tolist()))
    assert len(got) <= 512 and all(0 <= exact[k] - n <= len(stream) / 512 for k, n in got.items())
    assert all(k in got for k in range(20))
    empty = near_copies.Tally()
    empty.merge()
    assert not len(empty.keys)


def test_common_shingles_are_told_up_to_the_bound(spark, documents, monkeypatch):
    from talkloom.llm import near_copies

    docs = documents([(k, "a b c d e" if k < 6 else "f g h i j" if k < 9 else f"{k} x y z w", None) for k in range(12)]).repartition(4)
    assert near_copies.common_shingles(docs, "text", 5)[1].tolist() in ([6, 3], [3, 6])
    monkeypatch.setattr(near_copies, "MOST_COMMON", 1)
    assert near_copies.common_shingles(docs, "text", 5)[1].tolist() == [6]
    monkeypatch.setattr(near_copies, "MOST_COMMON", 0)
    assert not len(near_copies.common_shingles(docs, "text", 5)[1])


def test_language_stage_without_labels_keeps_what_has_letters(spark, documents):
    import corpus_pipeline

    docs = documents([(1, "some words", None), (2, "12 34", None), (3, None, None)])
    assert [r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, "").collect()] == [1]


def test_pipeline_stage_drops_near_copies(spark, documents):
    import corpus_pipeline

    rng = random.Random(13)
    base = [f"w{rng.randrange(500)}" for _ in range(100)]
    copy = base[:40] + ["x", "y"] + base[42:]
    docs = documents([(1, " ".join(base), None), (2, " ".join(copy), None), (3, " ".join(reversed(base)), None)])
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 3]


def test_fingerprint_pairs_grow_with_the_texts_not_with_their_pairs(spark, documents):
    from talkloom.llm import near_copies

    rng = random.Random(14)
    base = [f"w{rng.randrange(900)}" for _ in range(2000)]
    texts = [" ".join(base[:k] + ["edit"] + base[k:]) for k in range(0, 2000, 50)]
    rows = near_copies.shingled(documents([(i, t, None) for i, t in enumerate(texts)]), "doc_id", "text", 5, 0.8)
    nodes = {r["node"] for r in rows.collect()}
    pairs = [tuple(r) for r in near_copies.fingerprint_pairs(rows).collect()]
    assert len(nodes) == 40 and 10 < len(pairs) < 40 and len(set(pairs)) == len(pairs)
    assert all(a < b and {a, b} <= nodes for a, b in pairs)
    assert near_copies.fingerprint_pairs(rows.limit(0)).count() == 0


def test_pipeline_tells_rows_apart_by_id_and_text(spark, tmp_path, documents):
    import corpus_pipeline

    rng = random.Random(15)
    prose = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    item, base, other = prose(30), prose(100), prose(60)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    near = " ".join(base.split()[:50] + ["x"] + base.split()[50:])
    docs = documents([(1, base, None), (5, near, None), (5, prose(50), None), (None, near, None), (None, other, None), (None, other + " end", None), (7, None, None), (8, "", None)])
    got = corpus_pipeline.near_dedup(spark, docs, str(tmp_path))
    assert sorted(((r["doc_id"], r["text"] if r["doc_id"] != 7 else None) for r in got.where("doc_id is not null").collect()))[0] == (1, base)
    assert sorted(r["doc_id"] for r in got.where("doc_id is not null").collect()) == [1, 5, 7]
    assert [r["text"] in (other, other + " end") for r in got.where("doc_id is null").collect()] == [True] and got.columns == docs.columns
    held = f"{prose(20)} {item} {prose(20)}"
    docs = documents([(3, held, None), (3, other, None), (None, held, None), (None, base, None), (None, None, None), (4, None, None)])
    got = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got.collect()) == sorted([(3, other), (0, base), (0, ""), (4, "")]) and got.columns == docs.columns


def test_language_is_learned_from_the_first_letter_on(spark, documents):
    from talkloom.llm import langid

    docs = documents([(k, "1" * 10_050 + f" ein wort {k}", "de") for k in range(30)] + [(100 + k, f"some word {k}", "en") for k in range(30)])
    assert langid.train(docs, F.lit(True)).languages == ["de", "en"]
