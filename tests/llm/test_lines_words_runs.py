"""Line dedup, spelling variants and periodic runs against brute force, and their odd cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkloom.llm import line_dedup, periodic_runs, spelling

# line dedup


def lines_by_hand(docs, least_chars, least_documents):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\f\r"))
    holders = {}
    for i, text in docs:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        gone = [len(k := key(x)) >= least_chars and len(holders[k]) >= least_documents and i != max(x for x in holders[k] if x is not None) for x in lines]
        out.append((i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return out


def dedup_lines(df, **options):
    return [tuple(r) for r in line_dedup.apply(df, line_dedup.keep_bitmaps(df, **options)).select("doc_id", "n_lines", "n_dropped", "kept").collect()]


SORTED = lambda rows: sorted(rows, key=repr)


@pytest.mark.parametrize("options", [{}, {"buckets": 16, "least_hot": 3}], ids=["ranges", "crowded"])
def test_lines_equal_brute_force(spark, documents, options):
    rng = random.Random(11)
    pool = ["", "a", "Same Line", " same line\t", "ÉTÉ à la plage", "été à la plage", "common line", *[f"line {k}" for k in range(30)]]
    docs = [(i, "\n".join(rng.choice(pool[: rng.choice([7, 37])]) for _ in range(rng.randint(0, 12)))) for i in range(80)]
    got = dedup_lines(documents([(i, t, "en") for i, t in docs]), least_chars=4, **options)
    assert SORTED(got) == SORTED(lines_by_hand(docs, 4, 3))


def test_line_cases(spark, documents):
    long = "x" * 200_000
    rows = [
        (1, f"{long}\nA line that many hold\nown", "en"), (2, "  a LINE that many hold \t\n\nown", "en"), (3, "a line that many hold\na line that many hold", "en"),
        (4, None, "en"), (5, "", "en"), (None, "a line that many hold", None), (None, "a line that many hold", None), (2, "other text\na line that many hold", "en"),
        (6, "second line of two docs\r", "en"), (7, "second line of two docs", "en"),
    ]
    got = SORTED(dedup_lines(documents(rows)))
    assert got == SORTED(
        [
            (1, 3, 1, f"{long}\nown"), (2, 3, 1, "\nown"), (2, 2, 1, "other text"), (3, 2, 0, "a line that many hold\na line that many hold"), (4, 1, 0, ""), (5, 1, 0, ""),
            (None, 1, 1, ""), (None, 1, 1, ""), (6, 1, 0, "second line of two docs\r"), (7, 1, 0, "second line of two docs"),
        ]
    )
    assert dedup_lines(documents([])) == []
    bitmaps = line_dedup.keep_bitmaps(documents(rows)).where("doc_id = 1").collect()
    assert [[tuple(x) for x in r["keep"]] for r in bitmaps] == [[(0, 1), (2, 1)]]


def test_line_keys_are_dealt_by_ranges_without_python(spark, documents):
    df = documents([(i, f"a line of more than twenty characters\n{i} and one of its own, as long", "en") for i in range(5)])
    plan = line_dedup.dropped(line_dedup.keys(df))._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(h1" in plan and "hashpartitioning" not in plan and "Python" not in plan


# spelling variants


def near_by_hand(counts):
    def rest(w):
        return {w[:i] + w[i + 1 :] for i in range(len(w))}

    out = {}
    for w in counts:
        near = {v for v in counts if v != w and (len(v) == len(w) and sum(a != b for a, b in zip(v, w)) == 1 or len(v) == len(w) - 1 and v in rest(w) or len(v) == len(w) + 1 and w in rest(v))}
        best = min(near, key=lambda v: (-counts[v], v)) if near else None
        out[w] = (len(near), best)
    return out


def forms_by_hand(counts, ratio):
    near = near_by_hand(counts)
    form = {w: b if b is not None and counts[b] >= ratio * counts[w] else None for w, (_, b) in near.items()}
    root = {}
    for w in counts:
        at = w
        while form[at] is not None:
            at = form[at]
        root[w] = at
    return {w: (form[w], root[w], n, near[w][0], counts[form[w]] if form[w] else None) for w, n in counts.items()}


def variants(spark, counts, **options):
    rows = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"), **options).collect()
    assert len(rows) == len(counts)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


@pytest.mark.parametrize("options", [{}, {"limit": 4, "chunk": 7}], ids=["halves", "dealt again"])
def test_variants_equal_brute_force(spark, options):
    rng = random.Random(12)
    counts = {}
    for letters, most in (("ab", 9), ("aé", 5), ("abcdeü", 4)):
        for _ in range(150):
            w = "".join(rng.choice(letters) for _ in range(rng.randint(2, most)))
            counts[w] = rng.choice([2, 3, 25, 250, 3000])
    assert variants(spark, counts, ratio=10, **options) == forms_by_hand(counts, 10)


def test_variant_cases(spark, documents):
    chain = {"aaaaaaa": 2, "aaaaaab": 20, "aaaaabb": 200, "aaaabbb": 2000, "aaabbbb": 20000}
    assert {w: r[1] for w, r in variants(spark, chain).items()} == dict.fromkeys(chain, "aaabbbb")
    long = "q" * 3000 + "x" + "q" * 3000
    odd = {long: 50, long.replace("x", "y"): 3, long.replace("x", ""): 2, "balloon": 40, "baloon": 4, "ballooon": 3, "alone": 9}
    assert variants(spark, odd) == forms_by_hand(odd, 10)
    assert variants(spark, {}) == {}
    docs = documents([(1, "Straßen Straßen, ÉCOLIERS ecoliers x", "de"), (None, "straßen", None), (2, None, None), (3, "", None), (3, "ÉColiers STRASSE", None)])
    assert {r["word"]: r["n"] for r in spelling.count_words(docs).collect()} == {"straßen": 3, "Écoliers": 2}
    cut = spelling.count_words(docs, lambda i, w: F.when(i == "", F.substring(w, 1, 6)).otherwise(w))
    assert {r["word"]: r["n"] for r in cut.collect()} == {"straßen": 2, "Écoliers": 2}
    assert spelling.count_words(documents([])).count() == 0


def test_wavelet_reports_rectangles():
    rng = np.random.default_rng(3)
    for n in (1, 2, 9, 64):
        values = rng.permutation(n)
        tree = spelling.Wavelet(values)
        box = np.sort(rng.integers(0, n + 1, (50, 4)).reshape(50, 2, 2), axis=2)
        x1, x2, y1, y2 = box[:, 0, 0], box[:, 0, 1], box[:, 1, 0], box[:, 1, 1]
        got = sorted(zip(*[a.tolist() for a in tree.report(x1, x2, y1, y2)]))
        assert got == sorted((q, int(v)) for q in range(50) for v in values[x1[q] : x2[q]] if y1[q] <= v < y2[q])


# periodic runs


def runs_by_hand(w, least_words, least_exponent):
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i - s + q
            if n >= max(least_words, least_exponent * q) and not any(w[s : s + n - p] == w[s + p : s + n] for p in range(1, q)):
                out.append((s, n, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least", [(6, 4), (2, 2)])
def test_runs_equal_brute_force(least):
    rng = random.Random(13)
    for _ in range(400):
        docs = []
        for _ in range(rng.randint(1, 5)):
            n, a = rng.choice([0, 1, 5, 6, 10, 40, 120]), rng.choice([1, 2, 3, 8])
            w = [rng.randrange(a) for _ in range(n)]
            if n and rng.random() < 0.6:
                s = rng.randrange(n)
                p = 1 + (n - s) // rng.randint(3, 10)
                w = [w[i] if i < s else w[s + (i - s) % p] for i in range(n)]
            docs.append(w)
        start, length, period = periodic_runs.find(np.array(sum(docs, []), np.int64), np.repeat(np.arange(len(docs)), [len(w) for w in docs]), *least)
        off = np.cumsum([0, *map(len, docs)])
        want = [(int(off[k]) + s, n, q) for k, w in enumerate(docs) for s, n, q in runs_by_hand(w, *least)]
        assert list(zip(start.tolist(), length.tolist(), period.tolist())) == want


def test_run_cases(spark, documents):
    many = " ".join(f"w{k}" for k in range(3000))
    rows = [
        (1, "a b " * 5 + "c", "en"), (1, "x\ty\nx y x y x y", "en"), (2, None, None), (3, "", None), (4, " \n", None), (None, "z " * 7, None),
        (5, f"{many} " * 4 + "end", "en"), (6, "no run in here", "en"), (7, "r r r r r", "en"),
    ]
    got = {(r["doc_id"], r["collapsed"][:8]): ([tuple(x) for x in r["runs"]], r["n_words"], r["collapsed"], r["lang"]) for r in periodic_runs.collapse(documents(rows), keep=["lang"]).collect()}
    assert len(got) == len(rows)
    assert got[1, "a b c"] == ([(0, 10, 2)], 11, "a b c", "en")
    assert got[1, "x y"] == ([(0, 8, 2)], 8, "x y", "en")
    assert got[2, ""] == got[3, ""] == got[4, ""] == ([], 0, "", None)
    assert got[None, "z"] == ([(0, 7, 1)], 7, "z", None)
    assert got[5, "w0 w1 w2"] == ([(0, 12000, 3000)], 12001, f"{many} end", "en")
    assert got[6, "no run i"][0] == [] and got[7, "r r r r "][0] == []
    assert periodic_runs.collapse(documents([])).count() == 0
    words = documents([(9, "ignored", None)]).select("doc_id", F.array(F.lit(None).cast("string"), *[F.lit(x) for x in "bbbbbb"]).alias("w"))
    assert periodic_runs.collapse(words, F.col("w")).select("n_words", "collapsed").collect() == [(7, " b")]
