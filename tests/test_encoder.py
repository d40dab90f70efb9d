"""The encoder against a dense decomposition, and its store of vectors."""

import os
import random

import numpy as np

from talkloom.operators import encoder, retrieve


def texts(seed, n):
    rng = random.Random(seed)
    subjects = [[f"s{s}w{k}" for k in range(40)] for s in range(5)]
    return [(k, " ".join(rng.choices(subjects[k % 5], k=rng.randrange(5, 30)) + rng.choices(["and", "the", "of"], k=6))) for k in range(n)]


def test_directions_are_those_of_the_dense_decomposition(spark):
    rows = [*texts(61, 200), (900, None), (901, ""), (902, "?!")]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    fitted = encoder.fit(df, directions=6, buckets=512, spare=10, steps=4)
    whole = encoder.encode(df, encoder.Encoder(fitted.idf, np.eye(512)))  # the rows themselves
    a = np.array([r["vec"] for r in whole.collect()])
    s = np.linalg.svd(a, compute_uv=False)
    got = np.array([r["vec"] for r in encoder.encode(df, fitted).collect()])
    assert np.allclose(np.linalg.norm(got, axis=0), s[:6], rtol=0.02)
    left = np.linalg.norm(a - a @ fitted.directions @ fitted.directions.T) ** 2
    assert left <= 1.02 * (s[6:] ** 2).sum()
    assert np.allclose(fitted.directions.T @ fitted.directions, np.eye(6), atol=1e-8)


def test_rows_are_multiplied_in_bounded_parts():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    lists = [rng.integers(0, 64, n).tolist() for n in (3, 1, 40, 7, *[1] * 1500)]
    idf, q = rng.random(64) + 1, rng.standard_normal((64, 5))
    whole = np.zeros((len(lists), 64))
    for i, buckets in enumerate(lists):
        whole[i] = np.log1p(np.bincount(buckets, minlength=64)) * idf
        whole[i] /= np.linalg.norm(whole[i])
    parts = list(encoder._rows(pa.array(lists, pa.list_(pa.int32())), idf))
    assert max(n for *_, n in parts) <= 512 and sum(n for *_, n in parts) == len(lists)
    assert np.allclose(np.concatenate([encoder._times(*part, q) for part in parts]), whole @ q)
    used, a = encoder._dense(*parts[0], 64)
    assert np.allclose(a, whole[: len(a), used]) and not np.delete(whole[: len(a)], used, axis=1).any()


def test_what_belongs_together_is_found_without_a_common_word(spark):
    df = spark.createDataFrame(texts(62, 300), "id long, text string")
    fitted = encoder.fit(df, directions=8, buckets=1024)
    # words that talk about one subject, and share no word with most of its records
    queries = spark.createDataFrame([(k, f"s{k}w0 s{k}w1") for k in range(5)], "id long, text string")
    found = retrieve.dense_top_k(encoder.encode(queries, fitted), encoder.encode(df, fitted), k=20).collect()
    assert len(found) == 100 and all(r["record_id"] % 5 == r["query_id"] for r in found)


def test_a_text_is_encoded_once(spark, tmp_path):
    rows = texts(63, 40)
    df = spark.createDataFrame([*rows, (100, rows[0][1]), (101, None), (102, "")], "id long, text string")
    fitted = encoder.fit(df, directions=4, buckets=256)
    store = str(tmp_path / "vectors")
    first = {r["id"]: r["vec"] for r in encoder.encoded(df, fitted, store).collect()}
    assert len(first) == 43 and first[100] == first[0] and first[101] is None and first[102] == [0.0] * 4
    at = f"{store}/model-{fitted.name}"
    assert spark.read.parquet(at).count() == len({t for _, t in rows} | {""})
    files = sorted(os.listdir(at))
    assert {r["id"]: r["vec"] for r in encoder.encoded(df, fitted, store).collect()} == first and sorted(os.listdir(at)) == files  # nothing was encoded
    more = spark.createDataFrame([(1, rows[1][1]), (2, "a text that is new")], "id long, text string")
    encoder.encoded(more, fitted, store).collect()
    assert spark.read.parquet(at).count() == len({t for _, t in rows}) + 2
    encoder.save(spark, fitted, str(tmp_path / "model"))
    again = encoder.load(spark, str(tmp_path / "model"))
    assert again.name == fitted.name and {r["id"]: r["vec"] for r in encoder.encoded(df, again, store).collect()} == first
    assert encoder.encoded(df.limit(0), fitted, str(tmp_path / "none")).count() == 0
    assert encoder.fit(df.limit(0), directions=4, buckets=256).directions.shape == (256, 4)
