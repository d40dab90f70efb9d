"""What op2's mixture is fitted to: every training text, whole, however the table is dealt."""

import random

import numpy as np
from pyspark.sql import functions as F

from talkloom.llm import lm_score


def _texts(n):
    rng = random.Random(31)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(2, 8)))
    return [" ".join(word(("abcde", "uvwxyz", "klmnop")[i % 3]) for _ in range(rng.randrange(3, 90))) for i in range(n)]


def test_mixture_takes_all_texts_whole(spark):
    texts = [*_texts(2300), "q" * 30_000 + "#!" * 70_000, "", "a"]
    df = spark.createDataFrame([(t,) for t in texts + texts[:50]], "t string").repartition(5)
    df = df.select(F.encode("t", "UTF-8").alias("t"), F.xxhash64("t").alias("h"))
    got = lm_score.fit_kinds_of(df, 4)
    order = [bytes(r["t"]) for r in df.dropDuplicates(["h"]).orderBy("h").collect()]
    told = lm_score.fit_kinds(order, 4)
    assert np.allclose(got.table, told.table, atol=1e-5) and np.allclose(got.share, told.share)
    assert np.exp(got.share).sum().round(6) == 1
    pair = ord("#") << 8 | ord("!")  # beyond the text's first 20,000 bytes
    assert got.table[pair].max() > np.log(0.1)


def test_all_rounds_take_all_words():
    assert set(lm_score.PARTS) == {1}
