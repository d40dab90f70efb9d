"""Summaries without a model: the sentences of a topic that are most like all its others.

A sentence's place is its rank in the graph of its topic's sentences, whose weights are cosines of word counts (with itself 1), by a random walk with
restarts. The graph is never made: with X the unit rows of word counts, W = X X', and a step of the walk is two
aggregations, from sentences to the topic's words and back. All topics go forward at once, each step is a job over the words
of sentences, and its rows are dealt by topic and word, or by topic and sentence, so that a large topic spans many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkloom.functions import text as X
from talkloom.sources.scratch import written

#: What ends a sentence, besides a line: fixed for the queries' SQL.
ENDS = r"[.!?。！？\n]+"
STEPS, DAMPING = 8, 0.85
#: Places at which ranks are compared: the order of summation stays out of it.
PLACES = 9
#: Characters of a topic's summary and of its content, and sentences that content may have.
TOPIC, CONTENT, MOST = 30, 300, 12
KEY = ["conv_id", "topic_no"]


def sentences(segmented: DataFrame) -> DataFrame:
    """conv_id, topic_no, round_no, pos, sentence of the rounds that count in a topic; sentences without a word are left out."""
    said = segmented.where(~F.col("dropped")).select(*KEY, "round_no", F.posexplode(F.split(F.concat_ws("\n", "user_text", "agent_text"), ENDS)).alias("pos", "sentence"))
    return said.withColumn("sentence", X.strip(F.col("sentence"))).where(F.size(X.words(F.col("sentence"))) > 0)


def ranked(said: DataFrame, steps: int = STEPS, damping: float = DAMPING) -> DataFrame:
    """The sentences with rank, their share of the walk after so many steps from an even start; a topic's ranks add up to 1."""
    # a sentence and a topic's word are known by numbers, which are a fraction of their keys when rows are dealt
    said = written(said.withColumn("_s", F.monotonically_increasing_id()), "sentences")
    topic = said.groupBy(*KEY).agg(F.count("*").alias("size"))
    counts = said.select("_s", *KEY, F.explode(X.words(F.col("sentence"))).alias("word")).groupBy("_s", *KEY, "word").agg(F.count("*").cast("double").alias("n"))
    norms = counts.groupBy("_s").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    named = written(counts.join(norms, "_s").select("_s", *KEY, "word", (F.col("n") / F.col("norm")).alias("x")), "sentence-words")
    total = written(named.groupBy(*KEY, "word").agg(F.sum("x").alias("y")).withColumn("_w", F.monotonically_increasing_id()), "topic-words")
    unit = written(named.join(total, [*KEY, "word"]).select("_s", "_w", "x", "y"), "sentence-units")
    degree = unit.groupBy("_s").agg(F.sum(F.col("x") * F.col("y")).alias("degree"))
    unit = unit.select("_s", "_w", "x")
    fixed = written(said.select("_s", *KEY).join(topic, KEY).join(degree, "_s").select("_s", "degree", "size"), "sentence-degrees")
    now = fixed.select("*", (1 / F.col("size")).alias("rank"))
    for _ in range(steps):
        share = now.select("_s", (F.col("rank") / F.col("degree")).alias("share"))
        words = unit.join(share, "_s").groupBy("_w").agg(F.sum(F.col("share") * F.col("x")).alias("y"))
        got = unit.join(words, "_w").groupBy("_s").agg(F.sum(F.col("x") * F.col("y")).alias("got"))
        now = written(fixed.join(got, "_s").select("_s", "degree", "size", ((1 - damping) / F.col("size") + damping * F.col("got")).alias("rank")), "sentence-ranks")
    return said.join(now.select("_s", "rank"), "_s").drop("_s")


def summaries(segmented: DataFrame, steps: int = STEPS, damping: float = DAMPING) -> DataFrame:
    """conv_id, topic_no, topic (the first characters of the highest sentence) and content (the highest sentences that fit, in the order of the talk, a line each).

    segmented: rounds as rounds.segment has them. The highest sentence is always in content, cut where it is too long. Ties go to the earlier sentence. Topics
    of which no sentence has a word have no row: their fallbacks stand (see rounds.build_records).
    """
    best = Window.partitionBy(*KEY).orderBy(F.desc(F.round("rank", PLACES)), "round_no", "pos")
    top = ranked(sentences(segmented), steps, damping).withColumn("k", F.row_number().over(best)).where(F.col("k") <= MOST)
    top = top.withColumn("sentence", F.substring("sentence", 1, CONTENT)).withColumn("used", F.sum(F.char_length("sentence") + 1).over(best) - 1)
    fits = top.where((F.col("k") == 1) | (F.col("used") <= CONTENT))
    lines = F.array_sort(F.collect_list(F.struct("round_no", "pos", "sentence")))
    made = fits.groupBy(*KEY).agg(F.min_by("sentence", "k").alias("first"), lines.alias("lines"))
    return made.select(*KEY, X.strip(F.substring("first", 1, TOPIC)).alias("topic"), F.array_join(F.transform("lines", lambda s: s["sentence"]), "\n").alias("content"))
