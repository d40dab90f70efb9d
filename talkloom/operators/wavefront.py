"""Topics by a model that sees the open topic, for all conversations at once.

Whether a round opens a topic depends on the rounds that the open topic has so far, which depend on the judgements before. So
conversations go forward in step: wave k judges the k-th round of every conversation that has one, as one
batch, with the state that wave k-1 has left (the open topic's rounds, its name and number). A wave makes one call for each
round, a second for a round that changes the topic (is it noise?), a third for one that opens a topic (its name).

A wave's state is written to a folder and read by the next; conversations that have ended drop out of it. A run that broke off is taken up
at the first wave that isn't complete. Shuffles carry a conversation's state, never more; waves are as many
as the longest conversation has rounds.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkloom.operators.judge import Model
from talkloom.sources.scratch import shared_dir, written
from talkloom.sources.stores import _exists

STATE = ["conv_id", "round_no", "topic_changed", "is_noise", "boundary", "dropped", "topic_no", "analysis_topic", "open_topic", "history"]
BETWEEN = "\n\n"


def _complete(spark, path: str) -> bool:
    return _exists(spark, f"{path}/_SUCCESS")


def _after(judged: DataFrame, changed, noise, boundary: bool, topic_no: Column, topic: Column, history: Column) -> DataFrame:
    """State after a wave, of the rounds that went one way."""
    dropped = changed and noise
    flags = [F.lit(x).alias(n) for n, x in (("topic_changed", changed), ("is_noise", noise), ("boundary", boundary), ("dropped", dropped))]
    return judged.select("conv_id", "round_no", *flags, topic_no.cast("int").alias("topic_no"), F.col("before").cast("int").alias("analysis_topic"), topic.alias("open_topic"), history.alias("history"))


def _wave(judged: DataFrame, model: Model) -> DataFrame:
    """The state after a wave. judged: conv_id, round_no, round_dialog, before (the open topic's number), topic and history (its rounds)."""
    c = F.col
    asked = model.column(judged, "changed", lambda m: m.topic_changed(F.array_join("history", BETWEEN), c("round_dialog")))
    asked = written(asked, "wave-changed")
    same = asked.where(~c("changed"))
    other = model.column(asked.where("changed"), "noise", lambda m: m.is_noise(c("round_dialog"), c("topic")))
    other = written(other, "wave-noise")
    opening = model.column(other.where(~c("noise")).drop("topic"), "topic", lambda m: m.first_topic(c("round_dialog")))
    return (
        _after(same, False, False, False, c("before"), c("topic"), F.concat("history", F.array("round_dialog")))
        .unionByName(_after(other.where("noise"), True, True, False, c("before"), c("topic"), c("history")))
        .unionByName(_after(opening, True, False, True, c("before") + 1, c("topic"), F.array("round_dialog")))
    )


def segment_with(rounds: DataFrame, model: Model, folder: str | None = None) -> DataFrame:
    """rounds (conv_id, round_no, round_dialog and any others) with topic_changed, is_noise, boundary, dropped, topic_no, analysis_topic,
    as rounds.segment has them, and open_topic, the name of the topic that is open after the round.

    The first round of a conversation opens its first topic and is not judged; is_noise is false where it wasn't asked for. Rounds with
    a null conv_id are one conversation; a null round_dialog is empty. folder: where waves are kept and, after a
    run that broke off, found; by default a new one.
    """
    spark = rounds.sparkSession
    at = (folder or f"{shared_dir(spark)}/talkloom-waves-{uuid.uuid4().hex}").rstrip("/")
    if not _complete(spark, f"{at}/rounds"):
        wave = F.row_number().over(Window.partitionBy("conv_id").orderBy("round_no"))
        dealt = rounds.select("conv_id", "round_no", F.coalesce("round_dialog", F.lit("")).alias("round_dialog"), wave.alias("wave"))
        # by wave, so that a wave reads its own rows
        dealt.repartitionByRange("wave", "conv_id").sortWithinPartitions("wave").write.mode("overwrite").parquet(f"{at}/rounds")
    dealt = spark.read.parquet(f"{at}/rounds")
    last = dealt.agg(F.max("wave")).first()[0] or 0
    for k in range(1, last + 1):
        path = f"{at}/waves/wave={k}"
        if _complete(spark, path):
            continue
        now = dealt.where(F.col("wave") == k).drop("wave")
        if k == 1:
            named = model.column(now.withColumn("before", F.lit(0)), "topic", lambda m: m.first_topic(F.col("round_dialog")))
            state = _after(named, False, False, False, F.col("before"), F.col("topic"), F.array("round_dialog"))
        else:
            held = spark.read.parquet(f"{at}/waves/wave={k - 1}").select(F.col("conv_id").alias("_conv"), F.col("topic_no").alias("before"), F.col("open_topic").alias("topic"), "history")
            state = _wave(now.join(held, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv"), model)
        state.write.mode("overwrite").parquet(path)
    new = STATE[2:-1]
    plain = rounds.select(*[c for c in rounds.columns if c not in new])
    if not last:
        kinds = dict(zip(new, ["boolean"] * 4 + ["int"] * 2 + ["string"]))
        return plain.select("*", *[F.lit(None).cast(kinds[c]).alias(c) for c in new])
    told = spark.read.parquet(*[f"{at}/waves/wave={k}" for k in range(1, last + 1)]).select(F.col("conv_id").alias("_conv"), F.col("round_no").alias("_round"), *new)
    return plain.join(told, F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("round_no").eqNullSafe(F.col("_round"))).drop("_conv", "_round")
