"""Dialogue rounds, topic segmentation and the records of topics.

All state is keyed by conversation. The model's judgements (has the topic changed, is this noise,
what does it suggest) are columns, which a provider fills; here they only have to be there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkloom.functions import text as X

ANALYSES = ("user_prediction", "user_risk", "agent_empathy", "agent_action")


def pair_rounds(conversations: DataFrame) -> DataFrame:
    """conv_id, round_no, user_text, agent_text, round_dialog: each user turn that an assistant's turn
    follows. System turns are passed over; a turn without a reply makes no round."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    said = conversations.where(F.col("role") != "system").select(
        "conv_id", "turn", "role", "text", F.lead("role").over(order).alias("reply_role"), F.lead("text").over(order).alias("agent_text")
    )
    paired = said.where((F.col("role") == "user") & (F.col("reply_role") == "assistant"))
    return paired.select(
        "conv_id",
        F.row_number().over(order).alias("round_no"),
        F.col("text").alias("user_text"),
        "agent_text",
        X.round_dialog(F.col("text"), F.col("agent_text")).alias("round_dialog"),
    )


def after_silence(idle: str = "30 minutes", ts: str = "ts") -> Column:
    """Whether a round comes after a silence longer than idle: the conversation before it was over."""
    last = F.max(ts).over(Window.partitionBy("conv_id").orderBy("round_no").rowsBetween(Window.unboundedPreceding, -1))
    return F.coalesce(F.col(ts) - last > F.expr(f"INTERVAL {idle}"), F.lit(False))


def segment(rounds: DataFrame, changed: Column, noise: Column, opens: Column | None = None) -> DataFrame:
    """Adds boundary, dropped, topic_no and analysis_topic.

    A changed round that isn't noise opens the next topic; one that is noise is dropped; both only
    from the second round on. analysis_topic is the topic open before the round was judged: to it
    the round's analyses count, even when the round opens the next topic or is dropped.
    A flag that is null counts as false. A round for which opens holds (see after_silence) begins anew, as the first one does: it
    isn't judged, opens the next topic, and its analyses are that topic's.
    """
    fresh = F.coalesce(opens, F.lit(False)) if opens is not None else F.lit(False)
    changed, noise = F.coalesce(changed, F.lit(False)), F.coalesce(noise, F.lit(False))
    order = Window.partitionBy("conv_id").orderBy("round_no")
    later = F.col("round_no") > 1
    b = F.col("boundary").cast("int")
    before = F.coalesce(F.sum(b).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    topic = F.sum(b).over(order.rowsBetween(Window.unboundedPreceding, 0))
    if opens is None:
        return (
            rounds.withColumns({"boundary": later & changed & ~noise, "dropped": later & changed & noise})
            .withColumn("topic_no", topic.cast("int"))
            .withColumn("analysis_topic", before.cast("int"))
        )
    told = rounds.withColumn("_fresh", later & fresh)
    told = told.withColumns({"boundary": F.col("_fresh") | (later & changed & ~noise), "dropped": later & ~F.col("_fresh") & changed & noise})
    told = told.withColumn("topic_no", topic.cast("int")).withColumn("analysis_topic", before.cast("int"))
    return told.withColumn("analysis_topic", F.when(F.col("_fresh"), F.col("topic_no")).otherwise(F.col("analysis_topic"))).drop("_fresh")


def _in_order(value: Column) -> Column:
    """A group's values in the order of their rounds."""
    return F.transform(F.array_sort(F.collect_list(F.struct("round_no", value.alias("v")))), lambda x: x["v"])


def accumulate(segmented: DataFrame, own_topic: bool = False) -> DataFrame:
    """conv_id, topic_no and the four analyses, each the distinct non-empty texts in order.

    By default analyses count to the topic that was open before the round was judged; with
    own_topic to the topic the round belongs to (dropped rounds: the open one).
    """
    topic = "topic_no" if own_topic else "analysis_topic"
    lists = [X.ordered_distinct(_in_order(F.col(a))).alias(a) for a in ANALYSES]
    return segmented.groupBy("conv_id", F.col(topic).alias("topic_no")).agg(*lists)


def build_records(segmented: DataFrame, own_topic: bool = False, emit_open: bool = True, model=None) -> DataFrame:
    """A topic record for each topic: conv_id, topic_no, is_open, n_rounds, topic, content, analyses.

    Topic and content are the fallbacks that need no model; with a model (see judge.Model) they are its
    summaries, and keywords come with them; where the rounds have open_topic (see wavefront), that is the name the topic had. The last topic of a conversation is
    still open; without emit_open it makes no record.
    """
    # a round has a part in its own topic, and its analyses one in the topic that was open, which is mostly the same: one grouping for both
    own, open_ = F.col("topic_no"), F.col("topic_no" if own_topic else "analysis_topic")
    named = "open_topic" in segmented.columns
    said = F.when(~F.col("dropped"), F.struct("round_no", F.col("round_dialog").alias("v"), *(["open_topic"] if named else [])))
    gives = F.struct(*ANALYSES)
    part = lambda topic, round_, analyses: F.struct(topic.alias("topic_no"), round_.alias("said"), analyses.alias("gives"))
    none = F.lit(None)
    parts = F.when(own == open_, F.array(part(own, said, gives))).otherwise(F.array(part(own, said, none), part(open_, none, gives)))
    each = segmented.select("conv_id", "round_no", F.explode(parts).alias("p")).select("conv_id", "round_no", "p.*")
    told = each.groupBy("conv_id", "topic_no").agg(
        F.array_sort(F.collect_list("said")).alias("said"), *[X.ordered_distinct(_in_order(F.col(f"gives.{a}"))).alias(a) for a in ANALYSES]
    )
    told = told.where(F.size("said") > 0).withColumn("rounds", F.transform("said", lambda r: r["v"]))
    told = told.withColumn("name", F.element_at("said", 1)["open_topic"]) if named else told
    told = told.withColumn("is_open", F.col("topic_no") == F.max("topic_no").over(Window.partitionBy("conv_id")))
    if not emit_open:
        told = told.where(~F.col("is_open"))
    rounds, first = F.col("rounds"), F.element_at("rounds", 1)
    if model is None:
        summaries = [X.topic_from_round(first).alias("topic"), X.last_rounds(rounds).alias("content")]
    else:
        told = told if named else model.column(told, "name", lambda m: m.first_topic(first))
        told = model.column(told, "_topic", lambda m: m.topic_summary(rounds, F.col("name")))
        told = model.column(told, "_content", lambda m: m.content_summary(rounds))
        told = model.column(told, "keywords", lambda m: m.keywords(rounds))
        summaries = [F.col("_topic").alias("topic"), F.col("_content").alias("content"), "keywords"]
    return told.select(
        "conv_id",
        "topic_no",
        "is_open",
        F.size("rounds").alias("n_rounds"),
        *summaries,
        *[X.text_or_empty(F.col(a)).alias(a) for a in ANALYSES],
    )


def top_terms(texts: DataFrame, keys: list[str], text: str, n: int = 5, least: int = 4) -> DataFrame:
    """keys and keywords: the n most frequent words of at least that many letters, ties by the word. Texts without such a word have no row.

    All of a row's words lie in the row: they are counted there, an Arrow batch at a time, and nothing is shuffled.
    """
    words = F.filter(F.split(F.lower(X.text_or_empty(F.col(text))), X.NO_WORD), lambda w: F.length(w) >= max(least, 1))
    listed = texts.select(*keys, words.alias("_words"))
    schema = T.StructType([*listed.schema.fields[:-1], T.StructField("keywords", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(keys))
            coded = lists.flatten().dictionary_encode()
            if not len(coded):
                continue
            order = pc.sort_indices(coded.dictionary).to_numpy()
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            pairs, counts = np.unique(row * len(order) + rank[coded.indices.to_numpy(zero_copy_only=False)], return_counts=True)
            row, word = np.divmod(pairs, len(order))
            by = np.lexsort((word, -counts, row))
            row, word = row[by], word[by]
            heads = np.flatnonzero(np.concatenate([[True], np.diff(row) != 0]))
            sizes = np.diff(np.append(heads, len(row)))
            top = np.arange(len(row)) - np.repeat(heads, sizes) < n
            terms = coded.dictionary.take(pa.array(order[word[top]]))
            offsets = np.concatenate([[0], np.cumsum(np.minimum(sizes, n))]).astype(np.int32)
            some = pa.array(row[heads])
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(some) for k in range(len(keys))), pa.ListArray.from_arrays(pa.array(offsets), terms)], names=schema.names)

    return listed.mapInArrow(run, schema)
