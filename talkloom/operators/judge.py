"""Judgements that a model makes, as columns: contracts, defaults, and the order in which a turn needs them.

A model is a function respond(kind, inputs): kind names the judgement, inputs is a column of JSON text
with what it is made from, and the result is a column of raw response text, null where the call failed. It
may be an expression, or a pandas UDF that calls a service in batches. All else is here, and the same
for every model: what a response that is broken, fenced or of the wrong type means.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.functions import text as X
from talkloom.operators.profiles import activated, contract, flag
from talkloom.sources.stores import LAYERS, layer_merge

#: Fixed value: what is said when no reply could be made.
APOLOGY = "抱歉，当前无法生成回复，请稍后再试~"
Respond = Callable[[str, Column], Column]


def _inputs(**columns: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in columns.items()]), {"ignoreNullFields": "false"})


def _merged(old: Column, new: Column) -> Column:
    """A profile document with the layers that a response has in the place of the old ones."""
    return F.to_json(F.struct(*layer_merge(old, X.json_text(new))), {"ignoreNullFields": "false"})


class Model:
    """Every kind of judgement, by its contract, with its default when the response doesn't tell."""

    def __init__(self, respond: Respond):
        self.respond = respond

    def column(self, df: DataFrame, name: str, judged: Callable[[Model], Column]) -> DataFrame:
        """df with a judgement of this model as a column. What is to be judged are the rows of df, no more."""
        return df.withColumn(name, judged(self))

    def topic_changed(self, history: Column, dialog: Column) -> Column:
        return flag(self.respond("topic_boundary", _inputs(history=history, dialog=dialog)), "topic_boundary", "topic_changed")

    def is_noise(self, dialog: Column, topic: Column) -> Column:
        return flag(self.respond("noise", _inputs(dialog=dialog, topic=topic)), "noise", "is_noise")

    def is_worthy(self, record: Column, user: Column, own: Column) -> Column:
        return flag(self.respond("worthiness", _inputs(record=record, user=user, own=own)), "worthiness", "is_worthy")

    def first_topic(self, dialog: Column) -> Column:
        """A topic's name from its first round; by default the round's beginning."""
        told = contract(self.respond("topic_init", _inputs(dialog=dialog)), "topic_init")["topic"]
        return F.coalesce(X.strip(told), X.topic_from_round(dialog))

    def topic_summary(self, rounds: Column, topic: Column) -> Column:
        """By default the name the topic had, or that of topics without one."""
        told = contract(self.respond("topic_summary", _inputs(rounds=rounds)), "topic_summary")["topic"]
        return F.coalesce(X.strip(told), X.not_empty(topic), F.lit(X.UNNAMED_TOPIC))

    def content_summary(self, rounds: Column) -> Column:
        """By default the last three rounds."""
        told = contract(self.respond("content_summary", _inputs(rounds=rounds)), "content_summary")["content"]
        return F.coalesce(X.strip(told), X.last_rounds(rounds))

    def keywords(self, rounds: Column) -> Column:
        return X.keywords_of(self.respond("keywords", _inputs(rounds=rounds)))

    def activate_user(self, user: Column, message: Column, records: Column) -> Column:
        """The user's profile for this message: layers of the response replace the profile's; a broken one changes nothing."""
        return _merged(user, self.respond("user_activation", _inputs(user=user, message=message, records=records)))

    def activate_own(self, own: Column, message: Column, records: Column, trust: Column) -> Column:
        """The part of the agent's profile that trust and message call for, or the whole one when the response has none."""
        told = X.trust_attitude(trust)
        return activated(own, self.respond("own_activation", _inputs(own=own, message=message, records=records, trust=trust, stage=told["stage"], attitude=told["attitude"])))

    def update_user(self, user: Column, records: Column) -> Column:
        return _merged(user, self.respond("user_update", _inputs(user=user, records=records)))

    def update_own(self, own: Column, user: Column, records: Column) -> Column:
        """Judged after the user's profile, which it sees as updated."""
        return _merged(own, self.respond("own_update", _inputs(own=own, user=user, records=records)))

    def analyse_user(self, user: Column, message: Column, records: Column) -> Column:
        """Struct of past (the profile), present and future; texts that the response doesn't have are empty."""
        return self._analysis("user_analysis", user, _inputs(past=user, message=message, records=records))

    def analyse_own(self, own: Column, profile: Column, message: Column) -> Column:
        """As above for the agent, judged after the user's analysis, which it sees."""
        return self._analysis("persona_analysis", own, _inputs(past=own, profile=F.to_json(profile), message=message))

    def _analysis(self, kind: str, past: Column, inputs: Column) -> Column:
        told = contract(self.respond(kind, inputs), kind)
        fields = {"user_analysis": (("emotion", "intent", "context"), ("prediction", "risk", "basis")), "persona_analysis": (("empathy", "emotion_state"), ("action", "style"))}[kind]
        part = lambda name, names: F.struct(*[X.text_or_empty(told[name][n]).alias(n) for n in names]).alias(name)
        return F.struct(past.alias("past"), part("present", fields[0]), part("future", fields[1]))

    def score(self, message: Column, stage: Column) -> Column:
        """The change of trust a message brings; null where the response's number is none, and trust stays."""
        return X.parse_score(self.respond("score", _inputs(message=message, stage=stage)))

    def reply(self, **inputs: Column) -> Column:
        """The reply as it comes, in chunks that end after a space or a line; an apology when the call failed."""
        told = self.respond("reply", _inputs(**inputs))
        chunks = F.filter(F.split(told, r"(?<=\s)"), lambda c: c != "")
        return F.when(told.isNull(), F.array(F.lit(APOLOGY))).otherwise(chunks)


def judge_turns(turns: DataFrame, model: Model) -> DataFrame:
    """One turn of each row: the two profiles are activated, the user is analysed and then the agent, the reply is
    made of all that, and trust is scored after it.

    turns: message, user and own (profile documents, JSON text), records (JSON text of what was retrieved) and trust;
    further columns are kept. Adds user_active, own_active, profile, persona, chunks, stage, change and trust_after.
    """
    c = F.col
    return (
        turns.withColumn("user_active", model.activate_user(c("user"), c("message"), c("records")))
        .withColumn("own_active", model.activate_own(c("own"), c("message"), c("records"), c("trust")))
        .withColumn("profile", model.analyse_user(c("user_active"), c("message"), c("records")))
        .withColumn("persona", model.analyse_own(c("own"), c("profile"), c("message")))
        .withColumn("chunks", model.reply(message=c("message"), user=c("user_active"), own=c("own_active"), profile=F.to_json("profile"), persona=F.to_json("persona"), records=c("records")))
        .withColumn("stage", X.trust_stage(c("trust")))
        .withColumn("change", model.score(c("message"), c("stage")))
        .withColumn("trust_after", F.when(c("change").isNull(), c("trust")).otherwise(X.clamp(c("trust") + c("change"))))
    )


def worthy_records(records: DataFrame, model: Model, user: Column, own: Column) -> DataFrame:
    """The records that are worth keeping, judged one by one from all their fields and both profiles (JSON text). Where a response doesn't tell, a record is kept."""
    fields = F.to_json(F.struct(*records.columns), {"ignoreNullFields": "false"})
    judged = model.column(records, "_worthy", lambda m: m.is_worthy(fields, user, own))
    return judged.where("_worthy").select(*records.columns)


def update_profiles(profiles: DataFrame, records: DataFrame, model: Model) -> DataFrame:
    """id, user and own after an update from all of an id's records; without records nothing changes, and no call is made.

    profiles: id, user, own. records: id, seq and any other columns. The agent's update sees the user's.
    """
    others = [c for c in records.columns if c not in ("id", "seq")]
    lists = records.groupBy("id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("seq", *others)))).alias("_records"))
    # in two parts: a condition in an expression doesn't hold back a call
    seen = profiles.select("id", "user", "own").join(lists, "id")
    seen = model.column(seen, "_user", lambda m: m.update_user(F.col("user"), F.col("_records")))
    seen = model.column(seen, "_own", lambda m: m.update_own(F.col("own"), F.col("_user"), F.col("_records")))
    unseen = profiles.join(lists.select("id"), "id", "left_anti")
    return seen.select("id", F.col("_user").alias("user"), F.col("_own").alias("own")).unionByName(unseen.select("id", "user", "own"))
