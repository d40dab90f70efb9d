"""Providers of judgements. A provider adds columns to rounds; which one is used is a parameter.

The offline provider is deterministic and stands in where no model is reachable: for tests, and as
a default. It makes no claim to a model's quality. A model-backed provider has the same methods.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkloom.functions import text as X

#: Phrases that announce another topic, unless the caller has others.
MARKERS = ("by the way", "on another note", "changing the subject", "something else", "顺便问一下", "聊点别的")


class Provider(Protocol):
    def flags(self, rounds: DataFrame) -> DataFrame:
        """Adds topic_changed and is_noise."""

    def analyses(self, rounds: DataFrame) -> DataFrame:
        """Adds user_prediction, user_risk, agent_empathy and agent_action."""


class Offline:
    """relatedness: below it a round is another topic than the one before; short: a user's text of
    fewer characters is noise when the topic changes."""

    def __init__(self, relatedness: float = 0.3, short: int = 60, markers: tuple[str, ...] = MARKERS):
        self.relatedness, self.short, self.markers = relatedness, short, markers

    def flags(self, rounds: DataFrame) -> DataFrame:
        order = Window.partitionBy("conv_id").orderBy("round_no")
        terms = rounds.withColumn("_t", F.array_distinct(X.words(F.concat_ws(" ", "user_text", "agent_text")))).withColumn("_p", F.lag("_t").over(order))
        common = F.size(F.array_intersect("_t", "_p")) / F.greatest(F.least(F.size("_t"), F.size("_p")), F.lit(1))
        marked = F.lit(False)
        for m in self.markers:
            marked = marked | F.contains(X.text_or_empty(F.col("user_text")), F.lit(m))
        changed = F.col("_p").isNotNull() & (marked | (common < self.relatedness))
        return terms.withColumns({"topic_changed": changed, "is_noise": F.length(X.text_or_empty(F.col("user_text"))) < self.short}).drop("_t", "_p")

    def analyses(self, rounds: DataFrame) -> DataFrame:
        u, a = X.text_or_empty(F.col("user_text")), X.text_or_empty(F.col("agent_text"))
        return rounds.withColumns(
            {
                "user_prediction": X.strip(F.substring(u, 1, 12)),
                "user_risk": F.when(F.length(u) > 300, F.lit("long message")).otherwise(""),
                "agent_empathy": X.strip(F.substring(a, 1, 8)),
                "agent_action": F.when(F.contains(a, F.lit("?")), F.lit("asks")).otherwise("tells"),
            }
        )


class Judged:
    """A model's judgements (see judge.Model, or calls.CallTable): flags in waves over conversations, as each topic stands; analyses of each round by itself.

    user and own are the profiles (JSON text) that analyses start from, records what was retrieved.
    """

    def __init__(self, model, user: str = "{}", own: str = "{}", records: str = "[]"):
        self.model, self.user, self.own, self.records = model, user, own, records

    def flags(self, rounds: DataFrame) -> DataFrame:
        from talkloom.operators.wavefront import segment_with

        told = segment_with(rounds, self.model)
        return told.select(*[c for c in rounds.columns if c not in ("topic_changed", "is_noise")], "topic_changed", "is_noise")

    def analyses(self, rounds: DataFrame) -> DataFrame:
        c = F.col
        told = self.model.column(rounds, "_profile", lambda m: m.analyse_user(F.lit(self.user), c("user_text"), F.lit(self.records)))
        told = self.model.column(told, "_persona", lambda m: m.analyse_own(F.lit(self.own), c("_profile"), c("user_text")))
        found = {"user_prediction": "_profile.future.prediction", "user_risk": "_profile.future.risk", "agent_empathy": "_persona.present.empathy", "agent_action": "_persona.future.action"}
        return told.withColumns({k: c(v) for k, v in found.items()}).drop("_profile", "_persona")


REGISTRY = {"offline": Offline, "model": Judged}


def provider(name: str, **options) -> Provider:
    if name not in REGISTRY:
        raise ValueError(f"no provider is registered as {name!r}; there are: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name](**options)


def contract_violations(rows: DataFrame) -> DataFrame:
    """Checks the limits that the contracts state: topic (20 characters), a topic's summary (topic_summary, 30) and its content
    (300), keywords (5 to 10, of 5 characters each), score (-5 to 5). Adds violations, an array of names; absent columns aren't checked."""
    checks = {
        "topic_length": ("topic", lambda c: F.length(c) > 20),
        "topic_summary_length": ("topic_summary", lambda c: F.length(c) > 30),
        "content_length": ("content", lambda c: F.length(c) > 300),
        "keyword_count": ("keywords", lambda c: ~F.size(c).between(5, 10)),
        "keyword_length": ("keywords", lambda c: F.exists(c, lambda k: F.length(k) > 5)),
        "score_range": ("score", lambda c: F.abs(c) > 5),
    }
    found = [F.when(test(F.col(col)), F.lit(name)) for name, (col, test) in checks.items() if col in rows.columns]
    return rows.withColumn("violations", F.array_compact(F.array(*found)) if found else F.array().cast("array<string>"))
