"""Contracts of model responses, and profiles that are updated from records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.functions import text as X
from talkloom.sources.stores import LAYERS, layer_merge

#: What each kind of response holds (fixed names), as a schema.
CONTRACTS: dict[str, str] = {
    "topic_boundary": "topic_changed boolean, confidence double",
    "topic_init": "topic string",
    "noise": "is_noise boolean",
    "topic_summary": "topic string",
    "content_summary": "content string",
    "keywords": "keywords array<string>",
    "worthiness": "is_worthy boolean",
    "user_analysis": "present struct<emotion: string, intent: string, context: string>, future struct<prediction: string, risk: string, basis: string>",
    "persona_analysis": "present struct<empathy: string, emotion_state: string>, future struct<action: string, style: string>",
}
#: What a flag is when a response doesn't tell.
FLAG_DEFAULTS = {"topic_changed": False, "is_noise": False, "is_worthy": True}


def contract(response: Column, name: str) -> Column:
    """The response as its contract's struct, fenced or not. Fields that are missing, or of another
    type (a quoted boolean), are null; so are all where the response isn't JSON."""
    return F.from_json(X.json_text(response), CONTRACTS[name])


def flag(response: Column, name: str, field: str) -> Column:
    """A flag of the response, or its default."""
    return F.coalesce(contract(response, name)[field], F.lit(FLAG_DEFAULTS[field]))


def update_profiles(profiles: DataFrame, records: DataFrame, judge: Callable[[Column], Column], last_seen: Column | None = None) -> DataFrame:
    """id and the four layers after an update from all of a profile's records, in their order.

    profiles: id, document (JSON text). records: id, seq and any other columns. judge gets the
    records as an array of structs and returns the new document as JSON text, of which only the layers it has
    replace the old ones; null leaves the profile as it is, as do no records. last_seen, a
    boolean column of profiles, restricts the update to profiles that are due.
    """
    others = [c for c in records.columns if c not in ("id", "seq")]
    lists = records.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seq", *others))).alias("_records"))
    new = F.when(F.col("_records").isNotNull() & (F.lit(True) if last_seen is None else F.coalesce(last_seen, F.lit(False))), judge(F.col("_records")))
    joined = profiles.join(lists, "id", "left").withColumn("_new", F.coalesce(new, F.lit("{}")))
    return joined.select("id", *layer_merge(F.col("document"), F.col("_new")))


def activated(document: Column, chosen: Column) -> Column:
    """The part of a profile that a response chose, as JSON text: its layers, nulls for the others.

    A response that isn't an object, or chooses nothing, gives the whole profile: a profile is never lost to a bad response.
    """
    keys = F.json_object_keys(X.json_text(chosen))
    none = keys.isNull() | ~F.arrays_overlap(keys, F.array(*map(F.lit, LAYERS)))
    source = F.when(none, document).otherwise(X.json_text(chosen))
    return F.to_json(F.struct(*[F.get_json_object(source, f"$.{k}").alias(k) for k in LAYERS]), {"ignoreNullFields": "false"})
