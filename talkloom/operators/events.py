"""Event frames, idle sessions, refreshes, stale artefacts and prompt texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkloom.functions import text as X
from talkloom.sources.stores import _exists


def frame(kind: Column, content: Column) -> Column:
    """A server-sent event with a JSON object of type and content (left out where null)."""
    return F.concat(F.lit("data: "), F.to_json(F.struct(kind.alias("type"), content.alias("content"))), F.lit("\n\n"))


def turn_frames(turns: DataFrame) -> DataFrame:
    """turn_id, seq, type, frame: a thinking event, one event for each chunk, and done.

    turns: turn_id, thinking (string), chunks (array of strings; empty chunks are left out).
    """
    chunks = F.filter(F.coalesce("chunks", F.array().cast("array<string>")), lambda c: c.isNotNull() & (c != ""))
    event = lambda kind, content: F.struct(F.lit(kind).alias("type"), content.alias("content"))
    events = F.concat(
        F.array(event("thinking", F.col("thinking"))), F.transform(chunks, lambda c: event("chunk", c)), F.array(event("done", F.lit(None).cast("string")))
    )
    return turns.select("turn_id", F.posexplode(events).alias("seq", "e")).select("turn_id", "seq", F.col("e.type").alias("type"), frame(F.col("e.type"), F.col("e.content")).alias("frame"))


def parsed_frames(parts: DataFrame) -> DataFrame:
    """stream_id, seq, type, content of the parts (stream_id, seq, part) that are data frames; what isn't one is passed over."""
    parsed = parts.where(F.startswith("part", F.lit("data: "))).withColumn("e", F.from_json(F.substring("part", 7, 1 << 30), "type string, content string"))
    return parsed.select("stream_id", "seq", F.col("e.type").alias("type"), F.col("e.content").alias("content"))


def parse_frames(streams: DataFrame) -> DataFrame:
    """stream_id, seq, type, content of the complete data frames in text.

    The tail after the last blank line is not complete and is left for later (see unfinished; streaming.stateful.frames carries it over).
    """
    parts = F.split("text", "\n\n")
    return parsed_frames(streams.select("stream_id", F.posexplode(F.slice(parts, 1, F.size(parts) - 1)).alias("seq", "part")))


def unfinished(text: Column) -> Column:
    return F.element_at(F.split(text, "\n\n"), -1)


def idle_sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """user_id, session_start, session_end (of the last event) and n_events: runs of events less than gap apart.

    An event that comes exactly gap after the last one begins the next session. (A conversation's topic is closed only when nothing was said for longer: see
    rounds.after_silence.)
    """
    w = F.session_window("ts", gap)
    return events.groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n_events"), F.max("ts").alias("session_end")).select(
        "user_id", F.col("w.start").alias("session_start"), "session_end", "n_events"
    )


def refresh_due(events: DataFrame, hours: int = 24) -> DataFrame:
    """Adds due: whether the user's last event is that long ago or longer. A first event is never due."""
    last = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return events.withColumn("due", F.coalesce(F.col("ts") - last >= F.expr(f"INTERVAL {hours} HOURS"), F.lit(False)))


def stale(files: DataFrame, now: Column, hours: int = 24, prefix: str = "recording_", suffix: str = ".wav") -> DataFrame:
    """Files (name, modified) with that prefix and suffix that are older than that at the time now."""
    return files.where(F.startswith("name", F.lit(prefix)) & F.endswith("name", F.lit(suffix)) & (now - F.col("modified") > F.expr(f"INTERVAL {hours} HOURS")))


def stale_files(spark: SparkSession, folder: str, now: Column, hours: int = 24, prefix: str = "recording_", suffix: str = ".wav") -> DataFrame:
    """path, name and modified of such files in a folder; the files themselves aren't read. A missing folder has none."""
    if not _exists(spark, folder):
        return spark.createDataFrame([], "path string, name string, modified timestamp")
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{prefix}*{suffix}").load(folder).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("modificationTime").alias("modified"))
    return stale(files, now, hours, prefix, suffix)


def thinking(profile: Column, persona: Column) -> Column:
    """The analysis as it is shown: the present and future of both sides, a placeholder for the past.

    profile and persona: structs with present and future. A side that is null is left out.
    """
    shown = lambda side, past: F.when(side.isNotNull(), F.struct(F.lit(past).alias("past"), side["present"].alias("present"), side["future"].alias("future")))
    # fixed values: the placeholders
    return F.to_json(F.struct(shown(profile, "（见用户画像）").alias("user_profile"), shown(persona, "（见人设）").alias("agent_persona")))


def labelled(pairs: list[tuple[str, Column]], between: str = "\n") -> Column:
    """Lines "label: value" for the values that aren't empty."""
    lines = [F.when(F.length(v) > 0, F.concat(F.lit(f"{label}: "), X.html_escape(v))) for label, v in pairs]
    return F.concat_ws(between, *lines)
