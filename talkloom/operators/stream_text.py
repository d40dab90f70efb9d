"""Incremental segmentation of streamed text into speakable pieces, and release in order.

The rules see a text as it grows: at most one piece is cut for each chunk that arrives, and what is left
is one piece at the end. A piece's number counts only pieces that have something to say.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkloom.functions.text import WHITE_SPACE

#: Marks at which the first pieces, any piece, and long pieces are cut.
FIRST_MARKS = "~。！？，.!?,、；;"
END_MARKS = "~。！？.!?"
PAUSE_MARKS = "，；、,;"
LAST_RESORT_MARKS = "。！？.!?,，"
#: Early pieces, the length from which pauses count, the tail they may leave, the most.
EARLY, TARGET, TAIL, LONGEST = 3, 15, 10, 100

_BRACKETS = re.compile(r"[（(][\s\S]*?[）)]")


def spoken(piece: str) -> str:
    return _BRACKETS.sub("", "".join(c for c in piece.strip(WHITE_SPACE) if ord(c) < 0x10000))


def cut_at(text: str, made: int) -> int | None:
    """Where the pending text is cut, if it is: the length of the piece."""
    if not text.strip(WHITE_SPACE):
        return None
    first_of = lambda marks: next((i + 1 for i, c in enumerate(text) if c in marks), None)
    last_of = lambda marks: next((i + 1 for i in range(len(text) - 1, -1, -1) if text[i] in marks), None)
    at = first_of(END_MARKS) or (first_of(FIRST_MARKS) if made < EARLY else None)
    if at is None and len(text) >= TARGET:
        pause = last_of(PAUSE_MARKS)
        at = pause if pause and len(text) - pause < TAIL else None
    if at is None and len(text) >= LONGEST:
        at = last_of(LAST_RESORT_MARKS) or LONGEST
    return at


class Segmenter:
    """State of one stream. Cuts count towards EARLY even if nothing of them is spoken."""

    def __init__(self, pending: str = "", cuts: int = 0, number: int = 0):
        self.pending, self.cuts, self.number = pending, cuts, number

    def _emit(self, piece: str) -> Iterator[tuple[int, str]]:
        self.cuts += 1
        said = spoken(piece)
        if said:
            self.number += 1
            yield self.number, said

    def feed(self, chunk: str) -> Iterator[tuple[int, str]]:
        self.pending += chunk
        at = cut_at(self.pending, self.cuts)
        if at is not None:
            piece, self.pending = self.pending[:at], self.pending[at:].strip(WHITE_SPACE)
            yield from self._emit(piece)

    def finish(self) -> Iterator[tuple[int, str]]:
        rest, self.pending = self.pending, ""
        if rest.strip(WHITE_SPACE):
            yield from self._emit(rest)


def segments(chunks: Iterable[str]) -> list[tuple[int, str]]:
    s = Segmenter()
    return [x for chunk in chunks for x in s.feed(chunk)] + list(s.finish())


def segment_streams(chunks: DataFrame) -> DataFrame:
    """stream_id, segment_id, segment from stream_id, chunk_seq, chunk; a null chunk is empty.

    One stream is one reply, which a task holds; streams are spread over tasks.
    """
    kind = chunks.schema["stream_id"].dataType.simpleString()

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        got = segments(c or "" for c in rows.sort_values("chunk_seq")["chunk"])
        return pd.DataFrame([(key[0], n, s) for n, s in got], columns=["stream_id", "segment_id", "segment"], dtype=object)

    return chunks.groupBy("stream_id").applyInPandas(run, f"stream_id {kind}, segment_id int, segment string")


def segment_rows(rows: DataFrame, chunks: str = "chunks") -> DataFrame:
    """The same for streams that lie in one row each (chunks: an array, in order): the other columns, segment_id and segment, without a shuffle."""
    others = [c for c in rows.columns if c != chunks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [segments(c or "" for c in s.as_py() or ()) for s in batch.column(len(others))]
            at = pa.array([k for k, g in enumerate(got) for _ in g], pa.int64())
            new = [pa.array([n for g in got for n, _ in g], pa.int32()), pa.array([s for g in got for _, s in g], pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(len(others))), *new], names=[*others, "segment_id", "segment"])

    plain = rows.select(*others, chunks)
    schema = T.StructType([*plain.schema.fields[:-1], T.StructField("segment_id", T.IntegerType()), T.StructField("segment", T.StringType())])
    return plain.mapInArrow(run, schema)


def release_in_order(done: DataFrame) -> DataFrame:
    """Adds released_after: the completion (done_seq) with which a segment can be played, once all
    before it are complete. Failed segments (ok false) are passed over and hold nothing up."""
    order = Window.partitionBy("stream_id").orderBy("segment_id").rowsBetween(Window.unboundedPreceding, 0)
    return done.withColumn("released_after", F.max("done_seq").over(order)).where(F.coalesce("ok", F.lit(True)))
