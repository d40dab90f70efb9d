"""Streaming forms of segmentation, trust, release in order and event frames: state by key, kept by the engine's state store.

closed_topics, running_trust and pieces need their input in order within a key: rows of one micro-batch are sorted, order across batches
is the source's duty, or that of in_order, which makes it from any order of arrival. frames puts its reads in order itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from talkloom.functions.text import UNNAMED_TOPIC, WHITE_SPACE
from talkloom.operators.events import parsed_frames
from talkloom.operators.rounds import ANALYSES
from talkloom.operators.stream_text import Segmenter

RECORD_SCHEMA = "conv_id long, topic_no int, n_rounds int, topic string, content string, " + ", ".join(f"{a} string" for a in ANALYSES)


_TOPIC_COLUMNS = ["conv_id", "topic_no", "n_rounds", "topic", "content", *ANALYSES]
_UNITS = {"second": 1_000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}


def _milliseconds(span: str) -> int:
    """Of a span such as "30 minutes"."""
    m = re.fullmatch(r"\s*(\d+)\s*(second|minute|hour|day)s?\s*", span)
    if not m:
        raise ValueError(f"no span of time: {span!r}")
    return int(m[1]) * _UNITS[m[2]]


def _with_ms(rows: DataFrame, time: str) -> DataFrame:
    """Adds event_ms, an event's time in milliseconds as watermarks and timers count them, whatever the session's time zone."""
    if isinstance(rows.schema[time].dataType, T.TimestampNTZType):
        ms = F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(time))
    else:
        ms = F.unix_millis(F.col(time))
    return rows.withColumn("event_ms", ms.cast("long"))


class _Topics(StatefulProcessor):
    """The open topic of each conversation: its rounds, and the analyses gathered so far.

    With idle (milliseconds) a conversation that has been silent for longer is over: its topic is closed, by a timer when the
    watermark gets there, or by the round that comes after the silence, which opens the next one unjudged.
    """

    def __init__(self, idle: int | None = None):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "topic_no int, seen int, last long, rounds array<string>, " + ", ".join(f"{a} array<string>" for a in ANALYSES))

    @staticmethod
    def _record(key, topic_no: int, rounds: list[str], gathered: list[list[str]]) -> tuple:
        topic = rounds[0][:30].strip(WHITE_SPACE) or UNNAMED_TOPIC
        return (key[0], topic_no, len(rounds), topic, "\n".join(rounds[-3:]), *(" | ".join(dict.fromkeys(g)) for g in gathered))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.open.get() if self.open.exists() else None
        topic_no, seen, last, rounds, *gathered = held if held else (0, 0, None, [], *([] for _ in ANALYSES))
        rounds, gathered, due = list(rounds), [list(g) for g in gathered], last
        out = []
        for r in pd.concat(list(rows)).sort_values("round_no").to_dict("records"):
            if self.idle is not None:
                now = last if pd.isna(r["event_ms"]) else int(r["event_ms"])
                if rounds and last is not None and now - last > self.idle:
                    out.append(self._record(key, topic_no, rounds, gathered))
                    topic_no, seen, rounds, gathered = topic_no + 1, 0, [], [[] for _ in ANALYSES]
                last = now if last is None or now is None else max(last, now)
            for name, g in zip(ANALYSES, gathered):
                if r[name]:
                    g.append(r[name])
            seen += 1
            if seen > 1 and r["topic_changed"] is True:
                if r["is_noise"] is True:
                    continue
                out.append(self._record(key, topic_no, rounds, gathered))
                topic_no, rounds, gathered = topic_no + 1, [], [[] for _ in ANALYSES]
            rounds.append(r["round_dialog"])
        if self.idle is not None and last != due:
            if due is not None:
                self.handle.deleteTimer(due + self.idle + 1)
            self.handle.registerTimer(last + self.idle + 1)
        self.open.update((topic_no, seen, last, rounds, *gathered))
        yield pd.DataFrame(out, columns=_TOPIC_COLUMNS, dtype=object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        topic_no, _, last, rounds, *gathered = self.open.get()
        if rounds:
            # what stays is the number of the next topic; rounds from before the watermark don't come any more
            self.open.update((topic_no + 1, 0, last, [], *([] for _ in ANALYSES)))
            yield pd.DataFrame([self._record(key, topic_no, list(rounds), [list(g) for g in gathered])], columns=_TOPIC_COLUMNS, dtype=object)

    def close(self) -> None:
        pass


def closed_topics(rounds: DataFrame, idle: str | None = None) -> DataFrame:
    """topic records of topics as they close, from a stream of judged rounds (conv_id, round_no,
    round_dialog, topic_changed, is_noise and the four analyses).

    idle, such as "30 minutes": a conversation in which nothing was said for longer is over and its last topic is closed, once; the rounds need
    a time (ts) with a watermark then; one without a time counts as said when the one before it was. The batch form is rounds.segment with opens=rounds.after_silence(idle).
    """
    if idle is None:
        return rounds.groupBy("conv_id").transformWithStateInPandas(_Topics(), RECORD_SCHEMA, "Append", "None")
    return _with_ms(rounds, "ts").groupBy("conv_id").transformWithStateInPandas(_Topics(_milliseconds(idle)), RECORD_SCHEMA, "Append", "EventTime")


class _Trust(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.score = handle.getValueState("score", "score int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        score = self.score.get()[0] if self.score.exists() else 0
        out = []
        for r in pd.concat(list(rows)).sort_values(["ts", "event_id"]).to_dict("records"):
            score = max(0, min(100, score + int(r["change"])))
            out.append((key[0], r["event_id"], score))
        self.score.update((score,))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "trust_score"])

    def close(self) -> None:
        pass


def running_trust(events: DataFrame) -> DataFrame:
    """user_id, event_id, trust_score from a stream of events (user_id, ts, event_id, change)."""
    return events.groupBy("user_id").transformWithStateInPandas(_Trust(), "user_id long, event_id long, trust_score int", "Append", "None")


class _Pieces(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "pending string, cuts int, number int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s = Segmenter(*self.held.get()) if self.held.exists() else Segmenter()
        out = []
        for r in pd.concat(list(rows)).sort_values("chunk_seq").to_dict("records"):
            out += s.feed(r["chunk"] or "")
            if r["last"] is True:
                out += s.finish()
        self.held.update((s.pending, s.cuts, s.number))
        yield pd.DataFrame([(key[0], n, p) for n, p in out], columns=["stream_id", "segment_id", "segment"], dtype=object)

    def close(self) -> None:
        pass


def pieces(chunks: DataFrame) -> DataFrame:
    """stream_id, segment_id, segment from a stream of chunks (stream_id, chunk_seq, chunk, last)."""
    return chunks.groupBy("stream_id").transformWithStateInPandas(_Pieces(), "stream_id long, segment_id int, segment string", "Append", "None")


#: Waiting rows of a key that lie with its other state; numbers of a page of the others; and those held in a batch before they go to their pages.
FEW, PAGE, HELD = 64, 64, 4096


class _Waiting:
    """Rows of a key that wait, by their number. A few lie with the key's own state, more in pages of a map, so that a batch asks the store once
    for a page and not for each row; what a batch holds is bounded. Of rows with one number the first stays: pages are older than what is held."""

    def __init__(self, pages, number: int):
        self.pages, self.number = pages, number

    def open(self, few: list, paged: int) -> _Waiting:
        self.held = {r[self.number]: tuple(r) for r in few}
        self.paged, self.page, self.rows, self.changed = paged, None, {}, False
        return self

    def add(self, number: int, values: tuple) -> None:
        self.held.setdefault(number, values)
        if len(self.held) > HELD:
            self.store()

    def take(self, number: int) -> tuple | None:
        if self.paged:
            self.turn_to(number // PAGE)
            if number in self.rows:
                self.held.pop(number, None)
                self.paged, self.changed = self.paged - 1, True
                return self.rows.pop(number)
        return self.held.pop(number, None)

    def turn_to(self, page: int | None, there: bool = True) -> None:
        if page == self.page:
            return
        if self.changed:
            if self.rows:
                self.pages.updateValue((self.page,), ([self.rows[n] for n in sorted(self.rows)],))
            else:
                self.pages.removeKey((self.page,))
        there = there and page is not None and self.pages.containsKey((page,))
        self.rows = {r[self.number]: tuple(r) for r in self.pages.getValue((page,))[0]} if there else {}
        self.page, self.changed = page, False

    def store(self) -> None:
        """Brings what is held to its pages."""
        there = self.paged > 0
        for n in sorted(self.held):
            self.turn_to(n // PAGE, there)
            if n not in self.rows:
                self.rows[n], self.paged, self.changed = self.held[n], self.paged + 1, True
        self.held = {}

    def all(self) -> Iterator[tuple]:
        self.turn_to(None)
        if self.paged:
            for _, v in self.pages.iterator():
                yield from v[0]
        yield from self.held.values()

    def close(self) -> tuple[list, int]:
        if len(self.held) > FEW:
            self.store()
        self.turn_to(None)
        return [self.held[n] for n in sorted(self.held)], self.paged


class _InOrder(StatefulProcessor):
    """Rows of a key wait, by their number, for those before them; what is next goes at once and takes along what has waited for it."""

    def __init__(self, number: str, columns: list[T.StructField], first: int, limit: int | None, highest: str | None):
        self.number, self.columns, self.first, self.limit, self.highest = number, [f.name for f in columns], first, limit, highest
        self.rows = T.ArrayType(T.StructType(columns))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        at = T.StructType([*(T.StructField(c, T.LongType()) for c in ("next", "released", "highest", "due", "paged")), T.StructField("few", self.rows)])
        self.at = handle.getValueState("at", at)
        self.waiting = _Waiting(handle.getMapState("waiting", "page long", T.StructType([T.StructField("rows", self.rows)])), self.columns.index(self.number))

    def _open(self) -> list:
        *state, paged, few = self.at.get() or (self.first, 0, None, None, 0, [])
        self.waiting.open(few, paged)
        return state

    def _close(self, state: list) -> None:
        self._watch(state)
        few, paged = self.waiting.close()
        self.at.update((*state, paged, few))

    def _free(self, state: list) -> Iterator[Row]:
        """Releases the row that has the next number, if it is there, and all that follow it without a gap."""
        while (row := self.waiting.take(state[0])) is not None:
            if self.highest is not None:
                told = row[self.columns.index(self.highest)]
                state[2] = told if state[2] is None else state[2] if told is None else max(state[2], told)
            yield Row(**dict(zip(self.columns, row)), release=state[1], **({} if self.highest is None else {"released_after": state[2]}))
            state[0], state[1] = state[0] + 1, state[1] + 1

    def _watch(self, state: list) -> None:
        """While rows wait, a timer stands at the time up to which the first of them waits."""
        if self.limit is None:
            return
        i = self.columns.index("event_ms")
        due = min((v[i] + self.limit for v in self.waiting.all() if v[i] is not None), default=None)
        if due != state[3]:
            if state[3] is not None:
                self.handle.deleteTimer(state[3])
            if due is not None:
                self.handle.registerTimer(due)
            state[3] = due

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state = self._open()
        for row in rows:
            number = row[self.number]
            if number is None or number < state[0]:
                continue  # already out, or passed over
            self.waiting.add(number, tuple(row[c] for c in self.columns))
            if number == state[0]:
                yield from self._free(state)
        self._close(state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state = self._open()
        state[3] = None
        now, i, n = expiredTimerInfo.getExpiryTimeInMs(), self.columns.index("event_ms"), self.columns.index(self.number)
        # all gaps before the last row whose time is up are given up
        last, pages = None, set()
        for v in self.waiting.all():
            pages.add(v[n] // PAGE)
            if v[i] is not None and v[i] + self.limit <= now:
                last = v[n] if last is None else max(last, v[n])
        self.waiting.store()
        for page in sorted(pages) if last is not None else ():
            self.waiting.turn_to(page)
            for number in sorted(self.waiting.rows):
                if state[0] <= number <= last:
                    state[0] = number
                    yield from self._free(state)
        self._close(state)

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, key: str, number: str, first: int = 1, limit: str | None = None, time: str = "ts", highest: str | None = None) -> DataFrame:
    """The rows of a stream, each key's in the order of its numbers (integers from first on), and release: how many of the key went before.

    A row waits until all numbers before its own have come, whatever order they come in. A number counts once: repeated rows are dropped, as are those
    without a number. limit, such as "10 minutes": a row that has a time waits no longer than that after it, by the watermark of the
    column time; then the missing ones before it are given up, and dropped should they come. highest adds released_after, the
    largest value of that column so far: with the completion's number, batch's release_in_order.
    """
    timed = rows if limit is None else _with_ms(rows, time)
    columns = list(timed.schema.fields)
    out = [*columns, T.StructField("release", T.LongType()), *([T.StructField("released_after", T.LongType())] if highest else [])]
    p = _InOrder(number, columns, first, None if limit is None else _milliseconds(limit), highest)
    told = timed.groupBy(key).transformWithState(p, T.StructType(out), "Append", "None" if limit is None else "EventTime")
    return told if limit is None else told.drop("event_ms")


class _Frames(StatefulProcessor):
    """The bytes of a stream after its last whole frame, and reads that came before their turn."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        reads = "array<struct<read_seq: long, data: binary>>"
        self.at = handle.getValueState("at", f"next long, seq long, tail binary, paged long, few {reads}")
        self.early = _Waiting(handle.getMapState("early", "page long", f"reads {reads}"), 0)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        nxt, seq, tail, paged, few = self.at.get() or (0, 0, b"", 0, [])
        self.early.open(few, paged)
        ready = [bytes(tail)]
        for row in rows:
            n = row["read_seq"]
            if n is None or n < nxt:
                continue
            self.early.add(n, (n, row["data"]))
            if n > nxt:
                continue
            while (read := self.early.take(nxt)) is not None:
                data, nxt = bytes(read[1] or b""), nxt + 1
                ready.append(data)
                # a frame's end may be cut; what can't have one is not searched again
                if b"\n\n" not in (ready[-2][-1:] if len(ready[-2]) else b"".join(ready[:-1])[-1:]) + data:
                    continue
                # a character may be cut, a frame's end isn't: its bytes are no part of a longer character
                *whole, tail = b"".join(ready).split(b"\n\n")
                ready = [tail]
                for part in whole:
                    yield Row(stream_id=key[0], seq=seq, part=part.decode("utf-8", "replace"))
                    seq += 1
        few, paged = self.early.close()
        self.at.update((nxt, seq, b"".join(ready), paged, few))

    def close(self) -> None:
        pass


def frames(reads: DataFrame) -> DataFrame:
    """stream_id, seq, type, content of the data frames of streams that arrive as reads of bytes (stream_id, read_seq from 0, data).

    However a stream is cut into reads, in frames or in characters, and in whatever order they arrive, the frames are those that
    events.parse_frames finds in the whole text. A null read is empty; a read that is repeated counts once; bytes that are no UTF-8 are replaced.
    """
    kind = reads.schema["stream_id"].dataType
    out = T.StructType([T.StructField("stream_id", kind), T.StructField("seq", T.IntegerType()), T.StructField("part", T.StringType())])
    return parsed_frames(reads.groupBy("stream_id").transformWithState(_Frames(), out, "Append", "None"))
