"""Removal of long repeated byte strings, by prefix-free parsing and suffix arrays of a dictionary.

A byte is removed when a string of LENGTH bytes that covers it also starts in a document with a
smaller id. Strings are those of the input, whatever is removed from it.

Parsing: a rolling hash is taken of every ANCHOR bytes; the least hash among those inside a string
of LENGTH bytes is its trigger, so that equal strings have equal triggers, at the same place. The
strings that start one after another and share a trigger form a phrase, which carries the bytes up
to its last string's end: the phrases, with the trigger as their common word, are prefix-free in
the sense that a string's order and equality are settled within its phrase. A text is a sequence
of phrases (its parse); the distinct phrases are the dictionary, much smaller than a repetitive text.

Three exchanges between blocks of documents and buckets of triggers (see blocks):
 1. Each block sends its distinct triggers' hashes; what only one document has is dropped, as its
    strings can't repeat. A collision of hashes keeps a trigger that could be dropped, no more.
 2. Blocks send the distinct phrases of the remaining triggers, with the least id they occur in.
    A bucket makes a dictionary of them, each distinct phrase once, and ranks all its suffixes that
    are at least LENGTH long by their first LENGTH bytes: the part of the dictionary's suffix array
    that matters. Suffixes of one rank are occurrences of one string, and the least id among them is
    known. As all strings of a trigger are in one bucket, this is corpus order for them.
 3. The answers, a bit for each suffix, are laid on the block's parse, and removed bytes are cut.
A trigger with more than HOT bytes of phrases (a common line between unlike neighbours) would fill its bucket;
its strings are sent one by one, dealt out by their own hash, so no bucket
holds them all. Blocks tell each trigger's bytes with its hash, to the next power of two.

A block sends a message to each bucket that it has keys for, so there are never more messages than distinct
keys: they grow as blocks times buckets only while a message has many keys, and in proportion to the corpus beyond.

Distinct phrases within a block are told apart by 64-bit hashes of their first and last LENGTH bytes.

Defined results: a null text is empty. Texts shorter than LENGTH are untouched. A null id counts
as greater than all others (and equal to itself): such a text may be cut, and cuts none. Rows that
repeat an id don't cut each other. Texts of any length are cut whole; columns other than id, text and those to keep are not read, whatever their names. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from talkloom.llm.blocks import BLOCK_BYTES, NO_ID, answer, make_blocks, replies, send, texts, with_replies
from talkloom.llm.common import written

LENGTH, ANCHOR = 50, 20
#: Bytes of distinct phrases, over all blocks, from which a trigger's strings are sent one by one.
HOT = 1 << 20
#: Bytes of corpus for each bucket of triggers, and of phrases.
TRIGGER_BYTES, PHRASE_BYTES = 16 << 20, 4 << 20
_CHUNK = 1 << 17
_BASE = 0x9E3779B97F4A7C15
_WORD = (1 << 64) - 1
_LOW = 40  # bits of a trigger's hash that are sent, beside its bucket


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def rolling(data: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """Polynomial hashes of every run of each size, modulo 2**64, built by doubling."""
    table = _mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(_BASE))
    power = lambda n: np.uint64(pow(_BASE, n, 1 << 64))
    join = lambda a, n, b, m: a[: max(0, len(a) - m)] * power(m) + b[n : n + max(0, len(a) - m)]
    doubles, step = {1: table[data]}, 1
    while 2 * step <= max(sizes):
        doubles[2 * step] = join(doubles[step], step, doubles[step], step)
        step *= 2
    out = []
    for size in sizes:
        h, n = None, 0
        for bit in sorted(doubles, reverse=True):
            if size & bit:
                h, n = (doubles[bit], bit) if h is None else (join(h, n, doubles[bit], bit), n + bit)
        out.append(h)
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while 2 * step <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (width - step)], x[width - step :]) if width > step else x


class Parse:
    """The phrases of a block's texts: start, count (of strings), trigger (hash), name (hash), doc."""

    def __init__(self, data: bytes, ends: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR):
        buf = np.frombuffer(data, np.uint8)
        width, n = length - anchor + 1, len(buf) - length + 1
        valid = np.ones(max(0, n), bool)
        for end in ends.tolist():
            valid[max(0, end - length + 1) : end] = False
        got: list[tuple[np.ndarray, ...]] = []
        for lo in range(0, max(0, n), _CHUNK):
            hi = min(lo + _CHUNK, n)
            if not valid[lo:hi].any():
                continue
            small, whole = rolling(buf[lo : hi + length - 1], (anchor, length))
            small = _mix(small)
            place_bits = np.uint64(20)
            key = small >> place_bits << place_bits | np.arange(len(small), dtype=np.uint64)
            at = (sliding_min(key, width) & np.uint64((1 << 20) - 1)).astype(np.int64)
            ok = valid[lo:hi]
            first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (ok[1:] != ok[:-1])]))
            count = np.diff(np.append(first, hi - lo))
            first, count = first[ok[first]], count[ok[first]]
            name = _mix(_mix(whole[first]) * np.uint64(3) + whole[first + count - 1] + count.astype(np.uint64))
            got.append((first + lo, count, small[at[first]], name))
        self.start, self.count, self.trigger, self.name = (np.concatenate(x) for x in zip(*got)) if got else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        self.doc = np.searchsorted(ends, self.start, "right")
        self.buf, self.length = buf, length

    def keys(self, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (bucket, low bits) of the triggers in order, and each phrase's place among them."""
        bucket = (self.trigger >> np.uint64(_LOW)) % np.uint64(n_buckets)
        return np.unique(bucket << np.uint64(_LOW) | self.trigger & np.uint64((1 << _LOW) - 1), return_inverse=True)

    def spread(self, which: np.ndarray) -> tuple[np.ndarray, ...]:
        """The strings of the chosen phrases one by one: start, count 1, name, doc."""
        count = self.count[which]
        start = np.repeat(self.start[which], count) + _ramp(count)
        name = np.zeros(len(start), np.uint64)
        for i in range(0, len(start), _CHUNK):
            h = np.zeros(len(start[i : i + _CHUNK]), np.uint64)
            for k in range(self.length):
                h = _mix((h + self.buf[start[i : i + _CHUNK] + k]) * np.uint64(_BASE))
            name[i : i + _CHUNK] = h
        return start, np.ones(len(start), np.int64), name, np.repeat(self.doc[which], count)


def _ramp(count: np.ndarray) -> np.ndarray:
    """0 .. c-1 for each c."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def _planes(x: np.ndarray) -> bytes:
    """64-bit numbers by byte plane, which compress where the numbers are small."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes()


def _numbers(raw: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(8, -1).T.copy().view(kind).ravel()


def trigger_messages(parse: Parse, ids: np.ndarray, n_buckets: int) -> Iterator[tuple[int, list[bytes]]]:
    """For each bucket the distinct triggers' hashes (as differences), which have several ids in the block, and
    the bytes of their distinct phrases, as a power of two."""
    keys, at = parse.keys(n_buckets)
    if not len(keys):
        return
    order = np.lexsort((parse.name, at))
    cut = np.searchsorted(at[order], np.arange(len(keys)))
    owner = ids[parse.doc][order]
    several = np.minimum.reduceat(owner, cut) != np.maximum.reduceat(owner, cut)
    fresh = np.ones(len(order), bool)
    fresh[1:] = (parse.name[order][1:] != parse.name[order][:-1]) | (at[order][1:] != at[order][:-1])
    size = np.add.reduceat(np.where(fresh, parse.count[order] + parse.length - 1, 0), cut)
    power = np.ceil(np.log2(size)).astype(np.uint8)
    buckets = keys >> np.uint64(_LOW)
    low = keys & np.uint64((1 << _LOW) - 1)
    for b in np.unique(buckets).tolist():
        i, j = np.searchsorted(buckets, np.uint64(b)), np.searchsorted(buckets, np.uint64(b), "right")
        yield b, [_planes(np.diff(low[i:j], prepend=np.uint64(0))), np.packbits(several[i:j]).tobytes(), power[i:j].tobytes()]


def shared_triggers(messages: list[list[bytes]], hot: int) -> list[bytes]:
    """For each message two rows of bits: triggers that several ids have, and those with over hot bytes of phrases."""
    low = [np.cumsum(_numbers(m[0], np.uint64), dtype=np.uint64) for m in messages]
    several = [np.unpackbits(np.frombuffer(m[1], np.uint8), count=len(k)) for m, k in zip(messages, low)]
    keys, at, blocks = np.unique(np.concatenate(low), return_inverse=True, return_counts=True)
    shared = (blocks > 1) | (np.bincount(at, np.concatenate(several), len(keys)) > 0)
    size = np.bincount(at, 2.0 ** np.concatenate([np.frombuffer(m[2], np.uint8) for m in messages]), len(keys))
    out, i = [], 0
    for k in low:
        here = at[i : i + len(k)]
        out.append(np.packbits(np.stack([shared[here], size[here] > hot]), axis=1).tobytes())
        i += len(k)
    return out


class Entries:
    """The distinct phrases a block sends in the second exchange, in their order, and their occurrences."""

    def __init__(self, parse: Parse, ids: np.ndarray, answers: dict[int, bytes], n_triggers: int, n_phrases: int):
        keys, at = parse.keys(n_triggers)
        shared, hot = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        buckets = keys >> np.uint64(_LOW)
        for b in np.unique(buckets).tolist():
            i, j = np.searchsorted(buckets, np.uint64(b)), np.searchsorted(buckets, np.uint64(b), "right")
            shared[i:j], hot[i:j] = np.unpackbits(np.frombuffer(answers[b], np.uint8).reshape(2, -1), axis=1, count=j - i).astype(bool)
        cold = np.flatnonzero(shared[at] & ~hot[at])
        one = parse.spread(np.flatnonzero(shared[at] & hot[at]))
        start = np.concatenate([parse.start[cold], one[0]])
        count = np.concatenate([parse.count[cold], one[1]])
        doc = np.concatenate([parse.doc[cold], one[3]])
        route = np.concatenate([parse.trigger[cold], one[2]]) >> np.uint64(20)
        name = np.concatenate([parse.name[cold], one[2]])
        bucket = (route % np.uint64(n_phrases)).astype(np.int64)
        order = np.lexsort((start, name, bucket))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (name[order][1:] != name[order][:-1]) | (bucket[order][1:] != bucket[order][:-1])
        self.owner = ids[doc][order]
        self.start, self.count = start[order], count[order]
        self.entry = np.cumsum(fresh) - 1
        firsts = np.flatnonzero(fresh)
        self.least = np.minimum.reduceat(self.owner, firsts) if len(firsts) else np.zeros(0, np.int64)
        self.e_start, self.e_count, self.e_bucket = self.start[firsts], self.count[firsts], bucket[order][firsts]
        self.length, self.buf = parse.length, parse.buf

    def messages(self) -> Iterator[tuple[int, list[bytes]]]:
        for b in np.unique(self.e_bucket).tolist():
            i, j = np.searchsorted(self.e_bucket, b), np.searchsorted(self.e_bucket, b, "right")
            size = self.e_count[i:j] + self.length - 1
            text = self.buf[np.repeat(self.e_start[i:j], size) + _ramp(size)]
            yield b, [text.tobytes(), self.e_count[i:j].astype(np.uint16).tobytes(), _planes(self.least[i:j])]

    def removed(self, answers: dict[int, bytes]) -> np.ndarray:
        """Flags of the block's bytes that a string with an earlier occurrence covers."""
        bits = []
        for b in np.unique(self.e_bucket).tolist():
            i, j = np.searchsorted(self.e_bucket, b), np.searchsorted(self.e_bucket, b, "right")
            bits.append(np.unpackbits(np.frombuffer(answers[b], np.uint8), count=int(self.e_count[i:j].sum())).astype(bool))
        change = np.zeros(len(self.buf) + 1, np.int32)
        if bits:
            flags, at = np.concatenate(bits), np.cumsum(self.e_count) - self.e_count
            for i in range(0, len(self.start), 1 << 16):
                s = slice(i, i + (1 << 16))
                count, ramp = self.count[s], _ramp(self.count[s])
                gone = flags[np.repeat(at[self.entry[s]], count) + ramp] | np.repeat(self.owner[s] > self.least[self.entry[s]], count)
                start = (np.repeat(self.start[s], count) + ramp)[gone]
                np.add.at(change, start, 1)
                np.add.at(change, start + self.length, -1)
        return np.cumsum(change[:-1]) > 0


def _dense(x: np.ndarray) -> np.ndarray:
    """The rank of each number among the distinct ones."""
    order = np.argsort(x)
    rank = np.empty(len(x), np.int64)
    rank[order] = np.cumsum(np.concatenate([[False], x[order][1:] != x[order][:-1]]))
    return rank


def _dense_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The rank of each pair of ranks among the distinct pairs, by the first, then the second."""
    if len(a) > 1 << 21:
        return _dense(a << 32 | b)
    key = np.sort(a << 42 | b << 21 | np.arange(len(a)))  # the pair and its place in one number
    rank = np.empty(len(a), np.int64)
    rank[key & ((1 << 21) - 1)] = np.cumsum(np.concatenate([[False], key[1:] >> 21 != key[:-1] >> 21]))
    return rank


def suffix_ranks(words: np.ndarray, suffix: np.ndarray, length: int) -> np.ndarray:
    """The rank of each suffix among the distinct ones, as ordered by their first bytes.

    words has at each place the next eight bytes as a big-endian number; the last word taken ends
    with the length, and so overlaps the one before it.
    """
    rank = None
    for p in sorted({*range(0, length - 7, 8), length - 8}):
        w = _dense(words[suffix + p])
        rank = w if rank is None else _dense_pairs(rank, w)
    return rank


def repeated(messages: list[list[bytes]], length: int) -> list[bytes]:
    """For each message a bit for each string of its phrases: whether a lesser id than the phrase's has it."""
    text = np.frombuffer(b"".join(m[0] for m in messages), np.uint8)
    counts = [np.frombuffer(m[1], np.uint16).astype(np.int64) for m in messages]
    count, least = np.concatenate(counts), np.concatenate([_numbers(m[2], np.int64) for m in messages])
    start = np.cumsum(count + length - 1) - (count + length - 1)
    words = text.astype(np.uint64)
    for step in (1, 2, 4):
        words = words[:-step] << np.uint64(8 * step) | words[step:]
    # the dictionary: each distinct phrase once; a phrase is its first and its last string (they overlap)
    ends = [words[at + p] for at in (start, start + count - 1) for p in sorted({*range(0, length - 7, 8), length - 8})]
    name = count.astype(np.uint64)
    for w in ends:
        name = _mix((name ^ w) * np.uint64(_BASE))
    _, first, phrase = np.unique(name, return_index=True, return_inverse=True)
    like = first[phrase]
    other = count != count[like]
    for w in ends:
        other |= w != w[like]
    if other.any():  # a collision of names: such phrases stand for themselves
        phrase[other] = len(first) + np.arange(other.sum())
        first = np.append(first, np.flatnonzero(other))
    owner = np.full(len(first), NO_ID, np.int64)
    np.minimum.at(owner, phrase, least)
    size = count[first]
    rank = suffix_ranks(words, np.repeat(start[first], size) + _ramp(size), length)
    lowest = np.full(int(rank.max()) + 1, NO_ID, np.int64)
    np.minimum.at(lowest, rank, np.repeat(owner, size))
    lowest = lowest[rank]
    offset, out, i = np.cumsum(size) - size, [], 0
    for c in counts:
        mine = slice(i, i + len(c))
        out.append(np.packbits(lowest[np.repeat(offset[phrase[mine]], c) + _ramp(c)] < np.repeat(least[mine], c)).tobytes())
        i += len(c)
    return out


def dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    anchor: int = ANCHOR,
    keep: list[str] | None = None,
    with_text: bool = True,
    decode: bool = False,
    block_bytes: int = BLOCK_BYTES,
    bucket_bytes: tuple[int, int] = (TRIGGER_BYTES, PHRASE_BYTES),
    hot: int = HOT,
) -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans (maximal runs removed), kept_sha256, and with_text the
    remaining bytes (kept; with decode as a string, without what a cut has left of a character);
    keep names further columns that are passed on, unless they bear the name of a result."""
    if not 8 <= anchor < length < 1000:
        raise ValueError("8 <= anchor < length < 1000")
    results = (id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
    keep = [c for c in keep or [] if c not in results]
    blocks = make_blocks(docs, id_col, text, None, block_bytes, keep)
    n_triggers, n_phrases = (min(1 << 24, blocks.buckets(b)) for b in bucket_bytes)  # a key holds 24 bits of the bucket

    def parsed(batch: pa.RecordBatch, k: int) -> tuple[Parse, np.ndarray, np.ndarray, bytes]:
        ids, _, ends, data = texts(batch, k)
        return Parse(data, ends, length, anchor), ids, ends, data

    def ask_triggers(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, list[bytes]]]:
        parse, ids, _, _ = parsed(batch, k)
        return trigger_messages(parse, ids, n_triggers)

    def ask_phrases(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, list[bytes]]]:
        parse, ids, _, _ = parsed(batch, k)
        return Entries(parse, ids, replies(batch, k, "triggers"), n_triggers, n_phrases).messages()

    triggers = written(answer(send(blocks.df, ask_triggers, ["keys", "several", "sizes"]), lambda m: (shared_triggers(m, hot), [])), "triggers")
    known = with_replies(blocks.df, triggers, "triggers")
    phrases = answer(send(known, ask_phrases, ["text", "counts", "least"]), lambda m: (repeated(m, length), []))
    rest = blocks.df.schema["rest"].dataType.elementType.fields[1:]
    digest = [T.StructField(n, t()) for n, t in (("n_bytes", T.LongType), ("n_removed", T.LongType), ("n_spans", T.LongType), ("kept_sha256", T.StringType))]
    schema = T.StructType([T.StructField(id_col, T.LongType()), *digest, *([T.StructField("kept", T.StringType() if decode else T.BinaryType())] if with_text else []), *rest])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                parse, ids, ends, data = parsed(batch, k)
                gone = Entries(parse, ids, replies(batch, k, "triggers"), n_triggers, n_phrases).removed(replies(batch, k, "phrases"))
                buf, rows, start = parse.buf, [], 0
                for end in ends.tolist():
                    g = gone[start:end]
                    kept = buf[start:end][~g].tobytes()
                    rows.append((end - start, int(g.sum()), int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()), hashlib.sha256(kept).hexdigest(), kept if with_text else b""))
                    start = end
                cols = [pa.array([None if i == NO_ID else i for i in ids.tolist()], pa.int64()), *(pa.array([r[c] for r in rows], pa.int64()) for c in range(3)), pa.array([r[3] for r in rows], pa.string())]
                if with_text:
                    cols.append(pa.array([r[4].decode("utf-8", "ignore") for r in rows], pa.string()) if decode else pa.array([r[4] for r in rows], pa.binary()))
                extra = batch.column(batch.schema.get_field_index("rest"))[k].values
                cols += [extra.field(i + 1) for i in range(len(rest))]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return with_replies(known, phrases, "phrases").mapInArrow(finish, schema)
