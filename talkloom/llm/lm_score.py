"""Language-model scores: marginal likelihood over a subword lattice.

A unigram vocabulary gives the pieces. A word, with the mark of a word's start before it, is a lattice whose arcs
are the pieces it contains; the forward recursion, in log space, sums over all segmentations, so a word has its
marginal probability and not that of its best segmentation. A character that is no piece is spelled by its
bytes. The weights of the pieces start from the scores of the vocabulary file (where these are
negative ranks, as in BPE files, by Zipf's law of them) and are fitted to the training rows by expectation
maximisation: a round sums over distinct training words how often each piece is expected in the word's segmentations, and
the file's weights stay in as PRIOR pseudo-counts. There are two rounds, and each takes all words (PARTS).

A word that occurs in training has one more arc, for the whole of it, of weight (c - D) / N with its count c; what all
these arcs leave, D for each distinct word, is shared out by the pieces' lattice, so the words' marginals sum to one.
Texts come in kinds (languages, say): the model is a mixture of CLASSES components, each with its own
piece weights, word counts and number of texts; a component's words back off to those of all:
    P(word) = lattice of the component's pieces
    P0(word) = (max(c - D, 0) + D V P(word)) / N                    c, N, V: counts of all training rows
    Pk(word) = (max(ck - D, 0) + D Vk P0(word)) / Nk                ck, Nk, Vk: of the component's
A text's score is log10 of its marginal probability: the sum over components of share times product over
words, and its end, which counts as a word.

Training rows are dealt to components by a mixture of byte-pair distributions, which is fitted to all distinct training texts, whole.
Nothing is sampled: all counts, piece weights and shares too are those of all training rows.

Words are counted as rows: a block of documents (see blocks) gives one row for each distinct word in it (and component that
has it), so the rows grow with the table and a word that every text has costs a few rows a block. They are dealt
by word once, summed and scored there, once for each distinct word, and go back to their blocks. A word's log10 probabilities travel in units
of 1 / UNITS where they are in range, else as floats. Beside the model the plain word model is scored:
log10((c + 0.5) / (N + 0.5 (V + 1))) for each token.

Words: A-Z lower-cased, maximal runs of characters other than space and U+0009-U+000D. Defined
results: a null or empty text is an end alone. Long words cost linear time. Repeated rows count
each; equal texts score alike; columns other than id and text are not read, whatever their names. Without training rows c, N and V
are 0: the lattice with the file's weights gives the score (an end has END), and the base is log10(0.5 / 0.5) = 0 for each token.
An empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.llm.blocks import NO_ID, bucketed, make_blocks, texts
from talkloom.llm.common import received, share, small_batches, written

CLASSES = 6
#: Each round of the fit takes one in so many distinct words: all take all.
PARTS = (1, 1)
#: Rounds of the mixture's fit at most; components start from texts of at least so many byte pairs, where there are any.
ROUNDS, STEADY = 15, 200
#: Byte pairs whose sums travel in one row.
PAIRS_A_ROW = 1 << 12
#: Discount of a word's count; pseudo-counts of the file's weights, and of all components' weights in each one's; an end's probability when there is nothing to learn from.
D, PRIOR, POOLED, END = 0.75, 100.0, 100.0, 0.001
#: Texts are dealt in blocks of this size; the larger, the fewer rows a word has.
BLOCK_BYTES = 8 << 20
#: Steps of log10 in which probabilities travel.
UNITS = 2000
_LN10 = log(10)
_CELLS = 1 << 18  # places of words in one step
LOWEST = -1e30
#: The least log of a probability that is kept as it is in sums; those of longer words are logs.
FAR = -600.0
_BASE = 0x9E3779B97F4A7C15


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def numbers() -> defaultdict[bytes, int]:
    """Numbers words from 0 as they are first asked for."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    return number


def numbered(words: list[bytes], number: defaultdict[bytes, int]) -> np.ndarray:
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


class Vocabulary:
    """pieces: their numbers, of which those that start a word begin with U+2581; weight: theirs, and that of
    a byte (each of the 256 alike), summing to 1 with all bytes."""

    def __init__(self, pieces: dict[str, float], byte: float):
        self.number = {p: k for k, p in enumerate(pieces)}
        total = sum(pieces.values()) + 256 * byte
        self.weight = np.array([*pieces.values(), byte]) / total
        self.longest = max(map(len, pieces), default=1)

    @classmethod
    def from_sentencepiece(cls, path: str) -> Vocabulary:
        """From a vocabulary file. Negative ranks (BPE) weigh one over rank plus 2.7; log probabilities (unigram) as they stand."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        rows = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        ranked = all(s == int(s) for _, s in rows)
        weight = {p: 1 / (2.7 - s) if ranked else float(np.exp(s)) for p, s in rows}
        return cls(weight, min(weight.values(), default=1.0))

    def tables(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length the hashes of pieces' beginnings, sorted, and the numbers of those that are pieces (else -1)."""
        if not hasattr(self, "_tables"):
            by: list[dict[int, int]] = [{} for _ in range(self.longest + 1)]
            for p, k in self.number.items():
                h = 0
                for n, ch in enumerate(p, 1):
                    h = (h * _BASE + ord(ch) + 1) & ((1 << 64) - 1)
                    by[n].setdefault(h, -1)
                if p:
                    by[len(p)][h] = k
            self._tables = [(np.array(sorted(x), np.uint64), np.array([x[h] for h in sorted(x)], np.int64)) for x in by]
        return self._tables

    def arcs(self, words: list[str]) -> np.ndarray:
        """A column for each arc: word, start, end, piece (the last number: bytes), bytes. Pieces are found by 64-bit hashes."""
        joined = "".join(["▁" + w for w in words])
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        sizes = np.array([len(w) + 1 for w in words], np.int64)
        first = np.cumsum(sizes) - sizes
        word = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(codes)) - first[word]
        left = sizes[word] - place  # characters from a place to its word's end
        at, h, out = np.arange(len(codes)), np.zeros(len(codes), np.uint64), []
        for n, (hashes, numbers) in enumerate(self.tables()):
            if not n:
                continue
            keep = left[at] >= n
            at, h = at[keep], h[keep]
            h = h * np.uint64(_BASE) + codes[at + n - 1] + np.uint64(1)
            number = np.full(len(at), -1)
            begins = np.zeros(len(at), bool)
            if len(hashes):
                k = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                begins = hashes[k] == h
                number[begins] = numbers[k[begins]]
                hit = at[number >= 0]
                out.append(np.stack([word[hit], place[hit], place[hit] + n, number[number >= 0], np.ones(len(hit), np.int64)]))
            if n == 1:
                miss = at[number < 0]
                c = codes[miss]
                size = 1 + (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c >= 0x10000)
                out.append(np.stack([word[miss], place[miss], place[miss] + 1, np.full(len(miss), len(self.number)), size]))
            at, h = at[begins], h[begins]  # no piece is longer there
        return np.concatenate(out, axis=1)


def _sum(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Log of the sums of exponentials of groups of rows; LOWEST stands for what no way reaches."""
    top = np.maximum.reduceat(x, starts, axis=0)
    size = np.diff(np.append(starts, len(x)))
    return top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, size, axis=0)), starts, axis=0))


def _sweep(word: np.ndarray, source: np.ndarray, target: np.ndarray, score: np.ndarray, table: np.ndarray, plain: bool) -> None:
    """Fills table[target, word] by the recursion; arcs are in the order in which targets are reached, then by word."""
    cut = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
    for a, b in zip(cut, [*cut[1:], len(target)]):
        w = word[a:b]
        starts = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        before = table[source[a:b], w]
        table[target[a], w[starts]] = np.add.reduceat(before * score[a:b], starts, axis=0) if plain else _sum(before + score[a:b], starts)


def _in_order(word: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The order by place, then word; numbers of 16 bits are sorted in linear time."""
    if len(place) and place.max() < 1 << 15:
        by_word = np.argsort(word.astype(np.int16), kind="stable")  # words of one step are few
        return by_word[np.argsort(place[by_word].astype(np.int16), kind="stable")]
    return np.lexsort((word, place))


def _table(ends: np.ndarray, like: np.ndarray, plain: bool) -> np.ndarray:
    """By place, word and component, if there are several: what no way reaches."""
    return np.full((ends.max() + 1, len(ends), *like.shape[1:]), 0.0 if plain else LOWEST)


def _is_plain(arcs: np.ndarray, least: np.ndarray) -> bool:
    """Whether probabilities of all words can be added as they are: each has its way by single characters, and the least of these is far from underflow.

    least: of the logs of each piece's weights.
    """
    one = np.flatnonzero(arcs[2] - arcs[1] == 1)
    return np.bincount(arcs[0][one], least[arcs[3][one]] * arcs[4][one]).min(initial=0) > FAR


def _forward(arcs: np.ndarray, score: np.ndarray, ends: np.ndarray, plain: bool) -> np.ndarray:
    """All ways from a word's start to each of its places (arcs: in that order), by place, word and component: their probability if plain, else its log, as the score of the arcs."""
    table = _table(ends, score, plain)
    table[0] = 1 if plain else 0
    _sweep(*arcs[:3], score, table, plain)
    return table


def _steps(words: list[str]) -> Iterator[list[int]]:
    """The numbers of words of about equal length, in bounded numbers."""
    order = sorted(range(len(words)), key=lambda k: len(words[k]))
    at = 0
    while at < len(order):
        n = max(1, min(8192, _CELLS // (len(words[order[at]]) + 8)))
        yield order[at : at + n]
        at += n


def marginals(vocabulary: Vocabulary, words: list[str], logs: np.ndarray) -> np.ndarray:
    """Natural logs of the words' marginal probabilities by component (logs: of the pieces' weights, by piece and component)."""
    out = np.zeros((len(words), logs.shape[1]))
    least, weights = logs.min(1), np.exp(logs)
    for some in _steps(words):
        ends = np.array([len(words[k]) + 1 for k in some])
        arcs = vocabulary.arcs([words[k] for k in some])
        plain = _is_plain(arcs, least)
        arcs = arcs[:, _in_order(arcs[0], arcs[2])]
        if plain:
            score, more = weights[arcs[3]], np.flatnonzero(arcs[4] > 1)
            score[more] **= arcs[4][more, None]
        else:
            score = logs[arcs[3]] * arcs[4][:, None]
        got = _forward(arcs, score, ends, plain)[ends, np.arange(len(some))]
        out[some] = np.log(got) if plain else got
    return out


def expected(vocabulary: Vocabulary, words: list[str], logs: np.ndarray, present: np.ndarray) -> np.ndarray:
    """How often each piece is expected in the segmentations of the words that a component has (present: by word and component)."""
    k, out, least = logs.shape[1], np.zeros(logs.size), logs.min(1)
    which, kinds = np.nonzero(present)
    words = [words[i] for i in which.tolist()]  # once for each component that has it
    for some in _steps(words):
        ends, kind = np.array([len(words[i]) + 1 for i in some]), kinds[some]
        arcs = vocabulary.arcs([words[i] for i in some])
        arcs = arcs[:, _in_order(arcs[0], arcs[2])]
        w, i, j, q, size = arcs
        cell = q * k + kind[w]
        score = logs.ravel()[cell] * size
        plain = _is_plain(arcs, least)
        score = np.exp(score) if plain else score
        forward = _forward(arcs, score, ends, plain)
        backward = _table(ends, score, plain)
        rows = np.arange(len(ends))
        backward[ends, rows] = 1 if plain else 0
        order = _in_order(w, ends.max() - i)
        _sweep(w[order], j[order], i[order], score[order], backward, plain)
        total = forward[ends, rows][w]
        post = forward[i, w] * score * backward[j, w] / total if plain else np.exp(forward[i, w] + score + backward[j, w] - total)
        out += np.bincount(cell, post * size, len(out))
    return out.reshape(logs.shape)


@dataclass
class Kinds:
    """A mixture of byte-pair distributions: log probabilities by pair and component, and log shares."""

    table: np.ndarray
    share: np.ndarray

    def of(self, text: bytes) -> int:
        total = self.share.astype(np.float64).copy()
        for i in range(0, max(1, len(text)), 1 << 14):
            total += np.einsum("ij->j", np.take(self.table, pairs(text[i : i + (1 << 14) + 1]), axis=0))  # faster than sum(0), the same sums
        return int(total.argmax())


def pairs(text: bytes) -> np.ndarray:
    b = np.frombuffer(text, np.uint8).astype(np.int64)
    return b[:-1] << 8 | b[1:]


def _pair_counts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The distinct byte pairs of a text, and how often each occurs."""
    if len(text) < 1 << 16:
        return np.unique(pairs(text.lower()), return_counts=True)
    total = np.zeros(1 << 16, np.int64)
    for i in range(0, len(text) - 1, 1 << 20):
        total += np.bincount(pairs(text[i : i + (1 << 20) + 1].lower()), minlength=1 << 16)
    found = np.flatnonzero(total)
    return found, total[found]


class _Texts:
    """Byte pairs of some texts: fit, members and farthest are those of fit_kinds, for these texts."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]]):
        self._set(np.concatenate([p for p, _ in counts]), np.concatenate([n for _, n in counts]), np.array([len(p) for p, _ in counts]))

    def _set(self, pair: np.ndarray, n: np.ndarray, sizes: np.ndarray) -> None:
        self.pair, self.n, self.sizes = pair, n.astype(np.float64), sizes
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.length = np.add.reduceat(self.n, self.starts)

    @classmethod
    def of(cls, pair: np.ndarray, n: np.ndarray, sizes: np.ndarray) -> _Texts:
        """From all texts' pairs and counts one after another, and how many each has."""
        out = cls.__new__(cls)
        out._set(pair, n, sizes)
        return out

    def fit(self, tables: np.ndarray) -> np.ndarray:
        """The mean log probability of each text's pairs (tables: by pair and component)."""
        return np.stack([np.add.reduceat(column[self.pair] * self.n, self.starts) for column in np.ascontiguousarray(tables.T)], axis=1) / self.length[:, None]

    def members(self, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of pairs of each component's texts, by pair and component, and its number of texts."""
        k = tables.shape[1]
        kind = self.fit(tables).argmax(1)
        sums = np.bincount(self.pair * k + np.repeat(kind, self.sizes), self.n, k << 16).reshape(1 << 16, k)
        return sums, np.bincount(kind, minlength=k)

    def farthest(self, back: np.ndarray, tables: np.ndarray, least: int) -> tuple[float, int]:
        """How much better the first such text of at least so many pairs would be alone, and its place; the one that the components so far suit least."""
        fit = self.fit(np.column_stack([back, tables]))
        gain = np.where(self.length >= least, fit[:, 0] - fit[:, 1:].max(1), -np.inf)
        return float(gain.max()), int(gain.argmax())


def _kinds(total: np.ndarray, n_texts: int, first: Callable, farthest: Callable, members: Callable, classes: int, rounds: int) -> Kinds:
    """By hard expectation maximisation from texts far from one another; the functions ask all texts."""
    if not n_texts:
        return Kinds(np.zeros((1 << 16, 1), np.float32), np.zeros(1))
    back = (total + 0.1) / (total + 0.1).sum()

    def logs(sums: np.ndarray) -> np.ndarray:
        sums = sums + back[:, None] * 2000
        return np.log(sums / sums.sum(0))

    def alone(counts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        sums = np.zeros((1 << 16, 1))
        sums[counts[0], 0] = counts[1]
        return logs(sums)

    tables = alone(first())
    while tables.shape[1] < min(classes, n_texts):
        tables = np.column_stack([tables, alone(farthest(np.log(back), tables))])
    before = None
    for _ in range(rounds):
        sums, size = members(tables)
        if before is not None and (sums == before).all():
            break
        before, tables = sums, logs(sums)
    return Kinds(tables.astype(np.float32), np.log((size + 1) / (size + 1).sum()))


def fit_kinds(texts: list[bytes], classes: int = CLASSES, rounds: int = ROUNDS) -> Kinds:
    """The mixture of a list of texts (see fit_kinds_of)."""
    counts = [c for c in map(_pair_counts, texts) if len(c[0])]
    if not counts:
        return _kinds(np.zeros(1 << 16), 0, None, None, None, classes, rounds)
    mine = _Texts(counts)
    least = STEADY if (mine.length >= STEADY).any() else 1
    total = np.bincount(mine.pair, mine.n, 1 << 16)
    return _kinds(total, len(counts), lambda: counts[int((mine.length >= least).argmax())], lambda b, t: counts[mine.farthest(b, t, least)[1]], mine.members, classes, rounds)


def fit_kinds_of(docs: DataFrame, classes: int = CLASSES, rounds: int = ROUNDS) -> Kinds:
    """The mixture of all distinct texts, whole; docs has t (their bytes) and h (their hash, by which they are ordered).

    A text's pairs are counted once and written; each step of the fit is a job over all of them, whose tasks send sums.
    """
    spark = docs.sparkSession
    small_batches(spark, rows=2048, size=2 << 20)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            rows = []
            for h, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                if h not in seen:
                    seen.add(h)
                    p, n = _pair_counts(t.as_py())
                    if len(p):
                        rows.append((h, int(n.sum()), p.astype(np.uint16).tobytes(), n.astype(np.uint8 if n.max() < 256 else np.int64).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["h", "n", "pairs", "counts"])

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            h = batch.column(0).to_pylist()
            keep = [a != b for a, b in zip(h, [last, *h])]
            last = h[-1] if h else last
            yield batch.filter(pa.array(keep, pa.bool_()))

    schema = "h long, n long, pairs binary, counts binary"
    sent = docs.select("h", "t").mapInArrow(count, schema)
    texts = written(sent.repartition("h").sortWithinPartitions("h").mapInArrow(once, schema), "pairs")
    read = lambda p, n: (np.frombuffer(p, np.uint16).astype(np.int64), np.frombuffer(n, np.uint8 if 2 * len(n) == len(p) else np.int64))

    def asked(ask: Callable, found: str) -> DataFrame:
        """What ask makes of a task's batches of texts, each with their hashes."""

        def side_by_side(batch: pa.RecordBatch) -> _Texts:
            p, n = batch.column(2), batch.column(3)
            sizes, widths = (pc.binary_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (p, n))
            if (2 * widths == sizes).all() and p.offset == n.offset == 0:  # bytes each
                return _Texts.of(np.frombuffer(p.buffers()[2], np.uint16, sizes.sum() // 2).astype(np.int64), np.frombuffer(n.buffers()[2], np.uint8, widths.sum()), widths)
            return _Texts([read(x.as_py(), y.as_py()) for x, y in zip(p, n)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from ask((batch.column(0).to_pylist(), side_by_side(batch)) for batch in batches if batch.num_rows)

        return texts.mapInArrow(run, found)

    def summed(tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = tables.shape[1]
        shared = share(spark, tables)

        def ask(some: Iterator[tuple[list[int], _Texts]]) -> Iterator[pa.RecordBatch]:
            now, sums, size = received(shared), np.zeros((1 << 16, k)), np.zeros(k)
            for _, t in some:
                got = t.members(now)
                sums, size = sums + got[0], size + got[1]
            every = np.vstack([sums, size])  # the last row: numbers of texts
            for first in range(0, len(every), PAIRS_A_ROW):
                part = every[first : first + PAIRS_A_ROW]
                rows = np.flatnonzero(part.any(1))
                if len(rows):
                    cols = [pa.array([first], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (rows.astype(np.uint16), part[rows]))]
                    yield pa.RecordBatch.from_arrays(cols, names=["first", "rows", "sums"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, part = None, np.zeros((PAIRS_A_ROW, k))
            row = lambda: pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["first", "sums"])
            for batch in batches:
                for first, rows, sums in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                    if first != last:
                        if last is not None:
                            yield row()
                        last, part = first, np.zeros((PAIRS_A_ROW, k))
                    part[np.frombuffer(rows.as_py(), np.uint16)] += np.frombuffer(sums.as_py()).reshape(-1, k)
            if last is not None:
                yield row()

        sent = asked(ask, "first int, rows binary, sums binary").repartition("first").sortWithinPartitions("first")
        out = np.zeros((-(-((1 << 16) + 1) // PAIRS_A_ROW) * PAIRS_A_ROW, k))
        for r in sent.mapInArrow(add, "first int, sums binary").collect():  # of all pairs, whatever the number of texts
            out[r["first"] : r["first"] + PAIRS_A_ROW] = np.frombuffer(r["sums"]).reshape(-1, k)
        shared.destroy()
        return out[: 1 << 16], out[1 << 16].astype(np.int64)

    def text(h: int) -> tuple[np.ndarray, np.ndarray]:
        r = texts.where(F.col("h") == h).first()
        return read(bytes(r["pairs"]), bytes(r["counts"]))

    known = texts.agg(F.count("*").alias("n"), F.min("h").alias("any"), F.min(F.when(F.col("n") >= STEADY, F.col("h"))).alias("steady")).first()
    least = 1 if known["steady"] is None else STEADY

    def farthest(back: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shared = share(spark, (back, tables))

        def ask(some: Iterator[tuple[list[int], _Texts]]) -> Iterator[pa.RecordBatch]:
            b, now = received(shared)
            best = [(-gain, hashes[at]) for hashes, t in some for gain, at in [t.farthest(b, now, least)]]
            if best:
                gain, h = min(best)
                yield pa.RecordBatch.from_arrays([pa.array([-gain]), pa.array([h], pa.int64())], names=["gain", "h"])

        h = asked(ask, "gain double, h long").orderBy(F.desc("gain"), "h").first()["h"]
        shared.destroy()
        return text(h)

    total = summed(np.zeros((1 << 16, 1)))[0][:, 0] if known["n"] else np.zeros(1 << 16)
    return _kinds(total, known["n"], lambda: text(known["any"] if known["steady"] is None else known["steady"]), farthest, summed, classes, rounds)


def score(
    docs: DataFrame, vocabulary: Vocabulary, train: Column, id_col: str = "doc_id", text: str = "text", classes: int = CLASSES, parts: tuple[int, ...] = PARTS, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score and score; train marks the rows to learn from."""
    spark = docs.sparkSession
    train = F.coalesce(train, F.lit(True))
    mine = docs.where(train & F.col(text).isNotNull()).select(F.encode(F.col(text), "UTF-8").alias("t"), F.xxhash64(F.col(text)).alias("h"))
    kinds = fit_kinds_of(mine, classes)
    k = len(kinds.share)
    blocks = make_blocks(docs, id_col, text, train, block_bytes)
    shared, kinds_shared = share(spark, vocabulary), share(spark, kinds)  # both grow with the vocabulary or not at all
    columns = [f"c{i}" for i in range(k)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = received(kinds_shared)
        for batch in batches:
            for r in range(batch.num_rows):
                _, learns, ends, data = texts(batch, r)
                number, found = numbers(), [[np.zeros(0, np.int64)] for _ in range(k)]
                n_docs, start = np.zeros(k, np.int64), 0
                for learn, end in zip(learns.tolist(), ends.tolist()):
                    lower = data[start:end].lower()
                    at = numbered(lower.split(), number)
                    if learn:
                        kind = told.of(lower)
                        found[kind].append(at.astype(np.int32))
                        n_docs[kind] += 1
                    start = end
                block = batch.column(batch.schema.get_field_index("block"))[r].as_py()
                # an empty word stands for the ends of training texts; it has no place among the block's words
                cols = [pa.array([b""] * k, pa.binary()), pa.array(np.full(k, block)), pa.array(np.full(k, -1, np.int32)), pa.array(np.arange(k, dtype=np.int16)), pa.array(n_docs)]
                yield pa.RecordBatch.from_arrays(cols, names=["word", "block", "place", "kind", "n"])
                seen, asked = list(number), np.zeros(len(number), bool)
                for kind in range(k + 1):  # the last one: words that no training text has
                    if kind < k:
                        counts = np.bincount(np.concatenate(found[kind]), minlength=len(seen))
                        found[kind] = []
                        at = np.flatnonzero(counts)
                        place = np.where(asked[at], -1, at)  # asked for once
                        asked[at] = True
                    else:
                        place = at = np.flatnonzero(~asked)
                        counts = np.zeros(len(seen), np.int64)
                    for a in range(0, len(at), 1 << 16):
                        cut = at[a : a + (1 << 16)]
                        word, size = pa.array([seen[i] for i in cut.tolist()], pa.binary()), len(cut)
                        cols = [word, pa.array(np.full(size, block)), pa.array(place[a : a + (1 << 16)].astype(np.int32)), pa.array(np.full(size, kind % k, np.int16)), pa.array(counts[cut])]
                        yield pa.RecordBatch.from_arrays(cols, names=["word", "block", "place", "kind", "n"])

    sent = blocks.df.mapInArrow(count, "word binary, block long, place int, kind short, n long")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-blocks.n_bytes // (4 * block_bytes)))
    seen = bucketed(sent.repartition(buckets, "word"), "word", buckets, "words")
    words = written(seen.groupBy("word").agg(*[F.sum(F.when(F.col("kind") == i, F.col("n")).otherwise(0)).alias(c) for i, c in enumerate(columns)]), "words")
    total = sum((F.col(c) for c in columns), F.lit(0))
    sums = words.agg(*[F.sum(c).alias(c) for c in columns], *[F.count_if(F.col(c) > 0).alias("v" + c) for c in columns], F.count_if(total > 0).alias("v")).first()
    n_k, v_k = (np.array([sums[p + c] or 0 for c in columns], np.float64) for p in ("", "v"))
    n, v = int(n_k.sum()), int(sums["v"] or 0)
    ends = words.where(F.length("word") == 0).select(*columns).first()
    ends_k = np.array(list(ends) if ends else [0] * k, np.float64)
    prior = np.log(ends_k + 1) - np.log(ends_k.sum() + k)

    logs = np.repeat(np.log(vocabulary.weight)[:, None], k, axis=1)
    small_batches(spark, rows=8192, size=2 << 20)  # of words; those of blocks have one each
    known = words.where((total > 0) & (F.length("word") > 0)).select("word", *columns)
    for part in parts if v else ():
        logs_shared = share(spark, logs)

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocab, now, out = received(shared), received(logs_shared), None
            for batch in batches:
                present = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], axis=1) > 0  # a distinct word counts once
                got = expected(vocab, [w.as_py().decode() for w in batch.column(0)], now, present)
                out = got if out is None else out + got
            if out is not None:
                rows = np.flatnonzero(out.sum(1))
                yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), *(pa.array(out[rows, i]) for i in range(k))], names=["piece", *columns])

        sent = known.where(F.crc32("word") % part == 0).mapInArrow(expect, "piece int, " + ", ".join(f"{c} double" for c in columns))
        got = sent.groupBy("piece").agg(*[F.sum(c).alias(c) for c in columns]).orderBy("piece").toArrow()  # at most a row for each piece
        logs_shared.destroy()
        found = np.zeros_like(logs)
        if got.num_rows:
            found[got.column(0).to_numpy()] = np.stack([got.column(1 + i).to_numpy() for i in range(k)], axis=1)
        pooled = found.sum(1) + PRIOR * vocabulary.weight * np.append(np.ones(len(vocabulary.weight) - 1), 256)
        found += POOLED * (pooled / pooled.sum())[:, None]
        found /= found.sum(0)
        found[-1] /= 256  # one of the bytes
        logs = np.log(found)
    logs_shared = share(spark, logs)

    def word_logs(counts: np.ndarray, lattice: np.ndarray) -> np.ndarray:
        """log10 Pk of words, from their counts by component and the logs of their lattices (minus infinity: an end)."""
        if not n:
            return np.where(np.isinf(lattice), np.log10(END), lattice / _LN10 + np.log10(1 - END))
        c = counts.sum(1, keepdims=True)
        with np.errstate(divide="ignore"):
            p0 = np.logaddexp(np.log(np.maximum(c - D, 0)), np.log(D * v) + lattice) - np.log(n)
            pk = np.logaddexp(np.log(np.maximum(counts - D, 0)), np.log(D * v_k) + p0) - np.log(np.maximum(n_k, 1))
        return np.where(n_k > 0, pk, p0) / _LN10

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, now = received(shared), received(logs_shared)
        for batch in batches:
            counts = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], axis=1).astype(np.float64)
            names = [w.as_py() for w in batch.column(0)]
            lattice = marginals(vocab, [w.decode() for w in names], now)
            lattice[[i for i, w in enumerate(names) if not w]] = -np.inf
            out = word_logs(counts, lattice).astype(np.float32)
            short = np.rint(out * UNITS)
            packed = [s.astype(np.int16).tobytes() if fits else x.tobytes() for x, s, fits in zip(out, short, (short > -32768).all(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts.sum(1).astype(np.int64)), pa.array(packed, pa.binary())], names=["word", "n", "logs"])

    scored = words.select("word", *columns).mapInArrow(tell, "word binary, n long, logs binary")
    scored = scored.withColumnRenamed("word", "word2").hint("shuffle_hash")
    asked = seen.where("place >= 0").select("word", "block", "place")
    answers = asked.join(scored, F.col("word") == F.col("word2")).select("block", "place", "n", "logs")
    by_block = answers.groupBy(F.col("block").alias("_block")).agg(F.collect_list(F.struct("place", "n", "logs")).alias("answers"))
    told = blocks.df.join(by_block.hint("shuffle_hash"), blocks.df.block == by_block["_block"], "left").drop("_block")
    end_logs = word_logs(ends_k[None, :], np.full((1, k), -np.inf))[0]
    base_of = lambda c: np.log10(c + 0.5) - np.log10(n + 0.5 * (v + 1))
    n_ends = int(ends_k.sum())

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids, learns, ends_at, data = texts(batch, r)
                got = batch.column(batch.schema.get_field_index("answers"))[r].values
                place = np.zeros(0, np.int64) if got is None else got.field(0).to_numpy(zero_copy_only=False)
                size = int(place.max(initial=-1)) + 1
                counts, each = np.zeros(size, np.int64), np.zeros((size, k))
                if size:
                    counts[place] = got.field(1).to_numpy(zero_copy_only=False)
                    packed = got.field(2)
                    wide = pc.binary_length(packed).to_numpy(zero_copy_only=False) == 4 * k
                    for rows, kind, unit in ((~wide, np.int16, UNITS), (wide, np.float32, 1)):
                        if rows.any():
                            some = packed.filter(pa.array(rows))  # of one width, so their bytes lie side by side
                            each[place[rows]] = np.frombuffer(some.buffers()[2], kind, len(some) * k).reshape(-1, k) / unit
                base, seen_before = base_of(counts), counts > 0
                number, rows, start = numbers(), [], 0
                for end in ends_at.tolist():
                    at = numbered(words_of(data[start:end]), number)
                    by_kind = each[at].sum(0) + end_logs + prior / _LN10
                    top = by_kind.max()
                    rows.append((len(at) + 1, int(seen_before[at].sum()) + (n_ends > 0), float(base[at].sum() + base_of(n_ends)), float(top + np.log10((10 ** (by_kind - top)).sum()))))
                    start = end
                cols = [pa.array([None if i == NO_ID else i for i in ids.tolist()], pa.int64()), pa.array(~learns), *(pa.array([x[c] for x in rows], pa.int64()) for c in (0, 1))]
                cols += [pa.array([n] * len(rows), pa.int64()), *(pa.array([x[c] for x in rows], pa.float64()) for c in (2, 3))]
                yield pa.RecordBatch.from_arrays(cols, names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = f"`{id_col}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return told.mapInArrow(finish, schema)
