"""Spelling variants: words that one inserted, deleted or replaced letter tells apart, grouped under the commonest.

A near word of w agrees with it before the edited letter and after it. So for each place in w the near words are
those in two intervals at once: of the words sorted, those that begin as w does; of the words sorted
by their reverse, those that end as w does. With a word's places in both orders as a point, they are the points in a rectangle.
A wavelet matrix over the points, in numpy, reports them for many words and places at a time.

Words are counted by Spark and dealt to groups by what the edit leaves alone: an edit in the first half of a word leaves the second
half, and the other way round. A group has all words of length M that share that half ("long", points and queries for
replacements) and the words of length M-1 that share it ("short", queries for insertions; each pair is told to both words).
A group of more than GROUP rows is dealt again, by a half of the part that was free beside what was fixed, until the free
part is one letter; every pair still meets in exactly one group. A task holds some groups at a time.

A word's form is its commonest near word (ties: the smallest in code-point order), if it is RATIO times as common. Forms of forms
lead to the root; as counts grow by the ratio with each step, pointers that double reach it in a few joins.

Defined results: null texts have no words; a null id stands as an empty one where ids are used; long texts and long words are
treated whole; repeated rows count each time; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.llm.common import ascii_lower, small_batches, written

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LETTERS, LEAST_COUNT, RATIO = 7, 2, 10
#: Rows of a group beyond which it is dealt again, and rows that a task treats at a time (and the groups that they cut).
GROUP, CHUNK = 50_000, 100_000
KEY = ["m", "i", "j", "fixed"]


def count_words(docs: DataFrame, change: Callable[[Column, Column], Column] | None = None, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n of the runs of letters, A-Z lower-cased, that are long and common enough. change: what becomes of an id's word, before that is judged; it may not grow."""
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"[{LETTERS}]{{{least_letters},}}"), F.lit(0))
    runs = docs.select("doc_id", F.explode(found).alias("run"))
    low = runs.select("doc_id", F.when(F.octet_length("run") == F.char_length("run"), F.lower("run")).otherwise(ascii_lower(F.col("run"))).alias("word"))
    if change is not None:
        low = low.select(change(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("word")).alias("word")).where(F.char_length("word") >= least_letters)
    return low.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _fixed(word: Column, m: Column, i: Column, j: Column) -> Column:
    """What a word has outside the free part i..j of words of m letters; a word of m-1 letters has one letter less in it."""
    rest = F.when(F.char_length(word) == m, j + 1).otherwise(j)
    return F.concat(F.substring(word, F.lit(1), i), F.lit("\0"), F.substring(word, rest, F.char_length(word)))


def _dealt(words: DataFrame, ranges: Column) -> DataFrame:
    """word, n and a group's key for each range (m, i, j)."""
    r = words.select("word", "n", F.explode(ranges).alias("r")).select("word", "n", "r.m", "r.i", "r.j")
    return r.withColumn("fixed", _fixed(F.col("word"), F.col("m"), F.col("i"), F.col("j")))


def _ranges(*parts: tuple[Column, Column, Column]) -> Column:
    return F.array(*[F.struct(m.cast("int").alias("m"), i.cast("int").alias("i"), j.cast("int").alias("j")) for m, i, j in parts])


def grouped(words: DataFrame, limit: int = GROUP) -> DataFrame:
    """word, n, m, i, j, fixed: four rows for each word, more for those in crowded groups."""
    n = F.char_length("word")
    half = lambda m: F.floor(m / 2)
    now = _dealt(words, _ranges(*[x for m in (n, n + 1) for x in ((m, F.lit(0), half(m)), (m, half(m), m))]))
    done: DataFrame | None = None
    while True:
        crowded = written(now.groupBy(*KEY).agg(F.count("*").alias("c")).where((F.col("c") > limit) & (F.col("j") - F.col("i") > 1)).select(*KEY), "crowded-words")
        if crowded.isEmpty():
            return now if done is None else done.unionByName(now)
        calm = now.join(crowded, KEY, "left_anti")
        done = calm if done is None else done.unionByName(calm)
        mid = half(F.col("i") + F.col("j"))
        now = written(_dealt_again(now.join(crowded, KEY, "left_semi"), mid), "dealt-words")


def _dealt_again(rows: DataFrame, mid: Column) -> DataFrame:
    return _dealt(rows.withColumn("again", _ranges((F.col("m"), F.col("i"), mid), (F.col("m"), mid, F.col("j")))).select("word", "n", "again"), F.col("again"))


class Wavelet:
    """Range reporting over a permutation: where x1 <= place < x2, the values with y1 <= value < y2."""

    def __init__(self, values: np.ndarray):
        self.bits = max(int(len(values) - 1).bit_length(), 1)
        self.zeros: list[np.ndarray] = []  # before each place, how many values have a 0 in this bit
        for b in reversed(range(self.bits)):
            bit = (values >> b) & 1
            self.zeros.append(np.concatenate([[0], np.cumsum(1 - bit)]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def report(self, x1: np.ndarray, x2: np.ndarray, y1: np.ndarray, y2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each point found, the number of its query and its value."""
        query, low, high, base = np.arange(len(x1)), x1, x2, np.zeros(len(x1), np.int64)
        for zeros, b in zip(self.zeros, reversed(range(self.bits))):
            l0, r0 = zeros[low], zeros[high]
            ones = zeros[-1]
            sides = []
            for lo, hi, at in ((l0, r0, base), (ones + low - l0, ones + high - r0, base + (1 << b))):
                ok = (lo < hi) & (at < y2[query]) & (at + (1 << b) > y1[query])
                sides.append((query[ok], lo[ok], hi[ok], at[ok]))
            query, low, high, base = (np.concatenate(z) for z in zip(*sides))
        return query, base


def _intervals(lcp: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each place in an order, where the stretch begins and ends whose members agree in so many letters."""
    cut = lcp < depth
    heads = np.flatnonzero(cut)
    of = np.cumsum(cut) - 1
    return heads[of], np.append(heads[1:], len(lcp))[of]


def _order(letters: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by group and letters; how many letters each has in common with the one before it, -1 in a new group."""
    order = np.lexsort((*letters.T[::-1], group))
    lcp = np.full(len(order), -1)
    a, b = letters[order[1:]], letters[order[:-1]]
    same = a == b
    lcp[1:] = np.where(group[order[1:]] == group[order[:-1]], np.where(same.all(1), letters.shape[1], same.argmin(1)), -1)
    return order, lcp


def near_pairs(middles: list[str], long: np.ndarray, group: np.ndarray, m: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Queries, points and the place of the edit: long middles have m letters, short ones m-1; points are long ones of the group
    that equal the query beside that place. All groups have the same m here."""
    n = len(middles)
    letters = np.array(middles, f"U{m}").view(np.int32).reshape(n, m)
    back = letters[:, ::-1].copy()
    back[~long] = np.roll(back[~long], -1, axis=1)  # the pad stays at the end
    forward, lcp_f = _order(letters, group)
    reverse, lcp_r = _order(back, group)
    points_f, points_r = np.concatenate([[0], np.cumsum(long[forward])]), np.concatenate([[0], np.cumsum(long[reverse])])
    by_reverse = reverse[long[reverse]]
    rank = np.empty(n, np.int64)
    rank[by_reverse] = np.arange(len(by_reverse))
    tree = Wavelet(rank[forward[long[forward]]])
    place_f, place_r = np.empty(n, np.int64), np.empty(n, np.int64)
    place_f[forward] = place_r[reverse] = np.arange(n)
    others = np.where(long, 2, 1)  # a long one finds itself
    for e in range(m):
        lo, hi = _intervals(lcp_f, e)
        x1, x2 = points_f[lo][place_f], points_f[hi][place_f]
        lo, hi = _intervals(lcp_r, m - 1 - e)
        y1, y2 = points_r[lo][place_r], points_r[hi][place_r]
        asks = np.flatnonzero((x2 - x1 >= others) & (y2 - y1 >= others))
        if len(asks):
            query, value = tree.report(x1[asks], x2[asks], y1[asks], y2[asks])
            q, p = asks[query], by_reverse[value]
            yield q[q != p], p[q != p], e


def _tell(words: pa.Array, n: np.ndarray, m: np.ndarray, i: np.ndarray, j: np.ndarray, group: np.ndarray) -> pa.RecordBatch | None:
    """For each word with near words in these groups: how many, and the best of them with its count."""
    size, long = np.bincount(group), (pc.utf8_length(words).to_numpy(zero_copy_only=False) == m)
    some = (size[group] > 1) & (np.bincount(group, long)[group] > 0)
    keep = np.flatnonzero(some)
    if not len(keep):
        return None
    words = words.take(pa.array(keep))
    n, m, i, j, group, long = n[keep], m[keep], i[keep], j[keep], group[keep], long[keep]
    text = words.to_pylist()
    to, of = [], []
    for width in np.unique(j - i):
        at = np.flatnonzero(j - i == width)
        middles = [text[k][i[k] : j[k] if long[k] else j[k] - 1] for k in at]
        for q, p, e in near_pairs(middles, long[at], group[at], int(width)):
            q, p = at[q], at[p]
            short = ~long[q]
            # an insertion into a stretch of equal letters is told at the first of them only
            first = np.array([(k := int(i[x]) + e) == 0 or text[x][k - 1] != text[x][k] for x in p[short]], bool)
            qs, ps = q[short][first], p[short][first]
            to += [q[~short], qs, ps]
            of += [p[~short], ps, qs]
    if not to:
        return None
    t, s = np.concatenate(to), np.concatenate(of)
    if not len(t):
        return None
    order = pc.sort_indices(words).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    by = np.lexsort((rank[s], -n[s], t))
    t, s = t[by], s[by]
    heads = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
    counts = np.diff(np.append(heads, len(t)))
    return pa.RecordBatch.from_arrays([words.take(pa.array(t[heads])), pa.array(counts), pa.array(n[s[heads]]), words.take(pa.array(s[heads]))], names=["word", "k", "near_n", "near"])


def _searched(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group: whole groups are treated, some chunk of rows at a time."""
    held: pa.Table | None = None

    def treat(t: pa.Table) -> Iterator[pa.RecordBatch]:
        heads = _group_heads(t)
        col = lambda name: t.column(name).to_numpy()
        out = _tell(t.column("word").combine_chunks(), col("n"), col("m"), col("i"), col("j"), np.cumsum(heads) - 1)
        if out is not None:
            yield out

    for batch in batches:
        now = pa.Table.from_batches([batch])
        held = now if held is None else pa.concat_tables([held, now])
        if held.num_rows >= chunk:
            last = int(np.flatnonzero(_group_heads(held))[-1])
            if last:
                yield from treat(held.slice(0, last))
                held = held.slice(last).combine_chunks()
    if held is not None and held.num_rows:
        yield from treat(held)


def _group_heads(t: pa.Table) -> np.ndarray:
    heads = np.ones(t.num_rows, bool)
    for name in KEY:
        c = t.column(name).combine_chunks()
        differs = pc.not_equal(c.slice(1), c.slice(0, max(len(c) - 1, 0))).to_numpy(zero_copy_only=False)
        heads[1:] = differs if name == KEY[0] else heads[1:] | differs
    return heads


def near_words(words: DataFrame, limit: int = GROUP, chunk: int = CHUNK) -> DataFrame:
    """word, n_near and best (the commonest near word, and its count n) for the words that have near words."""
    small_batches(words.sparkSession, rows=20_000)
    rows = grouped(words, limit).repartition(*KEY).sortWithinPartitions(*KEY)
    told = rows.mapInArrow(lambda batches: _searched(batches, chunk), "word string, k long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("word")))
    return told.groupBy("word").agg(F.sum("k").alias("n_near"), best.alias("b")).select("word", "n_near", F.struct(F.col("b.word").alias("word"), (-F.col("b.minus")).alias("n")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root: where following form from word to word ends. forms: word and form, without circles."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = written(now.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now


def variants(words: DataFrame, ratio: int = RATIO, limit: int = GROUP, chunk: int = CHUNK) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of words (word, n)."""
    words = written(words, "words")
    told = words.join(near_words(words, limit, chunk), "word", "left")
    is_form = F.col("best.n") >= ratio * F.col("n")
    told = told.select("word", F.when(is_form, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.n")).alias("form_n"))
    told = written(told, "variants")
    ends = roots(told.where("form is not null").select("word", "form"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
