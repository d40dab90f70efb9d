"""Periodic runs of words, found by Crochemore's partition refinement, and texts without their repeats.

Positions of a document are in one class at length k when the same k words begin there. Going from k to k+1, only
classes that were split off at k, without the largest child of each split, can split others (smaller half):
the positions before theirs leave their class, grouped by what follows them. So a position is touched
a logarithmic number of times. Members of a class are linked in the order of the text; two neighbours that are
k apart at length k are a square whose root has no smaller period. Squares of one period that begin at
consecutive words make up a run. A gap is looked at when a link changes: if it stood when the length
reached it, it was a square.

The refinement takes all documents of an Arrow batch at once, as arrays. Before it, words that occur in their document fewer
times than the least exponent can't be in a run; they end the pieces that are refined, and a piece
is given up at the length beyond which it can hold no run. Nothing is shuffled: a task holds one batch, limited in bytes
and rows, or one text that is longer.

Defined results: a null or empty text has no words and no runs, and what is left of it is empty; nulls among given words count as
empty words; long texts are treated whole; repeated rows, and rows that repeat an id, are each treated alone; a null id is kept;
an empty table gives no rows. Other columns are returned only if named in keep, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkloom.llm.common import small_batches

SPACE = r"[\x20\x09-\x0D]+"
#: A run has this many words at least, and this many times its period.
LEAST_WORDS, LEAST_EXPONENT = 6, 4
RUN = T.StructType([T.StructField(f, T.LongType()) for f in ("start", "length", "period")])


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Where a stretch of equal keys begins."""
    out = np.ones(len(keys[0]), bool)
    out[1:] = keys[0][1:] != keys[0][:-1]
    for key in keys[1:]:
        out[1:] |= key[1:] != key[:-1]
    return out


def _lengths(heads: np.ndarray, n: int) -> np.ndarray:
    out = np.empty_like(heads)
    np.subtract(heads[1:], heads[:-1], out=out[:-1])
    if len(out):
        out[-1] = n - heads[-1]
    return out


def pieces(codes: np.ndarray, doc: np.ndarray, least_words: int, least_exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """Where runs can be: the positions, with -1 after each piece, and for each the number of its piece.

    A word that its document holds fewer than least_exponent times is in no run; what lies between such words is a piece.
    """
    order = np.lexsort((codes, doc))
    of = np.cumsum(_heads(codes[order], doc[order])) - 1
    often = np.empty(len(codes), bool)
    often[order] = np.bincount(of)[of] >= least_exponent
    at = np.flatnonzero(often)
    if not len(at):
        return at, at
    cut = np.ones(len(at), bool)
    cut[1:] = (np.diff(at) > 1) | (np.diff(doc[at]) != 0)
    piece = np.cumsum(cut) - 1
    long = np.bincount(piece)[piece] >= max(least_words, least_exponent)
    at, piece = at[long], piece[long]
    if not len(at):
        return at, at
    piece = np.cumsum(np.r_[True, np.diff(piece) != 0]) - 1
    ends = np.flatnonzero(np.r_[np.diff(piece) != 0, True]) + 1
    return np.insert(at, ends, -1), np.insert(piece, ends, piece[ends - 1])


def squares(symbols: np.ndarray, piece: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of the squares of primitive words within pieces, of periods up to limit (for each position).

    symbols: a number for each position; -1 ends a piece and equals nothing.
    """
    n = len(symbols)
    value = np.where(symbols < 0, symbols.max() + 1, symbols)
    order = np.lexsort((np.arange(n), value, piece))
    fresh = _heads(value[order], piece[order])
    of = np.cumsum(fresh) - 1
    cls = np.empty(n, np.int64)
    cls[order] = of
    size = np.zeros(2 * n + 1, np.int64)  # a class is split off at most n times
    size[: of[-1] + 1] = np.bincount(of)
    n_classes = int(of[-1]) + 1
    # members of a class, in the order of the text; n stands for none
    before, after = np.full(n + 1, n), np.full(n + 1, n)
    same = ~fresh[1:]
    after[order[:-1][same]] = order[1:][same]
    before[order[1:][same]] = order[:-1][same]
    # members by class, to list what is left of one: its part of `members` begins at first
    members, place = order.copy(), np.empty(n, np.int64)
    place[order] = np.arange(n)
    first = np.zeros(2 * n + 1, np.int64)
    first[:n_classes] = np.flatnonzero(fresh)
    since = np.ones(n + 1, np.int64)  # the length at which the link after a position came to be
    moving = np.zeros(n, bool)
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def passed(at: np.ndarray, k: int) -> None:
        """The links after these positions end at length k: those that stood at the length of their gap were squares."""
        gap = after[at] - at
        ok = (after[at] < n) & (since[at] <= gap) & (gap < k) & (gap <= limit[at])
        if ok.any():
            found.append((at[ok], gap[ok]))

    # the first splitters: all classes of a piece but its largest
    class_piece = piece[order[first[:n_classes]]]
    by_size = np.lexsort((-size[:n_classes], class_piece))
    keep = np.zeros(n_classes, bool)
    keep[by_size] = np.r_[False, class_piece[by_size][1:] == class_piece[by_size][:-1]]
    small = np.flatnonzero(keep[cls])
    k = 1
    while len(small):
        k += 1
        p = small - 1
        p = p[p >= 0]
        p = p[(piece[p] == piece[np.minimum(p + 1, n - 1)]) & (size[cls[p]] > 1) & (k <= limit[p])]
        if not len(p):
            break
        # groups: what leaves a class, by the class that follows
        p = p[np.lexsort((p, cls[p + 1], cls[p]))]
        old, nxt = cls[p], cls[p + 1]
        head = _heads(old, nxt)
        starts = np.flatnonzero(head)
        count = _lengths(starts, len(p))
        parent = old[starts]
        top = np.flatnonzero(_heads(parent))  # the first group of each parent
        leaving = np.add.reduceat(count, top)
        parents = parent[top]
        rest = size[parents] - leaving
        n_groups = _lengths(top, len(parent))
        # a class that goes as a whole to one group isn't split; one that goes to several leaves its last group in place
        stays = np.zeros(len(parent), bool)
        stays[(top + n_groups - 1)[rest == 0]] = True
        moved_group = ~stays
        if not moved_group.any():
            break
        group = np.cumsum(head) - 1
        moves = moved_group[group]
        m, g_old, g = p[moves], old[moves], group[moves]
        ids = n_classes + np.cumsum(moved_group) - 1
        n_classes = int(ids[-1]) + 1
        new = ids[g]
        # unlink: what leaves a list in one stretch is bridged at once
        by = np.lexsort((m, g_old))
        a = m[by]
        opens, closes = np.ones(len(a), bool), np.ones(len(a), bool)
        opens[1:] = closes[:-1] = after[a[:-1]] != a[1:]
        heads, tails = a[opens], a[closes]
        left, right = before[heads], after[tails]
        passed(a, k)
        bridged = left[left < n]
        passed(bridged, k)
        after[left[left < n]] = right[left < n]
        before[right[right < n]] = left[right < n]
        since[bridged] = k
        # link the new classes; m is in order of class and text
        new_heads = _heads(new)
        linked = ~new_heads[1:]
        after[m], before[m] = n, n
        after[m[:-1][linked]] = m[1:][linked]
        before[m[1:][linked]] = m[:-1][linked]
        since[m] = k
        # members: the moved ones go to the end of their old part, which becomes the new classes' own
        which = np.searchsorted(parents, g_old)
        gone = np.bincount(which, minlength=len(parents))
        cut = first[parents] + size[parents] - gone
        slot = np.arange(len(m)) + (cut - np.cumsum(gone) + gone)[which]
        zone = members[slot]
        moving[m] = True
        mark = ~moving[zone]
        moving[m] = False
        vacated = place[m]
        outside = vacated < cut[which]
        free = vacated[outside]  # in order of parents, as are the strangers in the zones
        members[free] = zone[mark]
        place[zone[mark]] = free
        members[slot] = m
        place[m] = slot
        size[parents] -= gone
        made = np.flatnonzero(new_heads)
        size[new[made]] = _lengths(made, len(m))
        first[new[made]] = slot[made]
        cls[m] = new
        # splitters of the next length: all children of a split but the largest
        of = np.concatenate([g_old[made], parents])
        child = np.concatenate([new[made], parents])
        rank = np.lexsort((-size[child], of))
        picked = child[rank[~_heads(of[rank])]]
        lens = size[picked]
        total = np.cumsum(lens)
        small = members[np.repeat(first[picked] - total + lens, lens) + np.arange(int(total[-1]) if len(total) else 0)]
    passed(np.arange(n), 1 << 60)
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def find(codes: np.ndarray, doc: np.ndarray, least_words: int = LEAST_WORDS, least_exponent: int = LEAST_EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and periods of the runs of a sequence of word numbers, none of which crosses from one doc to the next; by start, then period."""
    at, piece = pieces(codes, doc, least_words, least_exponent)
    none = np.empty(0, np.int64)
    if not len(at):
        return none, none, none
    symbols = np.where(at >= 0, codes[at], -1)
    limit = (np.bincount(piece) - 1)[piece] // least_exponent
    start, period = squares(symbols, piece, limit)
    if not len(start):
        return none, none, none
    order = np.lexsort((start, period))
    start, period = start[order], period[order]
    head = np.flatnonzero(np.r_[True, (np.diff(start) != 1) | (np.diff(period) != 0)])
    period, length = period[head], np.diff(np.r_[head, len(start)]) - 1 + 2 * period[head]
    start = at[start[head]]
    ok = length >= np.maximum(least_words, least_exponent * period)
    start, length, period = start[ok], length[ok], period[ok]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def collapse(docs: DataFrame, words: Column | None = None, id: str = "doc_id", keep: list[str] | None = None, least_words: int = LEAST_WORDS, least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """id, the columns of keep, n_words, runs (array of start, length, period; words from 0) and collapsed: the words, joined
    by spaces, without those that a run has beyond its first period. words: an array of strings, by default text's."""
    small_batches(docs.sparkSession)
    own = [id, *(keep or [])]
    listed = docs.select(*own, (words_of(F.col("text")) if words is None else words).alias("_words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(own))
            flat = pc.fill_null(lists.flatten(), "")
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(counts)
            begins = ends - counts
            codes = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.repeat(np.arange(len(counts)), counts)
            start, length, period = find(codes, doc, least_words, least_exponent)
            change = np.zeros(len(codes) + 1, np.int64)
            np.add.at(change, start + period, 1)
            np.add.at(change, start + length, -1)
            stays = np.cumsum(change)[:-1] == 0
            left = np.r_[0, np.cumsum(np.bincount(doc[stays], minlength=len(counts)))]
            kept = flat.filter(pa.array(stays))
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), kept.cast(pa.string())), " ")
            of = doc[start]
            runs = pa.StructArray.from_arrays([pa.array(start - begins[of]), pa.array(length), pa.array(period)], names=["start", "length", "period"])
            at = pa.array(np.r_[0, np.cumsum(np.bincount(of, minlength=len(counts)))], pa.int32())
            cols = [*(batch.column(k) for k in range(len(own))), pa.array(counts), pa.ListArray.from_arrays(at, runs), text]
            yield pa.RecordBatch.from_arrays(cols, names=[*own, "n_words", "runs", "collapsed"])

    out = T.StructType([*listed.schema.fields[:-1], T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])
    return listed.mapInArrow(run, out)
