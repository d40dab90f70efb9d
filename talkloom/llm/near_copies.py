"""Near copies by SimHash over word shingles, made whole by an exact set-similarity join.

Two texts are linked when the sets of their word shingles have a Jaccard similarity of at least
SIMILARITY. SimHash's Golay keys (see simhash) find near-equal texts first, and each is compared
with the least one found for it. Three bits of 64 reach no further than that, so a prefix-filtered
join follows, which finds all pairs; nothing in it is left to chance. Shingles stand in one order for all texts, rare ones first. Of n shingles, a text in a link shares at least ceil(s n), so
one of its first n - ceil(s n) + 1 is among the first ones of the other text; pairs that meet in such
a shingle pass a length filter, a position filter and one by sketches (parities of numbers of shingles, which differ in no more bits than
the sets in shingles), and are then compared shingle by shingle.

Any order is exact; how common shingles are, for speed, is counted over all texts at PLACES places of their hashes: tasks send
their counts of the places, which are added. A place's count is at least that of each shingle in it, so what many texts share comes last,
however many tasks there are.
To keep a large group of copies from being compared pair by pair, each shingle's texts are first
compared with one of them; pairs that are in one component by then aren't compared again. Where a shingle's texts are in many components
even then (of a group about as similar as the limit, each text is linked with half of the others, say), one text of each component is compared
with one drawn for the shingle, until components have merged so far that the pairs left grow with the texts; all these are compared.

Words are those of SimHash: A-Z lower-cased, maximal runs of characters other than space and
U+0009-U+000D. With fewer words than a shingle has, the whole sequence is the only shingle. Texts
with equal sets are one node, also those without words. Shingles are known by 64-bit hashes up to
the comparison, which uses the words themselves. Repeated ids and rows are allowed; a null id never
becomes a component's id unless all ids in it are null. Texts of any length are read whole; an empty table gives no rows; columns other
than id and text are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.llm import simhash
from talkloom.llm.common import small_batches, written
from talkloom.llm.components import components

WORDS, SIMILARITY = 5, 0.8
#: Entries of a task's tally of shingles, and how many common ones are told to all at most (16 bytes each).
TALLY, MOST_COMMON = 1 << 17, 200_000
#: Places of shingles' hashes at which they are counted (a byte each is told to all), and how many of them travel in a row.
PLACES, PLACES_A_ROW = 1 << 22, 1 << 14
#: Longs of a shingle set's sketch, whose bits are parities of numbers of shingles.
SKETCH = 8
#: Pairs of different components for each text of a shingle, on average, beyond which they are merged first, and how often this is done at most.
CROWD, MERGES = 8, 6
#: Bytes of a batch of texts, whose shingles take several times as much, and of one of pairs of texts.
SHINGLED_BYTES, COMPARED_BYTES = 4 << 20, 2 << 20
#: Words whose hashes are kept; beyond that the cache starts anew.
CACHE = 100_000


def shingle_set(text: str | None, words: int = WORDS) -> set[bytes]:
    split = (text or "").encode().lower().split()
    return {b" ".join(split[i : i + words]) for i in range(max(1, len(split) - words + 1))} if split else set()


class Hasher:
    """Sorted distinct 64-bit hashes of a text's shingles."""

    def __init__(self, words: int = WORDS):
        import xxhash

        digest = xxhash.xxh64_intdigest

        class Known(dict):
            def __missing__(self, word: bytes) -> int:
                h = digest(word)
                if len(self) >= CACHE:
                    self.clear()
                if len(word) < 64:
                    self[word] = h
                return h

        self.words, self.known = words, Known()

    def __call__(self, text: str | None) -> np.ndarray:
        split = (text or "").encode().lower().split()
        h = np.fromiter(map(self.known.__getitem__, split), np.uint64, len(split))
        width = min(self.words, len(h))
        if not width:
            return h
        m = len(h) - width + 1
        out = np.full(m, width, np.uint64)
        for k in range(width):
            out = (out ^ h[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return np.unique(out)


def prefix_length(n: int, similarity: float) -> int:
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


class Tally:
    """Counts of the commonest shingles of a stream, in a table of at most `size` entries (lossy counting).

    Whenever the table is full, the largest count that didn't fit is taken from all; so a count is too
    low by at most the number of shingles seen, divided by `size`.
    """

    def __init__(self, size: int = TALLY):
        self.size = size
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0

    def add(self, hashes: np.ndarray) -> None:
        self.waiting.append(hashes)
        self.n_waiting += len(hashes)
        if self.n_waiting >= 4 * self.size:
            self.merge()

    def merge(self) -> None:
        keys, n = np.unique(np.concatenate([*self.waiting, np.zeros(0, np.uint64)]), return_counts=True)
        self.waiting, self.n_waiting = [], 0
        both, at = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([self.counts, n]), len(both)).astype(np.int64)
        if len(both) > self.size:
            counts -= np.partition(counts, len(both) - self.size - 1)[len(both) - self.size - 1]
        self.keys, self.counts = both[counts > 0], counts[counts > 0]


def common_shingles(docs: DataFrame, text: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of the commonest shingles of all texts, MOST_COMMON at most.

    Each task sends one bounded tally. A histogram of the added counts tells from which count on
    the shingles are few enough; no task sorts them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, tally = Hasher(words), Tally()
        for batch in batches:
            for s in batch.column(0):
                tally.add(hashes(s.as_py()))
        tally.merge()
        for i in range(0, len(tally.keys), 1 << 16):
            part = slice(i, i + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(tally.keys[part].view(np.int64)), pa.array(tally.counts[part])], names=["shingle", "n"])

    tallies = docs.select(F.col(text).alias("text")).mapInArrow(run, "shingle long, n long")
    counts = tallies.groupBy("shingle").agg(F.sum("n").alias("n")).where("n > 1")
    counts = written(counts.withColumn("step", F.floor(F.log2("n") * 8).cast("int")), "near-counts")
    least, total = None, 0
    for step, n in sorted(((r["step"], r["count"]) for r in counts.groupBy("step").count().collect()), reverse=True):
        total += n
        if total > MOST_COMMON:
            break
        least = step
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    got = counts.where(F.col("step") >= least).select("shingle", "n").toArrow()
    shingles, n = got.column(0).to_numpy().astype(np.int64).view(np.uint64), got.column(1).to_numpy()
    order = np.argsort(shingles)
    return shingles[order], n[order]


def place_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - PLACES.bit_length() + 1)).astype(np.int64)


def place_steps(docs: DataFrame, text: str, words: int) -> np.ndarray:
    """How many shingles of all texts fall in each place, as eighths of powers of two; a text's counts once.

    A task's counts are rows of PLACES_A_ROW places, which are added as they stream by, so no task holds more than its own places and one row.
    """
    width, places = PLACES_A_ROW, PLACES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts, waiting = Hasher(words), None, []
        for batch in batches:
            counts = np.zeros(places, np.uint32) if counts is None else counts
            for s in batch.column(0):
                waiting.append(place_of(hashes(s.as_py())))
                if sum(map(len, waiting)) >= 1 << 18 or len(waiting) >= 256:
                    np.add.at(counts, np.concatenate(waiting), 1)
                    waiting = []
        if waiting:
            np.add.at(counts, np.concatenate(waiting), 1)
        for i in range(0, 0 if counts is None else places, width):
            part = counts[i : i + width]
            if part.any():
                part = part.astype(np.uint8) if part.max() < 256 else part
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["first", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, total = None, np.zeros(width, np.int64)

        def row() -> pa.RecordBatch:
            steps = np.floor(np.log2(np.maximum(total, 1)) * 8).clip(0, 255).astype(np.uint8)
            return pa.RecordBatch.from_arrays([pa.array([first], pa.int32()), pa.array([steps.tobytes()], pa.binary())], names=["first", "steps"])

        for batch in batches:
            for at, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                if at != first:
                    if first is not None:
                        yield row()
                    first, total = at, np.zeros(width, np.int64)
                data = counts.as_py()
                total += np.frombuffer(data, np.uint8 if len(data) == width else np.uint32)
        if first is not None:
            yield row()

    sent = docs.select(F.col(text).alias("text")).mapInArrow(count, "first int, counts binary")
    told = sent.repartition("first").sortWithinPartitions("first").mapInArrow(add, "first int, steps binary")
    out = np.zeros(PLACES, np.uint8)
    for r in written(told, "near-places").collect():
        out[r["first"] : r["first"] + width] = np.frombuffer(r["steps"], np.uint8)
    return out


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Each shingle flips one bit; so two sets differ in at least as many shingles as their sketches do in bits."""
    bits = np.bincount((hashes & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def shingled(docs: DataFrame, id_col: str, text: str, words: int, similarity: float) -> DataFrame:
    """id, mark (a hash of the text), node (a hash of the shingle set), n (shingles), prefix (the first ones in the order), sketch, fp (SimHash) and text."""
    spark = docs.sparkSession
    small_batches(spark, size=SHINGLED_BYTES)
    shared = spark.sparkContext.broadcast(place_steps(docs, text, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes = Hasher(words)
        steps = shared.value
        for batch in batches:
            node, size, prefix, sketches, fp = [], [], [], [], []
            for s in batch.column(1):
                h = hashes(s.as_py())
                node.append(xxhash.xxh64_intdigest(h.tobytes()))
                size.append(len(h))
                sketches.append(sketch(h))
                fp.append(simhash.fingerprint(s.as_py(), words))
                prefix.append(h[np.lexsort((h, steps[place_of(h)]))[: prefix_length(len(h), similarity)]].view(np.int64))
            cols = [batch.column(0), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(size, pa.int32()), pa.array(prefix, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64())), pa.array(np.array(fp, np.uint64).view(np.int64)), batch.column(1), batch.column(2)]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "node", "n", "prefix", "sketch", "fp", "text", "mark"])

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("mark"))
    return plain.mapInArrow(run, "id long, node long, n int, prefix array<long>, sketch array<long>, fp long, text string, mark long")


def verified(pairs: DataFrame, rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """src, dst: the pairs whose shingle sets are that similar."""
    small_batches(rows.sparkSession, size=COMPARED_BYTES)
    # written, so that Spark knows how few they are: else it may deal out all texts before it has counted them
    wanted = written(pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "near-wanted")
    texts = written(rows.select("node", "text").join(wanted, "node", "left_semi").groupBy("node").agg(F.min("text").alias("text")), "near-texts")
    left = texts.select(F.col("node").alias("src"), F.col("text").alias("a"))
    right = texts.select(F.col("node").alias("dst"), F.col("text").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, set()
        for batch in batches:
            ok = []
            for s, a, b in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if s != last:
                    last, kept = s, shingle_set(a.as_py(), words)
                other = shingle_set(b.as_py(), words)
                both = len(kept & other)
                ok.append(both >= similarity * (len(kept) + len(other) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays(list(batch.columns[:2]), names=["src", "dst"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(left, "src").join(right, "dst").select("src", "dst", "a", "b").mapInArrow(run, "src long, dst long")


def fingerprint_pairs(rows: DataFrame) -> DataFrame:
    """src, dst: each node whose fingerprint is at most three bits from another's, with the least such one.

    Of nodes with one fingerprint all pair with the least node; of fingerprints each pairs with the least
    one near it. So pairs grow with the nodes, however large a group is.
    """
    nodes = rows.groupBy("node").agg(F.min("fp").alias("fp"))
    hubs = written(nodes.groupBy("fp").agg(F.min("node").alias("hub")), "near-hubs")
    same = nodes.join(hubs, "fp").where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    near = simhash.links(hubs).groupBy("dst").agg(F.min("src").alias("src"))
    low, high = hubs.select(F.col("fp").alias("src"), F.col("hub").alias("a")), hubs.select(F.col("fp").alias("dst"), F.col("hub").alias("b"))
    pairs = same.union(near.join(low, "src").join(high, "dst").select("a", "b"))
    return pairs.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))


def close(n: Column, at: Column, m: Column, at2: Column, similarity: float) -> Column:
    """Whether sets of n and m shingles can be that similar, if the ones at these places are the first that they share."""
    fits = (n >= similarity * m - 1e-9) & (m >= similarity * n - 1e-9)
    most = 1 + F.least(n - at - 1, m - at2 - 1)  # shared shingles
    return fits & (most * (1 + similarity) >= similarity * (n + m) - 1e-6)


def sketched(n: Column, m: Column, similarity: float) -> Column:
    """Whether sets of n and m shingles can be that similar by their sketches, in bits0a and so on and bits0b and so on."""
    apart = sum((F.bit_count(F.col(f"bits{i}a").bitwiseXOR(F.col(f"bits{i}b"))) for i in range(SKETCH)), F.lit(0))  # shingles in one of both, at least
    return apart * (1 + similarity) <= (1 - similarity) * (n + m) + 1e-6


def likely(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The pairs (src, dst) that can be that similar by their sketches: only their texts are moved to be compared."""
    for end, to in (("a", "src"), ("b", "dst")):
        pairs = pairs.join(sketches.select(F.col("node").alias(to), *[F.col(c).alias(c + end) for c in sketches.columns if c != "node"]), to)
    return pairs.where(sketched(F.col("na"), F.col("nb"), similarity)).select("src", "dst")


def shared_keys(nodes: DataFrame) -> DataFrame:
    """shingle, node, n, at, and hub, hub_n, hub_at of the least node that has it: the prefixes' shingles that two nodes share.

    Both sides of the join have the same columns, dealt by shingle, so that Spark shuffles the prefixes once.
    """
    keys = nodes.select("node", "n", F.posexplode("prefix").alias("at", "shingle"))
    dealt = keys.select("shingle", "node", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("at").cast("long")).alias("place")).repartition("shingle")
    hubs = dealt.groupBy("shingle").agg(F.min(F.struct("node", "place")).alias("hub"), F.count("*").alias("met")).where("met > 1").select("shingle", "hub")
    # never broadcast: Spark's estimates don't count what an array is exploded to
    met = dealt.hint("shuffle_merge").join(hubs, "shingle")
    n, at = lambda c: F.shiftright(c, 32).cast("int"), lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    place, hub = F.col("place"), F.col("hub.place")
    return met.select("shingle", "node", n(place).alias("n"), at(place).alias("at"), F.col("hub.node").alias("hub"), n(hub).alias("hub_n"), at(hub).alias("hub_at"))


def rooted_keys(keys: DataFrame, roots: DataFrame) -> DataFrame:
    return keys.join(roots, "node", "left").select("shingle", "node", "n", "at", F.coalesce("root", "node").alias("root"))


def crowded(rooted: DataFrame) -> DataFrame:
    """The rows of shingles whose texts have more than CROWD pairs of different components each, on average."""
    size = rooted.groupBy("shingle", "root").agg(F.count("*").alias("size")).groupBy("shingle")
    size = size.agg(F.sum("size").alias("all"), F.sum(F.col("size") * F.col("size")).alias("same"))
    many = size.where(F.col("all") * F.col("all") - F.col("same") > 2 * CROWD * F.col("all")).select("shingle")
    return rooted.join(many, "shingle", "left_semi")


def drawn_pairs(crowd: DataFrame, turn: int, similarity: float) -> DataFrame:
    """src, dst: for each shingle one text of each component, with the one that is drawn for the shingle: a row for each text at most."""
    order = F.xxhash64("shingle", "node", F.lit(turn)).alias("order")
    one = crowd.groupBy("shingle", "root").agg(F.min(F.struct(order, "node", "n", "at")).alias("one"))
    hubs = one.groupBy("shingle").agg(F.min("one").alias("hub"))
    met = one.join(hubs, "shingle").where((F.col("one.node") != F.col("hub.node")) & close(*map(F.col, ("one.n", "one.at", "hub.n", "hub.at")), similarity))
    return met.select(F.least("one.node", "hub.node").alias("src"), F.greatest("one.node", "hub.node").alias("dst")).distinct()


def merged(keys: DataFrame, roots: DataFrame, sketches: DataFrame, rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """node, root: the components after links in crowded shingles have been looked for, MERGES times at most or until a turn finds few of the first one's number."""
    most = 0
    for turn in range(MERGES):
        crowd = written(crowded(rooted_keys(keys, roots)), "near-crowd")
        if crowd.isEmpty():
            break
        keys = crowd.drop("root")  # as components merge, no other shingle becomes crowded
        drawn = written(likely(drawn_pairs(crowd, turn, similarity), sketches, similarity), "near-drawn")
        found = written(verified(drawn, rows, words, similarity), "near-links")
        n = found.count()
        if not n:
            break
        roots = written(components(roots.select(F.col("root").alias("src"), F.col("node").alias("dst")).union(found)), "near-roots")
        most = max(most, n)
        if n < most / 8:
            break
    return roots


def links(rows: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """src, dst: links that connect whatever the links of all pairs connect."""
    nodes = rows.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "prefix", "sketch")])
    bits = [f"bits{i}" for i in range(SKETCH)]
    nodes = written(nodes.select("node", "n", "prefix", *[F.col("sketch")[i].alias(c) for i, c in enumerate(bits)]), "near-nodes")
    sketches = nodes.select("node", "n", *bits)
    near = written(fingerprint_pairs(rows), "near-fingerprints")
    alike = written(verified(written(likely(near, sketches, similarity), "near-likely"), rows, words, similarity), "near-alike")
    keys = written(shared_keys(nodes), "near-keys")
    stars = keys.where((F.col("hub") != F.col("node")) & close(*map(F.col, ("n", "at", "hub_n", "hub_at")), similarity))
    stars = written(stars.select(F.col("hub").alias("src"), F.col("node").alias("dst")).distinct(), "near-stars")
    first = written(likely(stars.join(near, ["src", "dst"], "left_anti"), sketches, similarity), "near-likely")
    first = written(verified(first, rows, words, similarity), "near-links")
    roots = merged(keys, written(components(alike.union(first)), "near-roots"), sketches, rows, words, similarity)

    rooted = rooted_keys(keys, roots)
    mixed = rooted.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("shingle")
    rooted = rooted.join(mixed, "shingle", "left_semi").join(sketches.drop("n").hint("shuffle_merge"), "node")
    rooted = written(rooted.select("shingle", "node", "n", "at", "root", *bits), "near-rooted")
    a = rooted.select("shingle", F.col("node").alias("src"), F.col("n").alias("n1"), F.col("at").alias("at1"), F.col("root").alias("root1"), *[F.col(c).alias(c + "a") for c in bits])
    b = rooted.select("shingle", F.col("node").alias("dst"), F.col("n").alias("n2"), F.col("at").alias("at2"), F.col("root").alias("root2"), *[F.col(c).alias(c + "b") for c in bits])
    fit = (F.col("src") < F.col("dst")) & (F.col("root1") != F.col("root2")) & close(*map(F.col, ("n1", "at1", "n2", "at2")), similarity)
    fit = fit & sketched(F.col("n1"), F.col("n2"), similarity)
    rest = a.hint("shuffle_merge").join(b, (a.shingle == b.shingle) & fit).select("src", "dst").distinct()
    tried = stars.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    rest = written(rest.join(tried, ["src", "dst"], "left_anti"), "near-rest")
    # the first links' components as stars, which are shorter than their chains
    return roots.select(F.col("node").alias("src"), F.col("root").alias("dst")).union(verified(rest, rows, words, similarity))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY, marks: bool = False) -> DataFrame:
    """id_col and component_id: the smallest id reachable by links.

    With marks also mark, the hash of the row's text (of a column of any type, as F.xxhash64 has it), and component_mark, that of the
    row that stands for its component: the one with the smallest id, then the smallest mark; without an id only if none has one.
    """
    rows = written(shingled(docs, id_col, text, words, similarity), "shingled")
    roots = components(links(rows, words, similarity))
    first = F.struct(F.isnull("id").alias("none"), "id", "mark")
    named = rows.groupBy("node").agg(F.min(first).alias("least")).join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least")
    least = named.groupBy("root").agg(F.min("least").alias("least"))
    named = named.join(least.select("root", F.col("least.id").alias("component_id"), F.col("least.mark").alias("component_mark")), "root").drop("root", "least")
    return rows.select("id", "mark", "node").join(named, "node").select(F.col("id").alias(id_col), "component_id", *(["mark", "component_mark"] if marks else []))
