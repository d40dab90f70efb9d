"""Embedding near-duplicates by product quantisation over inverted lists.

Vectors are compared within their label and length. The distinct unit vectors of a length are assigned
to coarse cells in two levels: the nearest of FIRST centres at most, then the nearest of a
common set of second centres to what is left; there are about as many cells as the square root of the number of vectors,
and beyond that enough for CELL vectors each, so that lists don't grow with the table. Each vector's residual
is coded by PARTS sub-quantisers. A vector searches its own cell and every cell
whose border, on either level, lies within the margin: REACH standard deviations of a link's displacement. A link of length r
moves about r / sqrt(d) along any fixed direction, where d is the effective dimension of the sample
(its squared total variance over the sum of squared variances), not the vectors' length. The margin is then checked on the sample:
it is raised until WANTED of the sample's links (by brute force) would be found.

In a cell, table lookups give the
distance of the query to each coded vector; what may lie within r, given the stored coding error
(so coding loses nothing), is rechecked by the exact cosine in double precision. Recall is thus
that of the choice of cells, and a link counts for both ends if either finds it.

Equal vectors of a label are one node with a number of copies. Lists and searches longer than BLOCK vectors are
split into blocks, and each block of a list meets each block of its searches in a group of its own, so that no group
holds more than twice BLOCK; from a group come per-vector counts and a spanning set of links, not all pairs.

The centres are fitted on the driver on a sample of SAMPLE_PER_CELL vectors a cell and SAMPLE_BYTES at most.
Nodes are known by a 64-bit hash of label and vector (zeros of either sign are alike). Defined results: a vector that is null or
zero, has a null or non-finite component or no label links with nothing and is its own component; so do
vectors of different lengths among each other. A cosine of exactly the threshold, as computed, is a link. Repeated ids are
rows of their own; a null id is a component's id only if all ids in it are null. Columns other than the three
that are named are not read. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.llm.common import received, share, small_batches, written
from talkloom.llm.components import components

SAMPLE_PER_CELL, SAMPLE_BYTES = 32, 64 << 20
FIRST, CELL = 4096, 4096
PARTS, CODES = 8, 64
REACH, WANTED = 2.0, 0.99
#: Vectors in a block of a list, or of the searches of one. Lengths with fewer vectors in all than this have one cell.
BLOCK = 512
#: Sample vectors whose links are found by brute force, to check the margin.
CHECKED = 2048
_SLACK = 1e-6


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(rounds):
        a = nearest(x, c)
        n = np.bincount(a, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, a, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * x @ c.T)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([_squares(x[i : i + 1024], c).argmin(1) for i in range(0, len(x), 1024)]) if len(x) else np.zeros(0, np.int64)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Index:
    """Coarse centres of two levels and sub-quantisers, fitted on sample vectors of unit length."""

    def __init__(self, sample: np.ndarray, cells: int, threshold: float, reach: float = REACH):
        self.dim = sample.shape[1]
        self.radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
        self.threshold = threshold
        self.first = kmeans(sample, min(cells, FIRST))
        rest = sample - self.first[nearest(sample, self.first)]
        seconds = -(-cells // len(self.first))
        self.second = kmeans(rest, seconds) if seconds > 1 else np.zeros((1, self.dim))
        left = self.pad(rest - self.second[nearest(rest, self.second)])
        self.books = [kmeans(part, CODES, seed=m) for m, part in enumerate(np.split(left, PARTS, axis=1))]
        spread = np.linalg.eigvalsh(np.cov(rest, rowvar=False).reshape(self.dim, self.dim)) if len(rest) > 1 else np.ones(1)
        effective = float(spread.sum() ** 2 / max((spread * spread).sum(), 1e-300)) if spread.sum() > 0 else 1.0
        self.margin = reach * self.radius / np.sqrt(min(max(effective, 1.0), self.dim))
        while not self.reaches(sample[:: max(1, len(sample) // (8 * CHECKED))]) and self.margin < 4:
            self.margin *= 1.5

    def reaches(self, x: np.ndarray) -> bool:
        """Whether the links among these vectors, found by brute force, are found by the cells (from either end)."""
        asked = x[:CHECKED]
        i, j = np.nonzero(asked @ x.T >= self.threshold)
        i, j = i[i != j], j[i != j]
        if not len(i):
            return True
        home, _, _, search = self.encode(x)
        sets = {k: set(search[k].tolist()) for k in np.unique(np.concatenate([i, j])).tolist()}
        found = sum(home[b] in sets[a] or home[a] in sets[b] for a, b in zip(i.tolist(), j.tolist()))
        return found >= WANTED * len(i)

    def centre(self, cell: np.ndarray) -> np.ndarray:
        return self.first[cell // len(self.second)] + self.second[cell % len(self.second)]

    def pad(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, -x.shape[1] % PARTS)))

    def ahead(self, x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centre of each vector, and which centres' borders to it are within the margin."""
        d = _squares(x, c)
        home = d.argmin(1)
        gaps = np.sqrt(_squares(c[home], c))
        # the difference of squares is twice the gap times the distance to the border
        return home, d - d[np.arange(len(d)), home][:, None] <= 2 * gaps * self.margin + _SLACK

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Home cell, codes, coding error, and the cells to search, of each vector."""
        homes, search, n2 = [], [], len(self.second)
        for i in range(0, len(x), 256):
            part = x[i : i + 256]
            home, near = self.ahead(part, self.first)
            if n2 == 1:
                homes.append(home)
                search += [np.flatnonzero(s) for s in near]
                continue
            row, cell1 = np.nonzero(near)
            cells2, own = [], np.zeros(len(part), np.int64)
            for k in range(0, len(row), 256):
                r, c1 = row[k : k + 256], cell1[k : k + 256]
                home2, near2 = self.ahead(part[r] - self.first[c1], self.second)
                mine = c1 == home[r]
                own[r[mine]] = c1[mine] * n2 + home2[mine]
                a, c2 = np.nonzero(near2)
                cells2.append(np.stack([r[a], c1[a] * n2 + c2]))
            pairs = np.concatenate(cells2, axis=1)
            homes.append(own)
            search += np.split(pairs[1], np.searchsorted(pairs[0], np.arange(1, len(part))))
        home = np.concatenate(homes)
        rest = self.pad(x - self.centre(home))
        parts = np.split(rest, PARTS, axis=1)
        codes = np.stack([nearest(p, b) for p, b in zip(parts, self.books)], axis=1).astype(np.uint8)
        coded = np.concatenate([b[codes[:, m]] for m, b in enumerate(self.books)], axis=1)
        return home, codes, np.sqrt(((rest - coded) ** 2).sum(1)), search

    def near(self, q: np.ndarray, cell: int, x: np.ndarray, codes: np.ndarray, error: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index pairs (query, vector of the cell) with a cosine of at least the threshold."""
        parts = np.split(self.pad(q - self.centre(np.array([cell]))), PARTS, axis=1)
        d = np.zeros((len(q), len(x)))
        for m, (p, b) in enumerate(zip(parts, self.books)):
            d += _squares(p, b)[:, codes[:, m]]
        i, j = np.nonzero(np.sqrt(d) <= self.radius + error[None, :] + _SLACK)
        keep = np.zeros(len(i), bool)
        for s in range(0, len(i), 1 << 14):
            a, b = i[s : s + (1 << 14)], j[s : s + (1 << 14)]
            keep[s : s + (1 << 14)] = np.einsum("ij,ij->i", q[a], x[b]) >= self.threshold
        return i[keep], j[keep]


def spanning(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For nodes a and b, linked by the index pairs i, j: the least node each one is connected with."""
    la, lb = a.copy(), b.copy()
    while len(i):
        least = np.minimum(la[i], lb[j])
        na, nb = la.copy(), lb.copy()
        np.minimum.at(na, i, least)
        np.minimum.at(nb, j, least)
        if (na == la).all() and (nb == lb).all():
            break
        la, lb = na, nb
    return la, lb


def usable(vec: Column) -> Column:
    ok = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vec.isNotNull() & ok & F.exists(vec, lambda x: x != 0)


def encoded(nodes: DataFrame, index: Index) -> DataFrame:
    """The nodes of one length with their cells, codes and cells to search."""
    shared = share(nodes.sparkSession, index)
    kind = nodes.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = received(shared)
        for batch in batches:
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for i in range(0, len(x), 512):
                part = batch.slice(i, 512)
                home, codes, error, search = ix.encode(unit(x[i : i + 512]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(home.astype(np.int64)), pa.array([v.tobytes() for v in x[i : i + 512]], pa.binary()), pa.array([v.tobytes() for v in codes], pa.binary()),
                     pa.array(error), pa.array([v.astype(np.int64) for v in search], pa.list_(pa.int64())), part.column(3)],
                    names=["node", "copies", "home", "vec", "codes", "error", "search", "label"],
                )

    return nodes.select("node", "copies", "vec", "label").mapInArrow(
        run, f"node long, copies long, home long, vec binary, codes binary, error double, search array<long>, label {kind}"
    )


def link_rows(coded: DataFrame, index: Index, block: int = BLOCK) -> DataFrame:
    """node, n (links it found, or that only the other end found), root (a node it is connected with)."""
    shared = share(coded.sparkSession, index)
    part = lambda n: F.pmod(F.col("node"), n.cast("long")).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    here, there = coded.withColumn("cell", F.col("home")), coded.withColumn("cell", F.explode("search"))
    count = lambda df, name: df.groupBy(F.col("label").alias("label2"), F.col("cell").alias("cell2")).agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    sizes = written(count(here, "lists").join(count(there, "searches"), ["label2", "cell2"]), "cells")
    at = (F.col("label") == F.col("label2")) & (F.col("cell") == F.col("cell2"))
    common = ["label", "cell", "block", "asking", "role", "node", "copies", "home", "vec", "codes", "error", "search"]
    stored = here.join(sizes, at).withColumns({"role": F.lit(0), "block": part(F.col("lists"))}).withColumn("asking", each(F.col("searches"))).select(*common)
    asked = there.join(sizes, at).withColumns({"role": F.lit(1), "asking": part(F.col("searches"))}).withColumn("block", each(F.col("lists")))
    asked = asked.withColumns({"codes": F.lit(b""), "search": F.array().cast("array<long>")}).select(*common)
    key = ("label", "cell", "block", "asking")
    dealt = stored.union(asked).repartition(*key).sortWithinPartitions(*key, "role", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = received(shared)
        here, parts, store = None, [], None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            c = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            label, cell, blk, asking, role = (c[k].to_numpy(zero_copy_only=False) for k in ("label", "cell", "block", "asking", "role"))
            cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(blk) != 0) | (np.diff(asking) != 0) | (np.diff(role) != 0) | (label[1:] != label[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, n]):
                if (label[a], cell[a], blk[a], asking[a]) != here:
                    here, parts, store = (label[a], cell[a], blk[a], asking[a]), [], None
                part = {name: col.slice(a, b - a) for name, col in c.items()}
                vec = unit(np.frombuffer(b"".join(part["vec"].to_pylist()), np.float64).reshape(b - a, -1))
                node, copies, home = (part[k].to_numpy(zero_copy_only=False) for k in ("node", "copies", "home"))
                if role[a] == 0:
                    codes = np.frombuffer(b"".join(part["codes"].to_pylist()), np.uint8).reshape(b - a, PARTS)
                    parts.append((vec, node, copies, codes, part["error"].to_numpy(zero_copy_only=False), part["search"].to_pylist()))
                    continue
                if not parts:
                    continue  # no vector of the list fell into this block
                if store is None:
                    store = [np.concatenate(x) for x in list(zip(*parts))[:5]]
                    lists = [s for p in parts for s in p[5]]
                    number = {x: k for k, x in enumerate(sorted({x for s in lists for x in s}))}
                    seen = np.zeros((len(lists), len(number) + 1), bool)  # the last column: a cell that none searches
                    for k, s in enumerate(lists):
                        seen[k, [number[x] for x in s]] = True
                svec, snode, scopies, scodes, serror = store
                qhome = np.array([number.get(x, len(number)) for x in home.tolist()])
                for s in range(0, b - a, 256):
                    q, qn, qc, qh = vec[s : s + 256], node[s : s + 256], copies[s : s + 256], qhome[s : s + 256]
                    i, j = ix.near(q, int(here[1]), svec, scodes, serror)
                    other = qn[i] != snode[j]
                    i, j = i[other], j[other]
                    if not len(i):
                        continue
                    one_sided = ~seen[j, qh[i]]
                    nq = np.bincount(i, scopies[j], len(q)).astype(np.int64)
                    ns = np.bincount(j[one_sided], qc[i[one_sided]], len(snode)).astype(np.int64)
                    rq, rs = spanning(qn, snode, i, j)
                    ui, uj = np.unique(i), np.unique(j)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate([qn[ui], snode[uj]])), pa.array(np.concatenate([nq[ui], ns[uj]])), pa.array(np.concatenate([rq[ui], rs[uj]]))],
                        names=["node", "n", "root"],
                    )

    return dealt.mapInArrow(run, "node long, n long, root long")


def n_cells(count: int, block: int = BLOCK) -> int:
    return 1 if count <= block else max(round(count**0.5), -(-count // CELL))


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vec: str = "embedding", label: str = "label", threshold: float = 0.93, reach: float = REACH, block: int = BLOCK
) -> DataFrame:
    """id_col, n_links, component_id (the least id reachable) and kept (the id is the component's)."""
    spark = vectors.sparkSession
    small_batches(spark, rows=2048)
    rows = vectors.select(F.col(id_col).alias("id"), F.transform(F.col(vec).cast("array<double>"), lambda x: x + 0.0).alias("vec"), F.col(label).alias("label"))
    ok = F.coalesce(usable(F.col("vec")) & F.col("label").isNotNull(), F.lit(False))
    keyed = rows.withColumn("node", F.when(ok, F.xxhash64("label", "vec")))
    nodes = keyed.where("node is not null").groupBy("node").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.first("vec").alias("vec"), F.first("label").alias("label"))
    nodes = written(nodes.withColumn("dim", F.size("vec")), "vectors")
    found = None
    for r in nodes.groupBy("dim").count().orderBy("dim").collect():  # one row for each length of vectors
        dim, count = r["dim"], r["count"]
        mine, cells = nodes.where(F.col("dim") == dim), n_cells(count, block)
        # nodes are hashes: the first ones are a fair sample, of a bounded number
        size = min(SAMPLE_PER_CELL * max(cells, 16), max(1, SAMPLE_BYTES // (8 * dim)))
        chosen = mine.select("vec", "node").orderBy("node").limit(size).select("vec").toArrow()
        sample = chosen.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        index = Index(unit(sample), cells, threshold, reach)
        links = written(link_rows(written(encoded(mine, index), "codes"), index, block), "links")
        found = links if found is None else found.union(links)
    if found is None:
        found = spark.createDataFrame([], "node long, n long, root long")
    roots = components(found.select(F.col("node").alias("src"), F.col("root").alias("dst")))
    sums = found.groupBy(F.col("node").alias("node2")).agg(F.sum("n").alias("n"))
    placed = nodes.join(sums, nodes.node == sums.node2, "left").join(roots.withColumnRenamed("node", "node3"), F.col("node") == F.col("node3"), "left")
    placed = placed.select("node", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    least = placed.groupBy(F.col("root").alias("root2")).agg(F.min("least").alias("component_id"))
    named = placed.join(least, placed.root == least.root2).select(F.col("node").alias("node4"), "n_links", "component_id")
    linked = keyed.where("node is not null").select("id", "node").join(named, F.col("node") == F.col("node4")).select("id", "n_links", "component_id")
    alone = keyed.where("node is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
