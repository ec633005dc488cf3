"""Embedding near-dedup with an inverted multi-index.

Vectors are normalised and cut into two halves. Each half has a codebook of its own,
trained by Lloyd's iterations over all vectors (a pass sends one sum a centroid and
partition). The product of the codebooks is a grid of cells; a vector lives in the cell
of its nearest centroid in both halves. Equal vectors are one entry.

Every vector is a query. Multi-sequence traversal visits cells in the order of their
distance from it: for a half, the squared distance to the border of the centroid's region
(0 for its own), for a cell the sum of both. It ends at the distance within which the cell
of a near vector lies with a chance of ``target_recall``: the quantile of that distance for
``PROBES`` vectors of the table and a vector made for each at just the similarity asked
for, in a random direction. Visited cells' members are verified by their exact
similarity. A pair's cells are met from the side of the smaller cell number.

Cells in number follow the vectors, ``per_cell`` in each on average. A cell of more than
``BLOCK`` members, or ``BLOCK`` visitors, is split into blocks, each pair of which is met in
a task of its own, so that a group of near copies is held nowhere as a whole. A block gives
sums and a spanning forest of its links, never its pairs.

Result: one row a vector: id, class_id (the smallest id of the vectors it is linked with,
directly or over others) and links (how many other rows are near it).

Defined results: vectors that are null, have a null or non-finite entry or another length
than most (of lengths equally common the smaller counts), and zero vectors are near
nothing: of no link and of their own class; equal vectors are near each other, with equal ids
too; rows with a null id are compared like any, and a class of null ids only has none; an
empty table gives an empty result; other columns, whatever their names, are not read, and a
column of the result that has the id column's name has an underscore appended.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import free_names, materialise
from tessera.llm.probminhash import components

SIMILARITY, TARGET_RECALL = 0.95, 0.995
#: Vectors in a block of a cell at most, on average, and vectors that the end of the traversal is measured on.
BLOCK, PROBES = 4096, 4096


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows of a binary column of ``size`` single-precision numbers each."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, size)


def normalised(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(i id, v bytes of the unit vector, null where it is not usable) of every row, and the dimension."""
    rows = vectors.select(F.col(id_col).alias("i"), F.col(vector_col).cast("array<double>").alias("v"))
    sizes = rows.where("v is not null").groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    n = sizes[0]["n"] if sizes else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            fit = np.flatnonzero(np.diff(lists.offsets.to_numpy()) == n) if n and len(lists) else np.zeros(0, np.int64)
            fit = fit[~np.asarray(lists.is_null())[fit]] if len(fit) else fit
            flat = lists.take(pa.array(fit)).flatten()
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n) if n else np.zeros((0, 1))
            with np.errstate(all="ignore"):
                # scaled first, so that no square is too large or small
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x = (x / np.sqrt((x**2).sum(axis=1, keepdims=True))).astype(np.float32) + np.float32(0)
            out: list[bytes | None] = [None] * len(lists)
            for at, row, ok in zip(fit.tolist(), x, np.isfinite(x).all(axis=1).tolist(), strict=True):
                out[at] = row.tobytes() if ok else None
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["i", "v"])

    return rows.mapInArrow(run, T.StructType([T.StructField("i", vectors.schema[id_col].dataType), T.StructField("v", T.BinaryType())])), n


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances to all centroids and the nearest one's number."""
    d = (x**2).sum(1)[:, None] - 2 * x @ book.T + (book**2).sum(1)[None, :]
    np.maximum(d, 0, out=d)
    return d, d.argmin(1)


def codebooks(rows: DataFrame, n: int, centroids: int, rounds: int = 6) -> list[np.ndarray]:
    """Both halves' centroids, by Lloyd's iterations over all vectors; started from a hash-chosen spread of them."""
    half = n // 2
    start = rows.orderBy(F.xxhash64("v"), "v").limit(centroids).collect()  # as many rows as centroids
    first = np.array([np.frombuffer(r["v"], np.float32) for r in start])
    books = [first[:, :half].copy(), first[:, half:].copy()]

    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], books: list[np.ndarray] = books) -> Iterator[pa.RecordBatch]:
            sums = [np.zeros((len(b), b.shape[1] + 1)) for b in books]
            for batch in batches:
                x = _matrix(batch.column(0), n)
                for h, part in enumerate((x[:, :half], x[:, half:])):
                    _, at = nearest(part, books[h])
                    order = np.argsort(at, kind="stable")
                    new = np.flatnonzero(np.diff(at[order], prepend=-1))
                    if len(new):
                        sums[h][at[order][new]] += np.add.reduceat(np.column_stack([part, np.ones(len(part))])[order], new, axis=0)
            for h in (0, 1):
                used = np.flatnonzero(sums[h][:, -1])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), h)), pa.array(used), pa.array(list(sums[h][used]), pa.list_(pa.float64()))], names=["h", "c", "s"])

        width = max(half, n - half) + 1
        parts = rows.select("v").mapInArrow(run, "h long, c long, s array<double>")
        sums = parts.groupBy("h", "c").agg(F.array(*[F.sum(F.get("s", F.lit(j))) for j in range(width)]).alias("s"))
        new = [b.copy() for b in books]
        for r in sums.collect():  # as many rows as centroids
            dims = books[r["h"]].shape[1]
            new[r["h"]][r["c"]] = np.array(r["s"][:dims]) / r["s"][dims]
        moved = max(float(np.abs(a - b).max()) if a.size else 0.0 for a, b in zip(new, books, strict=True))
        books = new
        if moved < 1e-4:
            break
    return books


def gaps(book: np.ndarray) -> np.ndarray:
    """Distances between centroids."""
    return np.sqrt(np.maximum(nearest(book, book)[0], 1e-12))


def border_distances(d: np.ndarray, own: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """Squared distance from each vector to the hyperplane between its own centroid and each other one; 0 for its own."""
    return ((d - d[np.arange(len(d)), own][:, None]) / (2 * gap[own])) ** 2


def multi_sequence(a: np.ndarray, b: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, i, j) of all places with a[query, i] + b[query, j] of at most ``limit``, by query in ascending order of the sum.

    ``a`` and ``b`` have a query's distances to the centroids of either half as a row.
    """
    qa, ia = np.nonzero(a <= limit)
    qb, jb = np.nonzero(b <= limit)
    # every place of the one half with the places of the other, of the same query
    begin, end = np.searchsorted(qb, qa, side="left"), np.searchsorted(qb, qa, side="right")
    many = end - begin
    left = np.repeat(np.arange(len(qa)), many)
    right = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin, many)
    q, i, j = qa[left], ia[left], jb[right]
    total = a[q, i] + b[q, j]
    keep = np.flatnonzero(total <= limit)
    keep = keep[np.lexsort((total[keep], q[keep]))]
    return q[keep], i[keep], j[keep]


class Grid:
    """The cells, and where the traversal ends."""

    def __init__(self, books: list[np.ndarray], half: int) -> None:
        self.books, self.half, self.limit = books, half, 0.0
        self.gaps = [gaps(b) for b in books]

    def borders(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Own centroids' numbers and distances to the borders of all, for both halves."""
        owns, found = [], []
        for part, book, gap in zip((x[:, : self.half], x[:, self.half :]), self.books, self.gaps, strict=True):
            d, own = nearest(part, book)
            owns.append(own)
            found.append(border_distances(d, own, gap))
        return owns, found

    def home(self, owns: list[np.ndarray]) -> np.ndarray:
        return owns[0].astype(np.int64) * len(self.books[1]) + owns[1]

    def calibrate(self, x: np.ndarray, similarity: float, target_recall: float) -> None:
        """End the traversal where a vector at ``similarity`` from one of ``x`` is met with a chance of ``target_recall``."""
        turn = np.random.default_rng(11).normal(size=x.shape)
        turn -= (turn * x).sum(axis=1, keepdims=True) * x
        turn /= np.maximum(np.linalg.norm(turn, axis=1, keepdims=True), 1e-12)
        near = (similarity * x + math.sqrt(max(0.0, 1 - similarity**2)) * turn).astype(np.float32)
        (ours, a), (theirs, b) = self.borders(x), self.borders(near)
        rows = np.arange(len(x))
        there = sum(d[rows, own] for d, own in zip(a, theirs, strict=True))
        back = sum(d[rows, own] for d, own in zip(b, ours, strict=True))
        # a pair is met from the side of the smaller cell number
        met = np.where(self.home(ours) <= self.home(theirs), there, back)
        self.limit = float(np.quantile(met, target_recall, method="higher")) if len(met) else 0.0

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, whether it lives there) of the cells to visit of a number not below one's own."""
        owns, (a, b) = self.borders(x)
        home = self.home(owns)
        row, i, j = multi_sequence(a, b, self.limit)
        cell = i.astype(np.int64) * len(self.books[1]) + j
        keep = cell >= home[row]
        row, cell = row[keep], cell[keep]
        return row, cell, cell == home[row]


def block_links(x: np.ndarray, home: np.ndarray, n: np.ndarray, similarity: float, inside: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Of members (``home``) with visitors and, if ``inside``, among themselves: how many rows are near each (``n`` rows an entry), and a node that it is
    linked with, directly or over others, such that these join what is linked (-1: none needed).

    Every similarity is computed once, by blocks of rows; those near the bound once more in double precision.
    """
    members, visitors = np.flatnonzero(home), np.flatnonzero(~home)
    links, parent, label = np.zeros(len(x), np.int64), np.full(len(x), -1), np.arange(len(x))

    def root(v: int) -> int:
        while label[v] != v:
            label[v] = label[label[v]]
            v = int(label[v])
        return v

    for lo in range(0, len(members), 512):
        rows = members[lo : lo + 512]
        # members from here on, and visitors: each pair once
        others = np.concatenate([members[lo:], visitors]) if inside else visitors
        s = x[rows] @ x[others].T
        hit = s >= similarity
        a, b = np.nonzero(np.abs(s - similarity) < 1e-5)
        hit[a, b] = np.einsum("ij,ij->i", x[rows[a]].astype(np.float64), x[others[b]].astype(np.float64)) >= similarity
        if inside:
            # a row with itself, and pairs of these rows the second time
            hit[:, : len(rows)] = np.triu(hit[:, : len(rows)], 1)
        if not hit.any():
            continue
        links[rows] += (hit.astype(np.float64) @ n[others]).astype(np.int64)
        links[others] += (n[rows].astype(np.float64) @ hit).astype(np.int64)
        for k in np.flatnonzero(hit.any(axis=1)).tolist():
            to, mine = others[np.flatnonzero(hit[k])], root(int(rows[k]))
            for v in np.unique(label[to]).tolist():
                if (r := root(v)) != mine:
                    label[r] = parent[r] = mine
            label[to] = mine
    return links, parent


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", similarity: float = SIMILARITY, target_recall: float = TARGET_RECALL, per_cell: int = 256, block: int = BLOCK
) -> DataFrame:
    """(id, class_id, links) of every row; see the module."""
    rows, n = normalised(vectors, id_col, vector_col)
    rows = materialise(rows.withColumn("m", F.when(F.col("v").isNotNull(), F.unhex(F.md5("v")))), "vectors")
    entries = materialise(rows.where("v is not null").groupBy("m").agg(F.first("v").alias("v"), F.min("i").alias("i"), F.count("*").alias("n")), "entries")
    count = entries.count()
    per = entries.select("m", "i", "n").withColumns({"root": F.col("m"), "others": F.lit(0).cast("long")})
    if n >= 2 and count > 1:
        links, edges = _links(entries, n, count, similarity, target_recall, per_cell, block)
        of = components(edges.select(F.col("m").alias("u"), F.col("o").alias("v")), "vector-classes")
        per = entries.select("m", "i", "n").join(of.withColumnRenamed("node", "m"), "m", "left").join(links, "m", "left")
        per = per.select("m", "i", "n", F.coalesce("root", "m").alias("root"), F.coalesce("others", F.lit(0)).alias("others"))
    least = per.groupBy("root").agg(F.min("i").alias("class"))
    per = per.join(least, "root").select("m", "class", (F.col("others") + F.col("n") - 1).alias("links"))
    class_col, links_col = free_names(id_col, "class_id", "links")
    out = rows.select("i", "m").join(per, "m", "left")
    return out.select(F.col("i").alias(id_col), F.when(F.col("links").isNull(), F.col("i")).otherwise(F.col("class")).alias(class_col), F.coalesce("links", F.lit(0)).cast("long").alias(links_col))


def _links(entries: DataFrame, n: int, count: int, similarity: float, target_recall: float, per_cell: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(m, others) the rows near each entry, its own left out; (m, o) edges that join the entries of each class."""
    centroids = int(min(max(4, round(math.sqrt(count / per_cell))), count))
    grid = Grid(codebooks(entries, n, centroids), n // 2)
    probes = entries.orderBy(F.xxhash64("m", F.lit("probe")), "m").select("v").limit(PROBES).collect()
    grid.calibrate(np.array([np.frombuffer(r["v"], np.float32) for r in probes]), similarity, target_recall)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                row, cell, home = grid.visits(_matrix(batch.column(1), n))
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(home), *(batch.column(i).take(at) for i in range(3))], names=["cell", "home", "m", "v", "n"])

    def count_visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, len(grid.books[0]) * len(grid.books[1])), np.int64)
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                _, cell, home = grid.visits(_matrix(whole.column(0).slice(lo, 1024), n))
                for h in (0, 1):
                    np.add.at(seen[h], cell[home == bool(h)], 1)
        used = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(seen[1][used]), pa.array(seen[0][used])], names=["cell", "a", "b"])

    visits = entries.select("m", "v", "n").mapInArrow(visit, "cell long, home boolean, m binary, v binary, n long")
    # how many blocks a cell's members and visitors have; of cells that need no splitting nothing is kept
    sizes = entries.select("v").mapInArrow(count_visits, "cell long, a long, b long").groupBy("cell").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    pieces = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / block)).cast("int")
    split = materialise(sizes.select("cell", pieces("a").alias("a"), pieces("b").alias("b")).where("a > 1 or b > 1"), "split-cells")
    told = visits.withColumns({"a": F.lit(1), "b": F.lit(1)}) if split.isEmpty() else visits.join(split, "cell", "left").na.fill(1, ["a", "b"])
    mine = F.pmod(F.xxhash64("m"), F.col("a")).cast("int")
    other = F.pmod(F.xxhash64("m", F.lit("visit")), F.col("b")).cast("int")
    every = F.sequence(F.lit(0), F.col("a") - 1)
    # a member is one of its block's, met by each block of visitors, and visits the blocks after its own
    own = F.transform(F.sequence(F.lit(0), F.col("b") - 1), lambda y: F.struct(mine.alias("x"), y.alias("y"), F.lit(True).alias("live"), (y > 0).alias("again")))
    later = F.transform(F.filter(every, lambda x: x > mine), lambda x: F.struct(x.alias("x"), other.alias("y"), F.lit(False).alias("live"), F.lit(False).alias("again")))
    guest = F.transform(every, lambda x: F.struct(x.alias("x"), other.alias("y"), F.lit(False).alias("live"), F.lit(False).alias("again")))
    placed = told.select("cell", "m", "v", "n", F.explode(F.when(F.col("home"), F.concat(own, later)).otherwise(guest)).alias("p")).select("cell", "p.*", "m", "v", "n")

    def verify(table: pa.Table) -> pa.Table:
        x = _matrix(table.column("v"), n)
        live, again = (table.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("live", "again"))
        weight, ids = table.column("n").to_numpy(), table.column("m").combine_chunks()
        # members among themselves are compared where they meet the first block of visitors only
        links, parent = block_links(x, live, weight, similarity, inside=not again.any())
        at = np.flatnonzero((links > 0) | (parent >= 0))
        over = parent[at]
        partner = ids.take(pa.array(np.where(over >= 0, over, 0), mask=over < 0))
        return pa.table([ids.take(pa.array(at)), pa.array(links[at]), partner], names=["m", "links", "o"])

    found = materialise(placed.groupBy("cell", "x", "y").applyInArrow(verify, "m binary, links long, o binary"), "vector-links")
    return found.groupBy("m").agg(F.sum("links").alias("others")), found.where("o is not null").select("m", "o")
