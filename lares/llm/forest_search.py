"""Nearest vectors by inner product: a forest of random-projection trees, one priority queue, exact reranking.

1. Vectors get one more coordinate that makes all of them as long as the longest, so that the largest inner product
   is the least distance. The longest is known from a first pass over the table.
2. Trunk. A tree of median splits along random directions, fitted on the SAMPLE vectors of least hash of vec_id, deals
   all vectors to cells. It has at most SAMPLE / CELL_SAMPLE cells and is all of the index that is broadcast.
3. Forest. The vectors of a cell meet in one task, a cell of more than CELL_ROWS in pieces by a hash of vec_id. There
   TREES trees of median splits are grown under the cell, down to LEAF vectors, over every vector.
4. Radius. A leaf's price is the sum of the squares by which a query is on the wrong side of the splits above it, in
   trunk and tree. For PROBES queries, those of least hash, all vectors are ranked exactly; a neighbour's price is that
   of its cheapest leaf. The radius is the price that reaches TARGET of these neighbours: a measured recall, at every
   size of the table.
5. Search. Queries go to the cells within the radius. There the trees' roots enter one priority queue; the cheapest
   node is opened first, and its children enter at their prices, until what is left is beyond the radius and k other
   vectors are met; for the same end a query goes to its cheapest cells whatever their price. The vectors of these leaves are ranked by the exact inner product, in double precision, and each cell's first k
   by score, then vec_id, are ranked again.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without vec_id and vectors
of another length than most (the longer at a tie). A query's own vec_id is never its neighbour. Repeated rows are
candidates each; a repeated query row has its results each. Equal scores go by vec_id. A query has k results, or all
candidates if they are fewer, but for cells full of rows of its own vec_id. With no query, no vectors or empty tables
there is no result. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lares.llm.tables import settle

SAMPLE = 1 << 15
#: Vectors of the sample in a cell, at least.
CELL_SAMPLE = 16
CELL_ROWS = 1 << 13
TREES = 4
LEAF = 64
PROBES = 256
TARGET = 0.95
#: Queries that a cell's task ranks at a time.
BLOCK = 1 << 12


class Tree(NamedTuple):
    """Node i splits at normals[i] . x <= cuts[i] into nodes left[i] and right[i]; leaves have left -1 and a number in right."""

    normals: np.ndarray
    cuts: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaves: int


def grow(vectors: np.ndarray, leaf: int, seed: int) -> tuple[Tree, np.ndarray]:
    """A tree over the vectors, and the leaf of each. A node that no direction splits, as of equal vectors, is a leaf."""
    rng = np.random.default_rng(seed)
    normals, cuts, left, right = [], [], [], []
    where = np.zeros(len(vectors), np.int32)
    todo, leaves = [np.arange(len(vectors))], 0
    while len(normals) < len(todo):
        rows = todo[len(normals)]
        normal = rng.normal(size=vectors.shape[1])
        normal /= np.linalg.norm(normal)
        along = vectors[rows] @ normal if len(rows) > leaf else np.zeros(0)
        cut = float(np.median(along)) if len(along) else 0.0
        low = along <= cut
        if len(along) and low.all():  # more than half are at the greatest place
            cut = float(along[along < cut].max(initial=-np.inf))
            low = along <= cut
        normals.append(normal)
        cuts.append(cut)
        if len(along) and low.any():
            left.append(len(todo))
            right.append(len(todo) + 1)
            todo += [rows[low], rows[~low]]
        else:
            where[rows] = leaves
            left.append(-1)
            right.append(leaves)
            leaves += 1
        todo[len(normals) - 1] = rows[:0]
    return Tree(np.array(normals), np.array(cuts), np.array(left), np.array(right), leaves), where


def leaf_of(tree: Tree, vectors: np.ndarray) -> np.ndarray:
    node = np.zeros(len(vectors), np.int64)
    while len(inner := np.flatnonzero(tree.left[node] >= 0)):
        at = node[inner]
        low = np.einsum("ij,ij->i", vectors[inner], tree.normals[at]) <= tree.cuts[at]
        node[inner] = np.where(low, tree.left[at], tree.right[at])
    return tree.right[node]


def leaf_prices(tree: Tree, queries: np.ndarray) -> np.ndarray:
    """The price of every leaf for every query."""
    apart = queries @ tree.normals.T - tree.cuts
    price = np.zeros(apart.shape)
    out = np.empty((len(queries), tree.leaves))
    for i, (low, high) in enumerate(zip(tree.left.tolist(), tree.right.tolist(), strict=True)):
        if low < 0:
            out[:, high] = price[:, i]
        else:
            price[:, low] = price[:, i] + np.maximum(apart[:, i], 0) ** 2
            price[:, high] = price[:, i] + np.maximum(-apart[:, i], 0) ** 2
    return out


def nearest_leaves(
    trees: list[Tree], sizes: list[list[int]], apart: list[list[float]], start: float, radius: float, least: int
) -> list[tuple[int, int]]:
    """(tree, leaf) within the radius, cheapest first, by one queue over all trees.

    Beyond the radius the search goes on until one tree's leaves hold `least` vectors. sizes: vectors of each leaf,
    apart: distances from the splits.
    """
    queue = [(start, t, 0) for t in range(len(trees))]
    found, met = [], [0] * len(trees)
    while queue and (queue[0][0] <= radius or max(met) < least):
        price, t, node = heapq.heappop(queue)
        low, high = trees[t].left[node], trees[t].right[node]
        if low < 0:
            found.append((t, high))
            met[t] += sizes[t][high]
            continue
        d = apart[t][node]
        near, far = (low, high) if d <= 0 else (high, low)
        heapq.heappush(queue, (price, t, near))
        heapq.heappush(queue, (price + d * d, t, far))
    return found


class Space(NamedTuple):
    dim: int
    longest: float

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        """All of the same length."""
        more = np.sqrt(np.maximum(self.longest - np.einsum("ij,ij->i", vectors, vectors), 0))
        return np.column_stack([vectors, more])

    def asked(self, vectors: np.ndarray) -> np.ndarray:
        """Queries in the lifted space, as long as the vectors there."""
        sizes = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        return np.column_stack([vectors * (np.sqrt(self.longest) / sizes)[:, None], np.zeros(len(vectors))])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def valid_vectors(table: DataFrame, key: str, vector: str) -> DataFrame:
    """vec_id and vector (doubles) of the rows whose vector is neither null nor zero and has finite components only."""
    v = table[vector].cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = sound & F.exists(v, lambda x: x != 0)
    return table.select(table[key].cast("bigint").alias("vec_id"), v.alias("vector")).filter(some & F.col("vec_id").isNotNull())


def space_of(rows: DataFrame) -> Space | None:
    """The most frequent length of the vectors, and the square of the greatest norm of those."""
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    first = (
        rows.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n"), F.max(square).alias("longest"))
        .orderBy(F.desc("n"), F.desc("dim")).first()
    )
    return Space(first["dim"], first["longest"]) if first else None


def _least_hashes(rows: DataFrame, n: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """vec_ids and vectors of the n rows of least hash of vec_id. Only rows whose hash can be among the least are sorted."""
    total = rows.count()
    if total > 4 * n:
        rows = rows.filter(F.shiftrightunsigned(F.xxhash64("vec_id"), 1) < int(2**63 * 2 * n / total))
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n).select("vec_id", "vector").toArrow()
    return chosen.column("vec_id").to_numpy(), _matrix(chosen.column("vector"), dim)


def dealt(rows: DataFrame, space: Space, trunk: Tree) -> DataFrame:
    """vec_id, vector and cell of each row."""
    shared = rows.sparkSession.sparkContext.broadcast(trunk)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column("vector"), space.dim)
            cell = pa.array(leaf_of(shared.value, space.lifted(vectors)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vector"), cell], ["vec_id", "vector", "cell"])

    return rows.select("vec_id", "vector").mapInArrow(run, "vec_id long, vector array<double>, cell int")


class Cell:
    """The vectors of one piece of a cell, in the order of their ids, and the trees over them."""

    def __init__(self, cell: int, piece: int, ids: np.ndarray, vectors: np.ndarray, space: Space):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        lifted = space.lifted(self.vectors)
        self.trees, self.leaf = [], []
        for t in range(TREES):
            tree, where = grow(lifted, LEAF, seed=(cell * 1_000_003 + piece) * TREES + t)
            self.trees.append(tree)
            self.leaf.append(where)
        self.members = []
        for tree, where in zip(self.trees, self.leaf, strict=True):
            by = np.argsort(where, kind="stable")
            self.members.append(np.split(by, np.cumsum(np.bincount(where, minlength=tree.leaves))[:-1]))

    def first(self, rows: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the k nearest among some rows in ascending order, by score, then vec_id."""
        rows = rows[self.ids[rows] != own]
        # Row by row in the same order of additions, so that equal vectors have equal scores.
        scores = (self.vectors[rows] * query).sum(1)
        if len(rows) > k:
            some = scores >= np.partition(scores, len(rows) - k)[len(rows) - k]
            rows, scores = rows[some], scores[some]
        order = np.argsort(-scores, kind="stable")[:k]
        return rows[order], scores[order]


_NEAR = pa.schema([("place", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("price", pa.float64())])
_NEAR_SQL = "place long, vec_id long, score double, price double"


def _near(places: list, ids: list, scores: list, prices: list) -> pa.Table:
    columns = [np.concatenate([np.zeros(0, t), *c]) for c, t in ((places, np.int64), (ids, np.int64), (scores, float), (prices, float))]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _NEAR, strict=True)], schema=_NEAR)


def _cell_of(key: tuple[pa.Scalar, ...], table: pa.Table, space: Space) -> Cell:
    return Cell(key[0].as_py(), key[1].as_py(), table.column("vec_id").to_numpy(), _matrix(table.column("vector"), space.dim), space)


def measured_radius(cells: DataFrame, queries: tuple[np.ndarray, np.ndarray], space: Space, trunk: Tree, k: int) -> float:
    """The price within which TARGET of the true neighbours of some queries are found."""
    shared = cells.sparkSession.sparkContext.broadcast((*queries, leaf_prices(trunk, space.asked(queries[1]))))

    def rank_all(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids, vectors, trunk_prices = shared.value
        cell = _cell_of(key, table, space)
        prices = [leaf_prices(tree, space.asked(vectors)) for tree in cell.trees]
        everyone = np.arange(len(cell.ids))
        out: tuple[list, ...] = ([], [], [], [])
        for i, own in enumerate(ids):
            rows, scores = cell.first(everyone, vectors[i], own, k)
            least = np.min([p[i][where[rows]] for p, where in zip(prices, cell.leaf, strict=True)], axis=0)
            for column, values in zip(out, (np.full(len(rows), i), cell.ids[rows], scores, least + trunk_prices[i, key[0].as_py()]), strict=True):
                column.append(values)
        return _near(*out)

    ranked = cells.groupBy("cell", "piece").applyInArrow(rank_all, _NEAR_SQL)
    found = _first_k(ranked, k).select("price").toArrow().column("price").to_numpy()
    return float(np.quantile(found, TARGET, method="higher")) if len(found) else 0.0


def _first_k(near: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("place").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _piece(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """With the piece of its cell; sizes: at most one row a cell of the trunk."""
    pieces = F.broadcast(sizes.select("cell", F.ceil(F.col("n") / CELL_ROWS).cast("int").alias("pieces")))
    joined = rows.join(pieces, "cell")
    return joined.withColumn("piece", F.pmod(F.xxhash64("vec_id"), F.col("pieces")).cast("int")).drop("pieces")


def _asked(queries: DataFrame, sizes: DataFrame, space: Space, trunk: Tree, radius: float, least: int) -> DataFrame:
    """Each query at each piece of the cells within the radius, and of the cheapest ones that hold `least` vectors together,
    with the cell's price."""
    rows_of = np.zeros(trunk.leaves, np.int64)
    for cell, n in sizes.select("cell", "n").collect():
        rows_of[cell] = n
    shared = queries.sparkSession.sparkContext.broadcast((trunk, rows_of))
    names = ["place", "vec_id", "vector", "cell", "start"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trunk, rows_of = shared.value
            prices = leaf_prices(trunk, space.asked(_matrix(batch.column("vector"), space.dim)))
            order = np.argsort(prices, axis=1, kind="stable")
            before = np.cumsum(rows_of[order], axis=1) - rows_of[order]
            wanted = prices <= radius
            np.put_along_axis(wanted, order, np.take_along_axis(wanted, order, 1) | (before < least), 1)
            row, cell = np.nonzero(wanted)
            columns = [batch.column(c).take(pa.array(row)) for c in names[:3]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(cell.astype(np.int32)), pa.array(prices[row, cell])], names)

    sent = queries.select(names[:3]).mapInArrow(run, "place long, vec_id long, vector array<double>, cell int, start double")
    pieces = sizes.select("cell", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / CELL_ROWS).cast("int") - 1)).alias("piece"))
    return sent.join(F.broadcast(pieces), "cell")


def _search_cell(space: Space, radius: float, k: int):
    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, ...] = ([], [], [], [])
        if not left.num_rows or not right.num_rows:
            return _near(*out)
        cell = _cell_of(key, left, space)
        sizes = [[len(m) for m in members] for members in cell.members]
        for at in range(0, right.num_rows, BLOCK):
            block = right.slice(at, BLOCK)
            places, own, starts = (block.column(c).to_numpy() for c in ("place", "vec_id", "start"))
            vectors = _matrix(block.column("vector"), space.dim)
            asked = space.asked(vectors)
            apart = [asked @ tree.normals.T - tree.cuts for tree in cell.trees]
            for i in range(len(places)):
                leaves = nearest_leaves(cell.trees, sizes, [a[i].tolist() for a in apart], float(starts[i]), radius, k + 1)
                rows = np.zeros(len(cell.ids), bool)
                rows[np.concatenate([cell.members[t][leaf] for t, leaf in leaves])] = True
                rows, scores = cell.first(np.flatnonzero(rows), vectors[i], own[i], k)
                for column, values in zip(out, (np.full(len(rows), places[i]), cell.ids[rows], scores, np.zeros(len(rows))), strict=True):
                    column.append(values)
        return _near(*out)

    return run


def _nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def neighbours(table: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found of each row for which is_query (of vec_id) holds."""
    spark = table.sparkSession
    every = valid_vectors(table, key, vector)
    space = space_of(every)
    if space is None:
        return _nothing(spark)
    rows = every.filter(F.size("vector") == space.dim)
    queries = settle(rows.filter(is_query).withColumn("place", F.monotonically_increasing_id()))
    probes = _least_hashes(queries, PROBES, space.dim)
    if not len(probes[0]):
        return _nothing(spark)
    sample = _least_hashes(rows, SAMPLE, space.dim)[1]
    total = rows.count()
    wanted = max(CELL_SAMPLE, -(-len(sample) * CELL_ROWS // (2 * total)) if total > CELL_ROWS else len(sample))
    trunk, _ = grow(space.lifted(sample), wanted, seed=0)
    placed = dealt(rows, space, trunk)
    sizes = settle(placed.groupBy("cell").agg(F.count("*").alias("n")))
    cells = _piece(placed, sizes)
    radius = measured_radius(cells, probes, space, trunk, k)
    sent = _asked(queries, sizes, space, trunk, radius, k + 1)
    found = cells.groupBy("cell", "piece").cogroup(sent.groupBy("cell", "piece")).applyInArrow(_search_cell(space, radius, k), _NEAR_SQL)
    ranked = _first_k(found, k).join(queries.select("place", F.col("vec_id").alias("query_id")), "place")
    return ranked.select("query_id", "rank", "vec_id", "score")
