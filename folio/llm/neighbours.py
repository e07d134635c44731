"""Operator 4: nearest neighbours by a hierarchical k-means tree with best-bin-first search.

The tree is fitted on the driver to at most ``SAMPLE`` vectors, taken by the order of a hash of
vec_id: each node is split into ``BRANCHES`` clusters until a leaf stands for about ``LEAF_ROWS``
rows of the table (the number of leaves is bounded by the sample). Every row of the table goes to the
leaf that greedy descent finds. A query opens nodes through a priority queue, nearest centre first,
and visits the leaves in that order. How many it visits is calibrated: for ``CALIBRATION`` vectors the
exact neighbours are found by brute force over all rows in blocks, and visits are widened until
``TARGET`` of them lie in the visited leaves. A query goes on until its leaves hold enough rows.

Leaves are cells of at most about ``CELL_ROWS`` rows; a leaf that holds more (one vector repeated a
million times, say) is split by a hash of vec_id, and queries that visit it go to all its cells. Each
cell returns the best k of each query; the best of these are the result. Distances are computed as
differences in double precision, ties go to the smaller vec_id.

Vectors that are null, zero, of another dimension than most (the smaller one if equal), or that hold null or
non-finite components take no part, nor do rows with a null vec_id. Repeated rows are candidates as
often as they come, and one query (of different vectors with one vec_id, the smallest in order). Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.shared import stage

SAMPLE = 20_000
BRANCHES = 8
LEAF_ROWS = 200
CELL_ROWS = 8_192
#: Visits that a task holds at once, and queries of a task that lists visits.
VISITS, ASKING = 1 << 16, 512
CALIBRATION = 64
TARGET = 0.97
FOUND = "query_id long, vec_id long, score double"


def usable(table: DataFrame) -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part."""
    vector = F.col("embedding").cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fine = F.col("vec_id").isNotNull() & vector.isNotNull() & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0)
    return table.filter(fine).select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))


@dataclass
class Tree:
    """Nodes by number, the root is 0; a node without children is a leaf."""

    centres: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row by greedy descent."""
        out, todo = np.zeros(len(x), np.int32), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                out[rows] = node
                continue
            near = _distances(x[rows], np.stack([self.centres[c] for c in self.children[node]])).argmin(1)
            todo += [(c, rows[near == k]) for k, c in enumerate(self.children[node]) if (near == k).any()]
        return out

    def visits(self, q: np.ndarray) -> Iterator[int]:
        """Leaves in best-bin-first order."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                yield node
                continue
            kids = self.children[node]
            for d, c in zip(_distances(q[None], np.stack([self.centres[c] for c in kids]))[0].tolist(), kids):
                heapq.heappush(queue, (d, c))


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances up to rounding; only the order of centres is read from them."""
    return (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)


def _clusters(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    centres = [x[rng.integers(len(x))]]
    gap = _distances(x, centres[0][None])[:, 0].clip(0)
    for _ in range(k - 1):  # k-means++ seeds
        if gap.sum() <= 1e-12 * len(x):
            break
        centres.append(x[rng.choice(len(x), p=gap / gap.sum())])
        gap = np.minimum(gap, _distances(x, centres[-1][None])[:, 0].clip(0))
    centres = np.stack(centres)
    for _ in range(rounds):
        near = _distances(x, centres).argmin(1)
        sums, n = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres, _distances(x, centres).argmin(1)


def fit_tree(x: np.ndarray, leaf_size: int, seed: int = 7) -> Tree:
    rng, tree = np.random.default_rng(seed), Tree([x.mean(0)], [[]])
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if len(rows) <= max(leaf_size, 2):
            continue
        centres, near = _clusters(x[rows], BRANCHES, rng)
        groups = [rows[near == k] for k in range(len(centres))]
        if sum(len(g) > 0 for g in groups) < 2:
            continue  # equal vectors
        for centre, group in zip(centres, groups):
            if len(group):
                tree.centres.append(centre)
                tree.children.append([])
                tree.children[node].append(len(tree.centres) - 1)
                todo.append((len(tree.centres) - 1, group))
    return tree


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _nearest(queries: list[tuple[int, np.ndarray]], ids: np.ndarray, x: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    out = []
    for query_id, q in queries:
        score = np.sqrt(((x - q) ** 2).sum(1))
        other = np.flatnonzero(ids != query_id)
        best = other[np.lexsort((ids[other], score[other]))[:k]]
        out += [(query_id, int(ids[i]), float(score[i])) for i in best]
    return out


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> list[pa.Array]:
    return [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * len(names), types)]


FOUND_NAMES, FOUND_TYPES = ["query_id", "vec_id", "score"], [pa.int64(), pa.int64(), pa.float64()]


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(rows: DataFrame, queries: list[tuple[int, np.ndarray]], k: int) -> DataFrame:
    """The exact neighbours of a bounded list of queries; each block of rows returns its best k."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = _nearest(queries, batch.column(0).to_numpy(), _matrix(batch.column(1)), k)
                yield pa.RecordBatch.from_arrays(_table(found, FOUND_NAMES, FOUND_TYPES), FOUND_NAMES)

    return _best(rows.select("vec_id", "vector").mapInArrow(scan, FOUND), k)


def nearest(table: DataFrame, is_query: Column, k: int = 10, target: float = TARGET) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the ``k`` nearest found for each query.

    Queries are the rows of ``table`` that fulfil ``is_query``; candidates are all rows but the
    query's own.
    """
    rows = usable(table)
    sizes = rows.groupBy(F.size("vector").alias("wide")).agg(F.count("*").alias("n"))
    most_frequent = sizes.orderBy(F.desc("n"), "wide").first()
    if not most_frequent:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    wide, n = most_frequent["wide"], most_frequent["n"]
    rows = rows.filter(F.size("vector") == wide)
    taken = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    x = np.stack(taken["vector"].to_numpy())
    apart = CALIBRATION if len(x) > 8 * CALIBRATION else 0  # vectors to calibrate with aren't fitted to
    tree = fit_tree(x[apart:], max(4, round(LEAF_ROWS * len(x) / n)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = tree.leaves_of(_matrix(batch.column(1))) if batch.num_rows else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaves)], ["vec_id", "vector", "leaf"])

    placed = stage(rows.mapInArrow(place, "vec_id long, vector array<double>, leaf int"), "leaves")
    sizes = {r["leaf"]: r["count"] for r in placed.groupBy("leaf").count().collect()}  # at most SAMPLE / 2 leaves
    parts = {leaf: -(-size // CELL_ROWS) for leaf, size in sizes.items()}

    tests = list(zip(taken["vec_id"].tolist()[:CALIBRATION], x[:CALIBRATION]))
    exact = brute_force(placed, tests, k).join(placed.select("vec_id", "leaf"), "vec_id").select("query_id", "leaf").collect()
    order = {i: {leaf: at for at, leaf in enumerate(tree.visits(q))} for i, q in tests}
    needed = sorted(order[r["query_id"]][r["leaf"]] + 1 for r in exact)
    most = needed[min(len(needed) - 1, int(np.ceil(target * len(needed))))] if needed else 1

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["query_id", "leaf", "part", "home", "q"]

        def listed(batch: pa.RecordBatch, out: list[tuple], source: list[int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*_table(out, names[:4], [pa.int64(), pa.int32(), pa.int32(), pa.bool_()]), batch.column(1).take(pa.array(source, pa.int64()))], names)

        for batch in batches:
            out, source = [], []
            for i, (query_id, q) in enumerate(zip(batch.column(0).to_pylist(), _matrix(batch.column(1)))):
                held = 0
                for at, leaf in enumerate(tree.visits(q)):
                    if at >= most and held > k:
                        break
                    home = held <= k
                    held += sizes.get(leaf, 0)
                    for part in range(parts.get(leaf, 0)):
                        out.append((query_id, leaf, part, home))
                        source.append(i)
                        if len(out) >= VISITS:
                            yield listed(batch, out, source)
                            out, source = [], []
            yield listed(batch, out, source)

    queries = placed.filter(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    queries = stage(queries, "queries")
    queries = queries.repartition(-(-queries.count() // ASKING) or 1, "vec_id")  # many visits come of one query
    asked = queries.mapInArrow(visit, "query_id long, leaf int, part int, home boolean, q array<double>")
    split = [(leaf, p) for leaf, p in parts.items() if p > 1]  # leaves over CELL_ROWS rows
    if split:
        more = table.sparkSession.createDataFrame(split, "leaf int, parts int")  # at most SAMPLE rows
        part = F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
        cells = placed.join(F.broadcast(more), "leaf", "left").select("vec_id", "vector", "leaf", part.alias("part"))
    else:
        cells = placed.withColumn("part", F.lit(0))

    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            left, right = left.combine_chunks(), right.combine_chunks()
            ids, vectors = right["query_id"].to_pylist(), _matrix(right["q"].chunk(0))
            bounds = dict(zip(ids, right["bound"].to_pylist()))
            near = _nearest(list(zip(ids, vectors)), left["vec_id"].to_numpy(), _matrix(left["vector"].chunk(0)), k)
            found = [row for row in near if row[2] <= bounds[row[0]]]
        return pa.table(_table(found, FOUND_NAMES, FOUND_TYPES), FOUND_NAMES)

    def searched(visits: DataFrame) -> DataFrame:
        return cells.groupBy("leaf", "part").cogroup(visits.groupBy("leaf", "part")).applyInArrow(search, FOUND)

    # the first leaves, with more than k rows, give a bound; what lies beyond it elsewhere can't be among the best
    columns = ["query_id", "leaf", "part", "q", "bound"]
    nothing = F.lit(float("inf"))
    first = searched(asked.filter("home").withColumn("bound", nothing).select(*columns))
    bounds = _best(first, k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
    later = asked.filter("not home").join(bounds, "query_id", "left").withColumn("bound", F.coalesce("bound", nothing))
    return _best(first.union(searched(later.select(*columns))), k)
