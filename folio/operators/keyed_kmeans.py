"""K-means within each of many parent clusters at once: centres are keyed by (parent, start, child)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.sources.staging import stage

CHUNK_BYTES = 1 << 23
BROADCAST_BYTES = 1 << 24
CLOSE, CLOSE_SHARE = 1e-8, 1e-5


def chunked(points: DataFrame, parents: DataFrame) -> DataFrame:
    """(parent, chunk, wide, terms, xs): the points (term, vec) of each parent in rows of at most about ``CHUNK_BYTES``, vectors one after the other; staged."""
    rows = points.select("term", "vec").join(parents.select("term", F.col("cluster").alias("parent")), "term").withColumn("wide", F.size("vec"))
    sizes = rows.groupBy("parent").agg(F.ceil(F.count("*") * F.max("wide") * 8 / CHUNK_BYTES).cast("int").alias("chunks"))
    dealt = rows.join(sizes, "parent").withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int"))
    lists = dealt.groupBy("parent", "chunk", "wide").agg(F.array_sort(F.collect_list(F.struct("term", "vec"))).alias("rows"))
    return stage(lists.select("parent", "chunk", "wide", F.col("rows.term").alias("terms"), F.flatten("rows.vec").alias("xs")), "chunks")


def first_centres(chunks: DataFrame, k: int, starts: int, seed: int) -> DataFrame:
    """(parent, start, n_centres, wide, centres): for each start ``k`` points of the parent, or as many as there are, drawn by a hash."""
    zipped = chunks.select("parent", "wide", "xs", F.posexplode("terms").alias("i", "term"))
    drawn = zipped.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(starts - 1)))).withColumn("key", F.xxhash64("term", F.col("start") + seed))
    order = Window.partitionBy("parent", "start").orderBy("key", "term")
    drawn = drawn.select("parent", "start", "wide", "term", "key", F.slice("xs", F.col("i") * F.col("wide") + 1, F.col("wide")).alias("x"))
    drawn = drawn.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k)
    lists = drawn.groupBy("parent", "start", "wide").agg(F.array_sort(F.collect_list(F.struct("r", "x"))).alias("xs"))
    return lists.select("parent", "start", F.size("xs").alias("n_centres"), "wide", F.flatten("xs.x").alias("centres"))


def _near(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, float]:
    """The nearest centre of each point, the smaller number if equal, and the sum of squared distances."""
    near = ((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)).argmin(1)
    return near, float(((x - centres[near]) ** 2).sum())


def _met(chunks: DataFrame, centres: DataFrame, columns: list[str]) -> DataFrame:
    """The chunks with the centres of all starts of their parent; parents' centres are broadcast up to a checked size."""
    held = stage(centres.groupBy("parent").agg(F.collect_list(F.struct("start", "n_centres", "centres")).alias("runs")), "runs")
    size = held.select(F.coalesce(F.sum(F.aggregate("runs", F.lit(0).cast("long"), lambda s, r: s + 8 * F.size(r["centres"]))), F.lit(0))).first()[0]
    return chunks.select("parent", "wide", *columns).join(F.broadcast(held) if size <= BROADCAST_BYTES else held, "parent")


def keyed_step(chunks: DataFrame, centres: DataFrame) -> DataFrame:
    """(parent, start, cost, ns, sums): of each centre how many points are nearest to it and their sum; ``cost`` is that of the centres given.

    Points are added up inside their chunk, then chunk by chunk in the aggregate.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["parent", "start", "cost", "ns", "sums"], [pa.int64(), pa.int32(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        for batch in batches:
            xs, out = batch.column("xs"), []
            for row, (parent, wide, runs) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("parent", "wide", "runs")))):
                x = xs[row].values.to_numpy().reshape(-1, wide)
                for run in runs:
                    held = np.array(run["centres"]).reshape(-1, wide)
                    near, cost = _near(x, held)
                    total = np.zeros_like(held)
                    np.add.at(total, near, x)
                    out.append((parent, run["start"], cost, np.bincount(near, minlength=len(held)).astype(float), total.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 5, types)], names)

    rows = _met(chunks, centres, ["xs"]).mapInArrow(sums, "parent long, start int, cost double, ns array<double>, sums array<double>")
    added = rows.groupBy("parent", "start").agg(F.sum("cost").alias("cost"), Summarizer.sum(array_to_vector("ns")).alias("ns"), Summarizer.sum(array_to_vector("sums")).alias("sums"))
    return added.select("parent", "start", "cost", vector_to_array("ns").alias("ns"), vector_to_array("sums").alias("sums"))


def moved(centres: DataFrame, sums: DataFrame) -> DataFrame:
    """The centres at the means of their points, those without a point where they were; ``open``: one of the run has moved."""
    joined = centres.join(sums, ["parent", "start"])
    child = lambda i: F.get("ns", F.floor(i / F.col("wide")).cast("int"))
    mean = F.transform("centres", lambda c, i: F.when(child(i) > 0, F.get("sums", i) / child(i)).otherwise(c))
    joined = joined.withColumn("means", mean)
    apart = F.exists(F.zip_with("means", "centres", lambda a, b: F.abs(a - b) > CLOSE + CLOSE_SHARE * F.abs(a)), lambda x: x)
    return joined.select("parent", "start", "n_centres", "wide", F.col("means").alias("centres"), apart.alias("open"))


def hierarchical_kmeans(points: DataFrame, parents: DataFrame, k: int = 100, rounds: int = 50, starts: int = 10, seed: int = 1) -> DataFrame:
    """(term, cluster) with cluster = parent * k + child: the best of ``starts`` k-means runs within each parent cluster.

    All parents and starts move together, a round being one job; runs that stand still leave the rounds. A parent's
    points are rows of bounded size, so a parent may hold most of them.
    """
    chunks = chunked(points, parents)
    centres = stage(first_centres(chunks, k, starts, seed), "centres")
    done = None
    for r in range(rounds):
        now = stage(moved(centres, keyed_step(chunks, centres)), "centres")
        still = now.filter("not open").drop("open")
        done = still if done is None else done.union(still)
        centres = now.filter("open").drop("open")
        if centres.isEmpty():
            break
    ended = stage(centres if done is None else done.union(centres), "ended")
    costs = keyed_step(chunks, ended).groupBy("parent").agg(F.min(F.struct("cost", "start")).alias("best"))
    best = ended.join(costs.select("parent", "best.start"), ["parent", "start"])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, (parent, wide, runs) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("parent", "wide", "runs")))):
                near, _ = _near(batch.column("xs")[row].values.to_numpy().reshape(-1, wide), np.array(runs[0]["centres"]).reshape(-1, wide))
                yield pa.RecordBatch.from_arrays([batch.column("terms")[row].values, pa.array(parent * k + near, pa.int64())], ["term", "cluster"])

    return _met(chunks, best, ["terms", "xs"]).mapInArrow(label, "term string, cluster long")
