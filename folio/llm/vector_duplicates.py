"""Operator 12: near-duplicate embeddings by hierarchical navigable small-world graphs per shard.

1. Exact copies of a vector are one node (its smallest vec_id, how many), so a group of a million copies costs no search.
2. Nodes are dealt to shards by a hash, ``SHARDS`` at least and about ``SHARD_BYTES`` of vectors at most. A shard's graph
   has layers of 1/16 of the nodes each; layers are built from the top by batches of insertions, each
   searched from the layer above, with the usual choice of diverse neighbours. Copies that drifted apart are dealt
   evenly too.
3. Each shard audits its own beam: ``AUDITS`` of its vectors, turned by exactly the angle of the threshold, must find the
   vector they come from and all others within the threshold (by brute force in the shard). The beam doubles until
   a share of ``RECALL`` is found.
4. Every shard is searched for the nodes of all shards, each pair of shards in one direction. A query whose beam holds
   nothing but links goes on with a wider one; a beam over an eighth of the shard is the whole shard, in blocks of ``BATCH`` queries
   whose links are added up before the next block: a group that fills the shard never stands in memory as pairs.
5. Links are verified by cosine in double precision. A task returns sums of links for each node and a star for each of its own
   components, so a large group makes no rows by pairs. ``connected_components`` unites the stars.

The number of pairs of shards grows with the square of the shards: that is querying every shard. Vectors of
different length are in different shards and never linked.

Nulls: vectors that are null, zero, or hold null or non-finite components, and rows with a null vec_id, link with nothing
(n_links 0; without a vec_id component_id is null and kept true). A repeated row is another vector: its copies
count as links and share the verdict. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.shared import stage
from folio.operators.components import connected_components

COSINE = 0.9
SHARDS = 8
SHARD_BYTES = 1 << 24
LINKS, SLACK = 16, 16  # links of a node in the upper layers, twice as many in the lowest; free places before they are chosen anew
BUILD_BEAM, BEAM = 48, 32
STEP = 4  # nodes of a beam opened at once
BATCH = 256
AUDITS, RECALL = 256, 0.999
GRAPH = "wide int, shard int, beam int, sizes array<int>, links binary, low binary, key binary, copies binary, vectors binary"
FOUND = "low long, key long, to_low long, to_key long, n long"


@dataclass
class Graph:
    """Unit vectors in the order of insertion; layer k holds the first ``len(links[k])`` of them."""

    x: np.ndarray
    links: list[np.ndarray]


def beam_search(x: np.ndarray, links: np.ndarray, enter: np.ndarray, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes (-1: none) and similarities of the best ``beam`` found for each row of ``q``, best first.

    All rows advance together: each opens its ``STEP`` best unopened nodes, until its beam has none.
    """
    rows, n = len(q), len(links)
    beam = min(beam, n)
    seen = np.zeros((rows, n), bool)
    sims = np.where(enter >= 0, np.einsum("bed,bd->be", x[enter], q), np.float32(-2))
    r, c = np.nonzero(enter >= 0)
    seen[r, enter[r, c]] = True
    pad = max(0, beam - enter.shape[1])
    ids = np.pad(enter, ((0, 0), (0, pad)), constant_values=-1)
    sims = np.pad(sims, ((0, 0), (0, pad)), constant_values=-2)
    unopened = ids >= 0
    out_ids, out_sims, who = np.full((rows, beam), -1), np.full((rows, beam), np.float32(-2)), np.arange(rows)
    while len(who):
        ready = np.where(unopened, sims, np.float32(-3))
        step = min(STEP, ready.shape[1])
        pick = np.argpartition(-ready, step - 1, axis=1)[:, :step]
        go = np.take_along_axis(unopened, pick, 1)
        ended = ~go.any(1)
        if ended.any():
            width = min(beam, ids.shape[1])
            order = np.argsort(-sims[ended], axis=1)[:, :width]
            out_ids[who[ended], :width], out_sims[who[ended], :width] = np.take_along_axis(ids[ended], order, 1), np.take_along_axis(sims[ended], order, 1)
            on = ~ended
            who, ids, sims, unopened, pick, go = who[on], ids[on], sims[on], unopened[on], pick[on], go[on]
            if not len(who):
                break
        np.put_along_axis(unopened, pick, False, 1)
        opened = np.where(go, np.take_along_axis(ids, pick, 1), -1)
        near = np.where(opened[:, :, None] >= 0, links[opened], -1).reshape(len(who), -1)
        near.sort(axis=1)
        fresh = near >= 0
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        r, c = np.nonzero(fresh)
        new = ~seen[who[r], near[r, c]]
        r, c = r[new], c[new]
        seen[who[r], near[r, c]] = True
        most = int(np.bincount(r, minlength=len(who)).max(initial=0))
        if most:
            first = np.searchsorted(r, np.arange(len(who)))
            met, met_sims = np.full((len(who), most), -1), np.full((len(who), most), np.float32(-2))
            spot = np.arange(len(r)) - first[r]
            met[r, spot] = near[r, c]
            met_sims[r, spot] = np.einsum("ij,ij->i", x[near[r, c]], q[who[r]])
            ids, sims, unopened = np.concatenate([ids, met], 1), np.concatenate([sims, met_sims], 1), np.concatenate([unopened, met >= 0], 1)
            if ids.shape[1] > beam:
                keep = np.argpartition(-sims, beam - 1, axis=1)[:, :beam]
                ids, sims, unopened = (np.take_along_axis(v, keep, 1) for v in (ids, sims, unopened))
    return out_ids, out_sims


def choose(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` diverse nodes of each row of candidates: those nearer to the row's node than to one chosen before, filled up with the nearest others."""
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    v = x[ids]
    between = v @ v.transpose(0, 2, 1)
    kept, near = np.zeros(ids.shape, bool), np.full(sims.shape, np.float32(-2))
    for c in range(ids.shape[1]):
        kept[:, c] = (ids[:, c] >= 0) & (near[:, c] < sims[:, c]) & (kept.sum(1) < most)
        near = np.where(kept[:, c, None], np.maximum(near, between[:, c]), near)
    rank = np.argsort(np.where(ids < 0, 2, ~kept), axis=1, kind="stable")[:, :most]
    return np.take_along_axis(ids, rank, 1)


def _entries(x: np.ndarray, above: list[np.ndarray], q: np.ndarray) -> np.ndarray:
    """Up to four nodes for each row of ``q`` to enter the next layer by; ``above`` is ordered from the layer just above to the top."""
    enter = np.zeros((len(q), 1), np.int64)
    for links in reversed(above):
        enter = beam_search(x, links, enter, q, 2 * STEP)[0][:, :STEP]
    return enter


def _add_back(x: np.ndarray, links: np.ndarray, width: int, new: np.ndarray, chosen: np.ndarray) -> None:
    """Links from the chosen nodes back to the new ones; a node without free places chooses anew."""
    r, c = np.nonzero(chosen >= 0)
    ends, starts = chosen[r, c], new[r]
    order = np.lexsort((-np.einsum("ij,ij->i", x[ends], x[starts]), ends))
    ends, starts = ends[order], starts[order]
    nodes, first, counts = np.unique(ends, return_index=True, return_counts=True)
    spot = np.arange(len(ends)) - np.repeat(first, counts)
    few = spot < links.shape[1]  # the nearest first
    row = np.repeat(np.arange(len(nodes)), counts)[few]
    more = np.full((len(nodes), min(links.shape[1], int(counts.max(initial=0)))), -1)
    more[row, spot[few]] = starts[few]
    joined = np.concatenate([links[nodes], more], 1)
    joined = np.take_along_axis(joined, np.argsort(joined < 0, axis=1, kind="stable"), 1)
    over = (joined >= 0).sum(1) > links.shape[1]
    links[nodes[~over]] = joined[~over, : links.shape[1]]
    for part in np.array_split(np.flatnonzero(over), max(1, int(over.sum()) // 1024)):
        if len(part):
            sims = np.where(joined[part] >= 0, np.einsum("bcd,bd->bc", x[joined[part]], x[nodes[part]]), np.float32(-2))
            links[nodes[part]] = -1
            links[nodes[part], :width] = choose(x, joined[part], sims, width)


def _layer(x: np.ndarray, n: int, width: int, above: list[np.ndarray]) -> np.ndarray:
    links, done = np.full((n, width + SLACK), -1), 0
    while done < n:
        size = min(n - done, max(BATCH // 4, min(done, 2 * BATCH)))
        new = np.arange(done, done + size)
        own = x[new] @ x[new].T
        np.fill_diagonal(own, -2)
        few = min(BUILD_BEAM // 2, size - 1)
        near = np.argpartition(-own, max(few - 1, 0), axis=1)[:, :few]
        ids, sims = near + done, np.take_along_axis(own, near, 1)
        if done:
            enter = _entries(x, above, x[new])
            enter[enter >= done] = -1
            enter[(enter < 0).all(1), 0] = 0
            held, held_sims = beam_search(x, links[:done], enter, x[new], BUILD_BEAM)
            ids, sims = np.concatenate([held, ids], 1), np.concatenate([held_sims, sims], 1)
        if ids.shape[1]:
            chosen = choose(x, ids, sims, width)
            links[new, : chosen.shape[1]] = chosen
            _add_back(x, links, width, new, chosen[:, : max(1, width // 2)])
        done += size
    return links


def build_graph(x: np.ndarray) -> Graph:
    sizes = [len(x)]
    while sizes[-1] > BATCH // 4:
        sizes.append(sizes[-1] // LINKS)
    links: list[np.ndarray] = []  # from the top
    for k in reversed(range(len(sizes))):
        links.insert(0, _layer(x, sizes[k], LINKS if k else 2 * LINKS, links))
    return Graph(x, links)


def beam_links(graph: Graph, q: np.ndarray, beam: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, node) of what is found with at least ``least``, and the rows whose beam would be over an eighth of the shard."""
    rows, nodes, wide = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for begin in range(0, len(q), BATCH):
        todo, width = np.arange(begin, min(begin + BATCH, len(q))), beam
        while len(todo) and (8 * width <= len(graph.x) or width == beam):
            held, sims = beam_search(graph.x, graph.links[0], _entries(graph.x, graph.links[1:], q[todo]), q[todo], width)
            full = (sims >= least).all(1) & (held.shape[1] < len(graph.x))
            r, c = np.nonzero((sims >= least) & ~full[:, None])
            rows.append(todo[r])
            nodes.append(held[r, c])
            todo, width = todo[full], 4 * width
        wide.append(todo)
    return np.concatenate(rows), np.concatenate(nodes), np.concatenate(wide)


def find_links(graph: Graph, q: np.ndarray, beam: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, node) of what is found with at least ``least``; beams over an eighth of the shard are the shard."""
    rows, nodes, wide = beam_links(graph, q, beam, least)
    r, c = np.nonzero(q[wide] @ graph.x.T >= least)
    return np.concatenate([rows, wide[r]]), np.concatenate([nodes, c])


def audited_beam(graph: Graph, cosine: float) -> int:
    """The least beam, doubled from ``BEAM``, with which the share ``RECALL`` of the audits' links is found."""
    n, wide = graph.x.shape
    picked = np.unique(np.linspace(0, n - 1, min(n, AUDITS)).astype(np.int64))
    own = graph.x[picked]
    aside = np.random.default_rng(11).normal(size=own.shape)
    aside -= (aside * own).sum(1, keepdims=True) * own
    aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-12)
    turned = (cosine * own + np.sqrt(1 - cosine**2) * aside).astype(np.float32) if wide > 1 else own
    wanted = turned @ graph.x.T >= cosine
    wanted[np.arange(len(picked)), picked] = True
    beam = BEAM
    while beam < n:
        r, c = find_links(graph, turned, beam, cosine - 1e-4)
        if wanted[r, c].sum() >= RECALL * wanted.sum():
            break
        beam *= 2
    return beam


def _unit(vectors: np.ndarray) -> np.ndarray:
    scale = np.abs(vectors).max(1, keepdims=True)
    return vectors / scale / np.linalg.norm(vectors / scale, axis=1, keepdims=True)


def _stars(low: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component after links (a, b) join the components ``low``."""
    while True:
        least, new = np.minimum(low[a], low[b]), low.copy()
        for ends in (a, b, low[a], low[b]):
            np.minimum.at(new, ends, least)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _build(key: tuple, table: pa.Table) -> pa.Table:
    table = table.combine_chunks()
    low, name, copies = (table[c].to_numpy() for c in ("low", "key", "copies"))
    order = np.lexsort((low, name))  # by hash: no order of the data decides who is in the upper layers
    vectors = table["vector"].chunk(0).values.to_numpy().reshape(len(low), -1)[order]
    graph = build_graph(_unit(vectors).astype(np.float32))
    links = b"".join(x.astype(np.int32).tobytes() for x in graph.links)
    row = [key[0].as_py(), key[1].as_py(), audited_beam(graph, COSINE), [len(x) for x in graph.links], links]
    row += [v[order].astype(np.int64).tobytes() for v in (low, name, copies)] + [vectors.tobytes()]
    return pa.table([[v] for v in row], schema=pa.schema(list(zip(("wide", "shard", "beam", "sizes", "links", "low", "key", "copies", "vectors"), [pa.int32()] * 3 + [pa.list_(pa.int32())] + [pa.binary()] * 5))))


def _search(key: tuple, graphs: pa.Table, asked: pa.Table) -> pa.Table:
    """Links of one shard's graph with the nodes of one shard: sums for each node, and stars."""
    names = ["low", "key", "to_low", "to_key", "n"]
    nothing = pa.table([pa.array([], pa.int64())] * 5, names)
    if not graphs.num_rows or not asked.num_rows:
        return nothing
    held, asked = graphs.to_pylist()[0], asked.combine_chunks()
    low, name, copies = (np.frombuffer(held[c], np.int64) for c in ("low", "key", "copies"))
    vectors = _unit(np.frombuffer(held["vectors"]).reshape(len(low), -1))
    flat, links, at = np.frombuffer(held["links"], np.int32).astype(np.int64), [], 0
    for k, size in enumerate(held["sizes"]):
        width = (LINKS if k else 2 * LINKS) + SLACK
        links.append(flat[at : at + size * width].reshape(size, width))
        at += size * width
    graph = Graph(vectors.astype(np.float32), links)
    q_low, q_name, q_copies = (asked[c].to_numpy() for c in ("low", "key", "copies"))
    q = _unit(asked["vector"].chunk(0).values.to_numpy().reshape(len(q_low), -1))
    own = key[1].as_py() == key[2].as_py()
    if own:  # the same nodes, so that a pair can be met from both ends
        place = np.empty(len(q_low), np.int64)
        place[np.lexsort((q_low, q_name))] = np.arange(len(q_low))  # the graph has them in this order
    all_low, all_name, all_copies = (low, name, copies) if own else (np.concatenate([low, q_low]), np.concatenate([name, q_name]), np.concatenate([copies, q_copies]))
    at = place if own else len(low) + np.arange(len(q))  # the node that each query is
    n, star = np.zeros(len(all_low), np.int64), np.arange(len(all_low))
    least, q_small = COSINE - 1e-4, q.astype(np.float32)
    a, b, wide = beam_links(graph, q_small, held["beam"], least)
    compared = np.zeros(len(all_low), bool)
    compared[at[wide]] = True

    def add(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal star
        sure = np.concatenate([np.einsum("ij,ij->i", q[a[k : k + 65_536]], vectors[b[k : k + 65_536]]) for k in range(0, len(a), 65_536)] or [np.empty(0)]) >= COSINE
        a, b = at[a[sure]], b[sure]
        np.add.at(n, a, all_copies[b])
        np.add.at(n, b, all_copies[a])
        star = _stars(star, a, b)

    if own:  # a pair can be met from both ends; those of a compared node are counted when it is compared
        met = (at[a] != b) & ~compared[at[a]] & ~compared[b]
        a, b = a[met], b[met]
        _, first = np.unique(np.minimum(at[a], b) * len(low) + np.maximum(at[a], b), return_index=True)
        a, b = a[first], b[first]
    add(a, b)
    for begin in range(0, len(wide), BATCH):
        some = wide[begin : begin + BATCH]
        r, b = np.nonzero(q_small[some] @ graph.x.T >= least)
        a = some[r]
        if own:
            once = ~compared[b] & (at[a] != b) | (at[a] < b)
            a, b = a[once], b[once]
        add(a, b)
    linked = np.flatnonzero(n)
    return pa.table([pa.array(v, pa.int64()) for v in (all_low[linked], all_name[linked], all_low[star[linked]], all_name[star[linked]], n[linked])], names)


def prepared(table: DataFrame) -> DataFrame:
    """vec_id, vector (doubles, null if it takes no part) and two hashes of it."""
    vector = F.col("embedding").cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fine = F.col("vec_id").isNotNull() & vector.isNotNull() & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0)
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(fine, vector).alias("vector"))
    return rows.withColumn("key", F.xxhash64("vector")).withColumn("key2", F.xxhash64(F.lit(2), "vector"))


def classes(table: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of ``table`` (vec_id, embedding)."""
    rows = prepared(table)
    used = rows.filter("vector is not null")
    nodes = used.groupBy("key", "key2").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    nodes = stage(nodes.withColumn("wide", F.size("vector")), "vectors")
    sizes = nodes.groupBy("wide").agg(F.greatest(F.lit(SHARDS), F.ceil(F.count("*") * F.col("wide") * 8 / SHARD_BYTES)).cast("int").alias("shards"))
    nodes_of = nodes.join(F.broadcast(sizes), "wide").withColumn("shard", F.pmod("key2", "shards").cast("int"))  # a row for each length of vectors
    graphs = stage(nodes_of.select("wide", "shard", "low", "key", "copies", "vector").groupBy("wide", "shard").applyInArrow(_build, GRAPH), "graphs")

    # of shards s and t, t is searched for s if it follows it by up to half of the shards
    ahead = F.sequence(F.lit(0), F.floor(F.col("shards") / 2).cast("int"))
    half = F.col("shards") / 2  # apart from it, two shards would be searched for each other
    asked = nodes_of.withColumn("ahead", F.explode(F.filter(ahead, lambda d: (d != half) | (F.col("shard") < half))))
    asked = asked.select("wide", F.pmod(F.col("shard") + F.col("ahead"), F.col("shards")).alias("target"), F.col("shard").alias("source"), "low", "key", "copies", "vector")
    back = graphs.join(F.broadcast(sizes), "wide").withColumn("source", F.explode(F.transform(F.filter(ahead, lambda d: (d != half) | (F.col("shard") >= half)), lambda d: F.pmod(F.col("shard") - d, F.col("shards")))))
    back = back.select("wide", F.col("shard").alias("target"), "source", "beam", "sizes", "links", "low", "key", "copies", "vectors")
    by = ("wide", "target", "source")
    found = stage(back.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(_search, FOUND), "links")

    counts = found.groupBy("low", "key").agg(F.sum("n").alias("n"))
    united = connected_components(found.select(F.struct("low", "key").alias("a"), F.struct(F.col("to_low").alias("low"), F.col("to_key").alias("key")).alias("b")))
    united = united.select("id.low", "id.key", F.col("component.low").alias("component"))
    verdicts = nodes.select("key", "key2", "low", "copies").join(counts, ["low", "key"], "left").join(united, ["low", "key"], "left")
    verdicts = verdicts.select("key", "key2", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "low").alias("component_id"))
    joined = used.select("vec_id", "key", "key2").join(verdicts, ["key", "key2"]).select("vec_id", "n_links", "component_id")
    rest = rows.filter("vector is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
