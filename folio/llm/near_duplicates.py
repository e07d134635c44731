"""Operator 3: MinHash near-duplicates with sequential Bayesian verification.

1. A document's set holds the 64-bit hashes of its distinct shingles of ``words`` words; shorter
   documents have one shingle, documents without words none. Equal sets (compared by 128 bits and
   size) are one node, named by its smallest doc_id: thousands of copies cost no pairs.
2. Signatures of ``BANDS * ROWS`` minima; nodes that agree on a whole band share a bucket. A pair at
   similarity 0.8 shares none of the 32 buckets with a chance of 3e-6.
3. Each bucket's most central node (the one with the most bucket mates) is its hub and compared with
   the rest: a star, not all pairs. Links make components; what lies in one needs no more pairs.
4. What is left are pairs of a bucket in different components, thousands a node in a large group of
   copies that have drifted apart. Their nodes are banded once more, now without any miss: by the
   rarest of their shingles, as many as two alike sets can't all miss (prefix filter), and by the
   place of the first shared one. Only an end outside its buckets' largest component probes. Copies
   with changes of their own don't meet this way, however many they are.
5. A pair from 3 or 4 is verified batch by batch of its signatures' low bytes: with ``m`` of ``n`` equal
   it is dropped as soon as the posterior probability of a similarity of at least the threshold is
   under ``MISS``. Survivors are confirmed on their full sets: 100 * intersection >= 80 * union.
6. Components of the confirmed links.

Nothing is capped. The counters that order shingles by rarity (``COUNTERS``, 4 MB) are broadcast and have
one size for any input.

Nulls: a null text has an empty set; rows with a null doc_id are in no class (component_id null,
kept). Rows with the same doc_id are one document. Empty tables give no rows. Other columns come
along in ``keep_one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.shared import computed_once, stage, whole_text, with_ids
from folio.llm.text_stats import CAPITALS, WORD
from folio.operators.components import connected_components

BANDS, ROWS = 32, 5
BATCH = 32
MISS = 1e-7
PERCENT = 80
COUNTERS = 1 << 20


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id and ``_set``: the sorted distinct shingle hashes."""
    text = F.translate(whole_text(), CAPITALS, CAPITALS.lower())
    step = docs.select(F.col("doc_id").cast("long").alias("doc_id"), computed_once(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).alias("_words"))
    many = F.transform(F.sequence(F.lit(0), F.size("_words") - words), lambda i: F.xxhash64(*[F.get("_words", i + j) for j in range(words)]))
    none = F.array().cast("array<bigint>")
    hashes = F.when(F.size("_words") >= words, many).when(F.size("_words") > 0, F.array(F.xxhash64("_words"))).otherwise(none)
    return step.select("doc_id", computed_once(F.sort_array(F.array_distinct(hashes))).alias("_set"))


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240)
    a, b = rng.integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64)
    return a << np.uint64(1) | np.uint64(1), b


def signature(hashes: np.ndarray, step: int = 512) -> np.ndarray:
    """The minima of ``BANDS * ROWS`` hash functions over a set of 64-bit hashes."""
    a, b = _multipliers()
    low = np.full(len(a), 0xFFFFFFFF, np.uint64)
    for k in range(0, len(hashes), step):
        x = hashes[k : k + step, None] * a
        x += b
        x >>= np.uint64(32)
        np.minimum(low, x.min(0), out=low)
    return low.astype(np.uint32)


def signed(sets: DataFrame) -> DataFrame:
    """doc_id, n, k1, k2 (digest of the set), bands (one key each) and bits (the minima's low bytes)."""
    rows = sets.select("doc_id", F.size("_set").cast("long").alias("n"), F.xxhash64(F.lit(1), "_set").alias("k1"), F.xxhash64(F.lit(2), "_set").alias("k2"), "_set")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets_ = batch.column(4)
            values, ends = sets_.values.to_numpy(zero_copy_only=False).view(np.uint64), sets_.offsets.to_numpy()
            bands, bits = [], []
            for a, b in zip(ends, ends[1:]):
                low = signature(values[a:b])
                bits.append(low.astype(np.uint8).tobytes() if b > a else None)
                bands.append(low.tobytes() if b > a else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(bands, pa.binary()), pa.array(bits, pa.binary())], ["doc_id", "n", "k1", "k2", "low", "bits"])

    got = rows.mapInArrow(sign, "doc_id long, n long, k1 long, k2 long, low binary, bits binary")
    keys = F.array(*[F.xxhash64(F.lit(k), F.substring("low", 4 * ROWS * k + 1, 4 * ROWS)) for k in range(BANDS)])
    return got.select("doc_id", "n", "k1", "k2", F.when(F.col("n") > 0, keys).alias("bands"), "bits")


def least_matches(threshold: float, miss: float = MISS) -> list[int]:
    """For each full batch: the fewest equal signatures with which a pair is not yet dropped.

    Prior: uniform over the chance that two low bytes agree; the threshold's chance is
    t = s + (1 - s) / 256. P(chance >= t | m of n) = P(Binomial(n + 1, t) <= m).
    """
    t = threshold + (1 - threshold) / 256
    found = []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        below, m = 0.0, -1
        while below < miss:
            m += 1
            below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        found.append(m)
    return found


def plausible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the Bayesian comparison of their signatures does not drop."""
    least = least_matches(percent / 100)
    side = lambda x: nodes.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b", "bitsa", "bitsb")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            wide = BANDS * ROWS
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, wide) for k in (2, 3))
            alive, equal = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for k, m in enumerate(least):
                part = slice(k * BATCH, (k + 1) * BATCH)
                equal[alive] += (x[alive, part] == y[alive, part]).sum(1)
                alive = alive[equal[alive] >= m]
            yield batch.select(["a", "b"]).take(pa.array(alive))

    return joined.mapInArrow(compare, "a long, b long")


def sets_of(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """doc_id and ``_set`` of the documents whose ids are in the first column of ``ids``; only their texts are cut again."""
    return stage(shingle_sets(with_ids(docs, ids.toDF("doc_id"), "left_semi"), words), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("_set").alias(f"set{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    both = F.size(F.array_intersect("seta", "setb"))
    rows = joined.select("a", "b", computed_once(both).alias("both"), (F.size("seta") + F.size("setb")).alias("sum"))
    return rows.filter(100 * F.col("both") >= percent * (F.col("sum") - F.col("both"))).select("a", "b")


def _star_pairs(members: DataFrame, hub: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of each key's hub and its members of other components that are of a like size."""
    ends = hub.select(F.col("key").alias("k"), F.col("id").alias("hub"), F.col("n").alias("nh"), F.col("component").alias("own"))
    alike = (F.col("component") != F.col("own")) & (100 * F.least("n", "nh") >= percent * F.greatest("n", "nh"))
    met = members.join(ends, (F.col("key") == F.col("k")) & alike)
    return met.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()


def _hubs(members: DataFrame, by: Column) -> DataFrame:
    """One member of each key, the largest by ``by``; partial maxima go before the shuffle."""
    top = members.groupBy("key").agg(F.max(F.struct(by.alias("by"), (-F.col("id")).alias("minus"), "n", "component")).alias("top"))
    return top.select("key", (-F.col("top.minus")).alias("id"), "top.n", "top.component")


def _merged(components: DataFrame | None, new: DataFrame | None) -> DataFrame | None:
    """(id, component) after ``new`` links; only components that the links join are computed anew."""
    if new is None or new.isEmpty():
        return components
    if components is None:
        return stage(connected_components(new).select("id", "component"), "components")
    side = lambda x: components.select(F.col("id").alias(x), F.col("component").alias(f"c{x}"))
    ends = new.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    moved = stage(connected_components(ends), "moved")
    to = moved.select(F.col("id").alias("component"), F.col("component").alias("to"))
    old = components.join(to, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    return stage(old.union(moved.select("id", "component").join(components.select("id"), "id", "left_anti")), "components")


def _labelled(members: DataFrame, components: DataFrame | None) -> DataFrame:
    """The members with their component (at first themselves) and its number of nodes."""
    if components is None:
        return members.withColumn("component", F.col("id")).withColumn("size", F.lit(1).cast("long"))
    sizes = components.groupBy("component").agg(F.count("*").alias("size"))
    known = components.join(sizes, "component").select("id", "component", "size")
    return members.join(known, "id", "left").withColumn("component", F.coalesce("component", "id")).withColumn("size", F.coalesce("size", F.lit(1)))


def undecided(labelled: DataFrame) -> DataFrame:
    """(id, component, probes) of the nodes in buckets that hold several components.

    A pair of a bucket that isn't in one component has an end that isn't in the bucket's largest
    component (by the component's nodes in all, then its name): these ends probe. Nodes of a
    component that is the largest of all its buckets don't.
    """
    rank = F.struct("size", "component")
    tops = labelled.groupBy("key").agg(F.max(rank).alias("top"), F.min("component").alias("least"), F.max("component").alias("most")).filter("least <> most").select("key", "top")
    return labelled.join(tops, "key").groupBy("id", "component").agg(F.max(F.col("component") != F.col("top.component")).alias("probes"))


def rarity(sets: DataFrame) -> np.ndarray:
    """How many shingles of ``sets`` fall into each of ``COUNTERS`` counters: never less than a shingle's own number."""
    slot = F.explode(F.transform("_set", lambda h: F.pmod(h, F.lit(COUNTERS)).cast("int")))
    counts = sets.select(slot.alias("slot")).groupBy("slot").agg(F.count("*").cast("int").alias("n")).toArrow()
    table = np.zeros(COUNTERS, np.int32)
    table[counts["slot"].to_numpy()] = counts["n"].to_numpy()
    return table


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """The rows (key, id, n, most) by which two alike sets must meet.

    Shingles are put in one order for all sets, those in the rarest counters first. If two sets are
    alike, the first shingle they share has so many shingles from there on, in either set, that the
    partner has at most ``most`` shingles. Shingles that no other set holds make no row. The order
    decides how many rows and candidates there are, never which pairs are found.
    """
    shared = sets.sparkSession.sparkContext.broadcast(rarity(sets))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            ids, column = batch.column(0).to_numpy(), batch.column(1)
            values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            rows: list[list[np.ndarray]] = [[], [], [], []]
            for i, a, b in zip(ids, ends, ends[1:]):
                found, n = values[a:b], int(b - a)
                count = table[found % COUNTERS]
                order = np.lexsort((found, count))
                least = -(-percent * n // 100)  # shared with a partner, whatever its size
                order = order[: n - least + 1]
                rank = np.flatnonzero(count[order] > 1)
                rows[0].append(found[order[rank]])
                rows[1].append(np.full(len(rank), i))
                rows[2].append(np.full(len(rank), n))
                rows[3].append((n - rank) * (100 + percent) // percent - n)
            columns = [pa.array(np.concatenate(r) if r else [], pa.int64()) for r in rows]
            yield pa.RecordBatch.from_arrays(columns, ["key", "id", "n", "most"])

    return sets.select("doc_id", "_set").mapInArrow(cut, "key long, id long, n long, most long")


def _size_class(n: Column) -> Column:
    """Numbers of shingles within about one per cent of each other."""
    return F.floor(64 * F.log2(n.cast("double"))).cast("int")


def meeting(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share a prefix shingle early enough to be alike.

    ``rows`` are those of ``prefixes`` with component and probes; one end of each pair probes. A
    probe goes only to the size classes that the shingle occurs in and that its rank still allows.
    """
    index = rows.withColumn("class", _size_class(F.col("n")))
    classes_ = index.select("key", "class").distinct()
    largest = F.least("most", F.floor(F.col("n") * 100 / percent))
    probe = rows.filter("probes").select(
        F.col("key").alias("k"), F.col("id").alias("x"), F.col("n").alias("nx"), F.col("most").alias("mx"), F.col("component").alias("cx"),
        _size_class(F.ceil(F.col("n") * percent / 100)).alias("low"), _size_class(F.greatest(largest, F.lit(1))).alias("high"),
    )
    probe = probe.filter("mx >= 1").join(classes_, (F.col("k") == F.col("key")) & F.col("class").between(F.col("low"), F.col("high"))).select("k", F.col("class").alias("cl"), "x", "nx", "mx", "cx")
    alike = (F.col("cx") != F.col("component")) & (F.col("n") <= F.col("mx")) & (F.col("nx") <= F.col("most")) & (100 * F.least("n", "nx") >= percent * F.greatest("n", "nx"))
    met = index.join(probe, (F.col("key") == F.col("k")) & (F.col("class") == F.col("cl")) & alike)
    return met.select(F.least("id", "x").alias("a"), F.greatest("id", "x").alias("b")).distinct()


def linked(docs: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame | None:
    """(id, component) of the nodes (id, n, bands, bits) that have a link, None without any link."""
    rows = nodes.filter("n > 0").select("id", "n", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    members = stage(rows.join(shared, "key"), "buckets")
    mates = members.groupBy("id").agg(F.sum("m").alias("mates"))

    def links(pairs: DataFrame, sets: DataFrame | None = None) -> DataFrame | None:
        pairs = stage(pairs, "pairs")
        left = pairs if pairs.isEmpty() else stage(plausible(pairs, nodes, percent), "plausible")
        if left.isEmpty():
            return None
        if sets is None:
            sets = sets_of(docs, left.select("a").union(left.select("b")).distinct(), words)
        return stage(confirmed(left, sets, percent), "confirmed")

    first = _labelled(members, None)
    hubs = _hubs(first.join(mates, "id"), F.col("mates"))
    components = _merged(None, links(_star_pairs(first, hubs, percent)))
    open_ = stage(undecided(_labelled(members.select("key", "id"), components)), "undecided")
    if not open_.isEmpty():
        sets = sets_of(docs, open_.select("id"), words)
        rows = stage(prefixes(sets, percent).join(open_, "id"), "prefixes")
        components = _merged(components, links(meeting(rows, percent), sets))
    return components


def classes(docs: DataFrame, *, words: int = 5, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    docs = docs.select("doc_id", "text")
    rows = stage(signed(shingle_sets(docs, words)), "signed")
    filled = rows.filter("n > 0 and doc_id is not null")
    nodes = stage(filled.groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"), F.first("bits").alias("bits")), "nodes")
    components = linked(docs, nodes.select("id", "n", "bands", "bits"), words, percent)
    # rows of one document with different texts hang together through their doc_id
    own = nodes.select("id", "n", "k1", "k2")
    ids = own.select(F.col("id").alias("a"))
    several = filled.select("doc_id", "n", "k1", "k2").join(own, ["n", "k1", "k2"]).filter("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    several = stage(several.join(ids, "a", "left_semi"), "several")
    components = _merged(components, several)
    if components is None:
        components = several.selectExpr("a AS id", "a AS component").limit(0)
    named = stage(own.join(components, "id", "left").select("n", "k1", "k2", F.coalesce("component", "id").alias("component")), "named")
    joined = rows.select("doc_id", "n", "k1", "k2").join(named, ["n", "k1", "k2"], "left")
    component: Column = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame, *, words: int = 5, percent: int = PERCENT) -> DataFrame:
    """The documents without those that have a near-duplicate with a smaller doc_id in their class."""
    lost = stage(classes(docs, words=words, percent=percent).filter("not kept").select("doc_id"), "lost")
    return with_ids(docs, lost, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
