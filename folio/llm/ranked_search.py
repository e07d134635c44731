"""Operator 11: ranked lexical search by variable blocks with maxima (block-max WAND).

Terms are maximal runs of ASCII letters, digits and non-ASCII characters of the whole text, A-Z lower-cased.
A document's score for an item is the sum over the item's terms, repeats included, of
w * ((10^9 * tf) div (1000 * tf + 8 * m)) with w = floor(1000 * ln((2N + 2) / (2df + 1))) and
m = 25 + (75 * n * N) div L, in 64-bit integers.

1. Items are a stated query set: they are taken in blocks of about ``ITEM_TERMS`` distinct (item, term) pairs,
   whose terms are numbered and sent to all tasks. One pass over the texts keeps each document's length
   and its frequencies of those terms, staged; N, L and df are aggregates over all of it.
2. A shard is a run of the staged rows of a task with at most about ``SHARD_POSTINGS`` postings or ``SHARD_DOCS``
   documents: nothing is shuffled and no key is hot. Its posting lists are cut into blocks by dynamic programming
   over cells of ``CELL`` postings: boundaries minimise the sum of what the block maxima exceed their
   postings by, weighted by the term, plus ``BLOCK_COST`` for each block.
3. Each item is searched in each shard. Its lists, the highest maximum first, are pivots in growing batches: a new
   document of theirs is scored if the summed maxima of the blocks that cover it, without lists that were pivots
   before (it is in none of them), reach the k-th best score so far. Pivoting ends when the maxima of all lists
   left don't. Bounds that equal that score are opened, so ties are exact.
4. The best of all shards are merged by score, then doc_id.

Nulls: a null text has no terms; rows with a null doc_id take no part at all; an item with a null item_id or
no terms has no rows. Repeated documents are ranked as often as they come, repeated items are one item for each
different text. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.shared import stage

ITEM_TERMS = 200_000
SHARD_POSTINGS = 1 << 20
SHARD_DOCS = 8_192
CELL = 4
WIDEST = 64  # cells in a block
BLOCK_COST = 2e9  # in units of score
K1, B_PERCENT = 8, 75
#: Bytes that end terms become spaces, A-Z become a-z.
SPLIT = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(SPLIT).split() if text else []


def _in_utf8(column: str):
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, term, q): the frequency of each term in each item; items are numbered."""
    rows = stage(items.filter("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct().withColumn("item", F.monotonically_increasing_id()), "items")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(a, b, t, q) for a, b, x in zip(*(c.to_pylist() for c in batch.columns)) for t, q in Counter(terms_of(x)).items()]
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.int64())], ["item", "item_id", "term", "q"])

    return rows.select("item", "item_id", _in_utf8("text").alias("text")).mapInArrow(count, "item long, item_id long, term binary, q long")


def frequencies(docs: DataFrame, asked: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of all documents: the number of terms, and the asked ones with their frequencies."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, lengths, terms, tfs = [], [0], [], []
            for text in batch.column(1):
                words = terms_of(text.as_py())
                found = Counter(map(asked.get, words))
                found.pop(None, None)
                sizes.append(len(words))
                terms += found.keys()
                tfs += found.values()
                lengths.append(len(terms))
            ends = pa.array(lengths, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), _in_utf8("text").alias("text"))
    return stage(rows.mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<int>"), "frequencies")


def block_ends(maxima: np.ndarray, sizes: np.ndarray, cells: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    """For each list the cells after which its blocks end, the last one included.

    ``maxima`` and ``sizes`` have a row for each list, longest first: the greatest impact and the postings of each of
    its ``cells`` cells. The sum of maxima over postings is least for the boundaries, given the cost of a block.
    """
    lists, most = maxima.shape
    cost, start = np.zeros((lists, most + 1)), np.zeros((lists, most + 1), np.int32)
    before = np.concatenate([np.zeros((lists, 1)), sizes.cumsum(1)], 1)
    alive = (cells[:, None] > np.arange(most)).sum(0)  # lists that reach each cell
    top = np.zeros((lists, 0))
    for j in range(1, most + 1):
        a, low = alive[j - 1], max(0, j - WIDEST)
        top = np.concatenate([top[:a, max(0, top.shape[1] + 1 - WIDEST) :], np.zeros((a, 1))], 1)
        np.maximum(top, maxima[:a, j - 1, None], out=top)  # of the cells from each possible start up to here
        ways = cost[:a, low:j] + (before[:a, j, None] - before[:a, low:j]) * top * weights[:a, None]
        best = ways.argmin(1)
        cost[:a, j] = ways[np.arange(a), best] + BLOCK_COST
        start[:a, j] = low + best
    found = []
    for row, j in enumerate(cells.tolist()):
        ends = []
        while j > 0:
            ends.append(j)
            j = int(start[row, j])
        found.append(np.array(ends[::-1]))
    return found


@dataclass
class Shard:
    """Posting lists by term: documents are places in ``ids`` (ascending), blocks are (first, last, maximum)."""

    ids: np.ndarray
    lists: dict[int, tuple[np.ndarray, np.ndarray]]
    blocks: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def make_shard(ids: np.ndarray, sizes: np.ndarray, counts: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int) -> Shard:
    order = np.argsort(ids, kind="stable")
    seat = np.empty(len(ids), np.int64)
    seat[order] = np.arange(len(ids))
    place = np.repeat(seat, counts)
    m = 100 - B_PERCENT + (B_PERCENT * sizes * n_docs) // max(n_terms, 1)
    impact = (1_000_000_000 * tfs) // (1000 * tfs + K1 * np.repeat(m, counts))
    by = np.lexsort((place, terms))
    terms, place, impact = terms[by], place[by], impact[by]
    named, first = np.unique(terms, return_index=True)
    n = np.diff(np.append(first, len(terms)))
    longest = np.argsort(-n, kind="stable")
    named, first, n = named[longest], first[longest], n[longest]
    cells = -(-n // CELL)
    row, start = np.repeat(np.arange(len(n)), cells), np.repeat(first, cells)
    column = np.arange(len(row)) - np.repeat(np.cumsum(cells) - cells, cells)
    maxima, widths = np.zeros((len(n), cells.max(initial=0))), np.zeros((len(n), cells.max(initial=0)))
    if len(n):
        begins = start + column * CELL
        rise = np.argsort(begins, kind="stable")
        tops = np.empty(len(begins))
        tops[rise] = np.maximum.reduceat(impact, begins[rise])
        maxima[row, column], widths[row, column] = tops, np.minimum(CELL, np.repeat(n, cells) - column * CELL)
    lists, blocks = {}, {}
    for term, a, size, ends in zip(named.tolist(), first.tolist(), n.tolist(), block_ends(maxima, widths, cells, weights[named])):
        docs, values = place[a : a + size], impact[a : a + size]
        starts = np.concatenate([[0], ends[:-1] * CELL])
        lists[term] = (docs, values)
        blocks[term] = (docs[starts], docs[np.minimum(ends * CELL, size) - 1], np.maximum.reduceat(values, starts))
    return Shard(ids[order], lists, blocks)


def search_shard(shard: Shard, query: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
    """(doc_id, score) of the ``k`` best of (term, weight) pairs, repeats in the weight: highest score, then smallest doc_id."""
    query = [(t, w) for t, w in query if w > 0 and t in shard.lists]
    query.sort(key=lambda x: -x[1] * shard.blocks[x[0]][2].max())
    tops = [w * int(shard.blocks[t][2].max()) for t, w in query]
    rest = [*np.cumsum(tops[::-1])[::-1].tolist(), 0]  # what the lists from here on can give at most

    def summed(lists: list[tuple[int, int]]) -> np.ndarray:
        """For each document the maxima of the blocks that cover it."""
        change = np.zeros(len(shard.ids) + 1, np.int64)
        for t, w in lists:
            first, last, most = shard.blocks[t]
            change[first] += w * most  # first and last places of a list's blocks are distinct
            change[last + 1] -= w * most
        return change[:-1].cumsum()

    bound = summed(query)
    least = 1  # only scores above 0 count
    seen, at, step = np.zeros(len(shard.ids), bool), 0, 4 * k
    opened, scores = np.empty(0, np.int64), np.empty(0, np.int64)
    while at < len(query) and rest[at] >= least:  # a document in none of the lists before can still be among the best
        pivots, held, began = [], 0, at
        while at < len(query) and held < step and rest[at] >= least:
            pivots.append(shard.lists[query[at][0]][0])
            held, at = held + len(pivots[-1]), at + 1
        met = np.unique(np.concatenate(pivots))
        docs = met[~seen[met] & (bound[met] >= least)]
        seen[met] = True
        bound -= summed(query[began:at])  # an unseen document is in none of these
        if len(docs):
            found = np.zeros(len(docs), np.int64)
            for t, w in query:
                places, values = shard.lists[t]
                spot = np.minimum(np.searchsorted(places, docs), len(places) - 1)
                found += np.where(places[spot] == docs, w * values[spot], 0)
            opened, scores = np.concatenate([opened, docs]), np.concatenate([scores, found])
            best = np.lexsort((opened, -scores))[:k]  # places ascend with doc_id
            opened, scores = opened[best], scores[best]
            if len(scores) == k:
                least = max(least, int(scores[-1]))
        step *= 2
    return [(int(shard.ids[d]), int(s)) for d, s in zip(opened, scores) if s >= least]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of rows as (ids, sizes, number of terms, terms, tfs)."""
    held, postings, docs = [], 0, 0

    def joined():
        return tuple(np.concatenate(x) for x in zip(*held))

    for batch in batches:
        lists = batch.column(2)
        ends = lists.offsets.to_numpy().astype(np.int64)
        terms, tfs = lists.values.to_numpy().astype(np.int64), batch.column(3).values.to_numpy().astype(np.int64)
        ids, sizes, a = batch.column(0).to_numpy(), batch.column(1).to_numpy(), 0
        while a < batch.num_rows:
            room = int(np.searchsorted(ends, ends[a] + SHARD_POSTINGS - postings, side="right")) - 1
            b = min(batch.num_rows, max(room, a + 1 if docs == 0 else a), a + SHARD_DOCS - docs)
            held.append((ids[a:b], sizes[a:b], np.diff(ends[a : b + 1]), terms[ends[a] : ends[b]], tfs[ends[a] : ends[b]]))
            postings, docs = postings + int(ends[b] - ends[a]), docs + b - a
            if b < batch.num_rows or docs >= SHARD_DOCS:
                yield joined()
                held, postings, docs = [], 0, 0
            a = b
    if docs:
        yield joined()


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item", "item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _block_of_items(docs: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    rows = entries.collect()  # about ITEM_TERMS
    names = sorted({bytes(r["term"]) for r in rows})
    asked = {t: i for i, t in enumerate(names)}
    counted = frequencies(docs, asked)
    n_docs, n_terms = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(names), np.int64)
    for r in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row for each asked term
        df[r["term"]] = r["count"]
    weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    queries: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r in rows:
        t = asked[bytes(r["term"])]
        queries.setdefault((r["item"], r["item_id"]), []).append((t, r["q"] * int(weights[t])))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _shards(batches):
            shard = make_shard(*part, weights, n_docs, n_terms)
            out = [(*item, doc, score) for item, query in queries.items() for doc, score in search_shard(shard, query, k)]
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item", "item_id", "doc_id", "score"])

    return _best(counted.mapInArrow(search, "item long, item_id long, doc_id long, score long"), k)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank (from 1), doc_id and score: the ``k`` best documents with a score above 0 for each row of ``items`` (item_id, text)."""
    entries = stage(item_terms(items), "item-terms")
    blocks = -(-entries.count() // ITEM_TERMS)
    found = entries.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in range(blocks):  # an item is in one block
        found = found.union(_block_of_items(docs, entries.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block), k))
    return found
