"""The stored index: coded posting lists in blocks, searches and ratings that decode only blocks they need.

``indexed_terms`` has a row for each identifier and range of ``WIDE`` article ids: the skip entry (first, last, n, bytes),
the coded list of its articles with flags and hits, and the coded list of its positions in them. Skip entries are
read without the lists, article lists without the positions. A word in every article is many rows.

Texts are inverted where they are: a task writes coded lists of about ``INVERTED`` tokens at a time, and only those
lists, one for each word and range, meet the dictionary (broadcast up to ``SMALL`` rows, else joined), are shuffled,
sorted and merged as they come.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.posting_blocks import read_digits, read_lists, write_digits, write_lists
from folio.operators.retrieval import CONTENT_RUN, CONTENT_WEIGHT, DECAY, RESULTS, SMALL, TITLE_RUN, TITLE_WEIGHT, document_positions, query_identifiers, query_parts, query_words, title_size, with_identifiers
from folio.sources.staging import stage

WIDE = 1 << 14
#: Flags of a position: the token is one of the searches, of the ratings, the dictionary knows it, it stands in the title.
SEARCHED, RATED, KNOWN, TITLE = 1, 2, 4, 8
#: Flags of an article, beside SEARCHED: its title, its content has the identifier by the ratings' tokens.
IN_TITLE, IN_CONTENT = 2, 4
ORD = 31  # bits of a token's place in its article
AT_ONCE = 1 << 20
INVERTED = 1 << 21  # tokens inverted at once
#: The white space at the edge of tokens.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _inverted(articles: DataFrame) -> DataFrame:
    """(tok, block, coded): lists of positions of each token, many for a token and range.

    Searches take stripped tokens, ratings take them as they are; a token with white space at its edge is in
    the lists of both. Numbers are 16 * (article in the block + 1, place) + flags.
    """
    wide, inverted = WIDE, INVERTED

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids, titles = (np.concatenate([batch.column(k).to_numpy() for batch in held]) for k in range(2))
        texts = pa.concat_arrays([batch.column(2).cast(pa.large_string()) for batch in held])
        if (np.diff(ids) < 0).any():
            order = np.argsort(ids, kind="stable")
            ids, titles, texts = ids[order], titles[order], texts.take(pa.array(order))
        lists = pc.split_pattern(texts, " ")
        sizes, tokens = lists.value_lengths().to_numpy().astype(np.int64), lists.flatten().dictionary_encode()
        code, names = tokens.indices.to_numpy().astype(np.int64), tokens.dictionary
        cut = pc.utf8_trim(names, SPACE)
        edged = np.flatnonzero(pc.not_equal(cut, names).to_numpy(zero_copy_only=False))
        both = pa.concat_arrays([names, cut.take(pa.array(edged))]).dictionary_encode()
        to, words = np.arange(len(names)), both.dictionary
        to[edged] = both.indices.to_numpy()[len(names) :]
        plain = to[code] == code
        more = np.flatnonzero(~plain)
        # tokens stand in the order of their articles and places: a token's number in front of its place in the batch sorts by code, block and value
        shift = len(code).bit_length()
        key = np.sort(np.concatenate([code << shift | np.arange(len(code)), to[code[more]] << shift | more]))
        at = key & (1 << shift) - 1
        key >>= shift
        flags = np.where(plain[at], SEARCHED | RATED, np.where(code[at] == key, RATED, SEARCHED))
        article, place = np.repeat(ids, sizes)[at], (np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[at]
        flags += np.where(place < np.repeat(titles, sizes)[at], TITLE, 0)
        block = article // wide
        value = ((article - block * wide + 1 << ORD | place) << 4) | flags
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])]))
        coded = write_lists(value, np.diff(np.append(first, len(key))))
        return pa.RecordBatch.from_arrays([words.take(pa.array(key[first])).cast(pa.string()), pa.array(block[first]), coded], ["tok", "block", "coded"])

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            sums, a = np.concatenate([[0], (pc.count_substring(batch.column(2), " ").to_numpy().astype(np.int64) + 1).cumsum()]), 0
            while a < batch.num_rows:
                b = min(int(np.searchsorted(sums, sums[a] + inverted - n)), batch.num_rows)
                held.append(batch.slice(a, b - a))
                n += sums[b] - sums[a]
                a = b
                if n >= inverted:
                    yield flush(held)
                    held, n = [], 0
        if held:
            yield flush(held)

    rows = articles.select("id", title_size().alias("n_title"), F.lower(F.concat_ws(" ", F.col("title"), F.col("content"))).alias("text"))
    return rows.mapInArrow(invert, "tok string, block long, coded binary")


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ident, block, parts) from rows (ident, block, coded, known) that are sorted by ident and block, over the edges of batches."""
    held: list[pa.RecordBatch] = []
    key = lambda batch, row: (batch.column(0)[row], batch.column(1)[row])
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and key(held[0], 0) == key(batch, -1):
            held.append(batch)  # all of it belongs to the row that is open
            continue
        rows = pa.concat_batches([*held, batch])
        begin = _begins(rows)
        yield _with_parts(rows.slice(0, begin[-1]), begin)
        held = [rows.slice(begin[-1])]
    if held:
        rows = pa.concat_batches(held)
        yield _with_parts(rows, np.array([0, len(rows)]))


def _begins(rows: pa.RecordBatch) -> np.ndarray:
    ident, block = rows.column(0), rows.column(1).to_numpy()
    other = pc.not_equal(ident.slice(1), ident.slice(0, len(ident) - 1)).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(other | (block[1:] != block[:-1])) + 1])


def _with_parts(rows: pa.RecordBatch, edges: np.ndarray) -> pa.RecordBatch:
    parts = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays(rows.columns[2:], ["coded", "known"]))
    first = pa.array(edges[:-1])
    return pa.RecordBatch.from_arrays([rows.column(0).take(first), rows.column(1).take(first), parts], ["ident", "block", "parts"])


def merged_at_once(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``AT_ONCE`` coded bytes; the lists are measured in the batch, none becomes a Python object."""
    parts = batch.column("parts")
    of_part = pc.fill_null(pc.binary_length(parts.flatten().field("coded")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    sums = np.concatenate([[0], of_part.cumsum()])
    group = sums[np.cumsum(parts.value_lengths().to_numpy())] // AT_ONCE
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1), len(group)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def indexed_terms(articles: DataFrame, base_forms: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """The index: (ident, block, first, last, n, bytes, coded, title_hits, content_hits, n_positions, positions).

    ``coded`` has 8 * (article in the block + 1) + flags; ``title_hits`` and ``content_hits`` have one more than the known tokens
    of each. Rows are sorted within the partitions of the blocks' hash: a look-up reads a page of each file, and
    the blocks of a hot identifier are in all files.
    """
    wide, names = WIDE, ["first", "last", "n", "bytes", "coded", "title_hits", "content_hits", "n_positions", "positions"]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped(batches):
            for some in merged_at_once(batch):
                parts = some.column("parts")
                flat = parts.flatten()
                values, counts = read_lists(flat.field("coded"))
                row = np.repeat(np.repeat(np.arange(len(parts)), parts.value_lengths().to_numpy()), counts)
                known = np.repeat(flat.field("known").to_numpy(zero_copy_only=False), counts)
                values = values | np.where(known & (values & RATED > 0), KNOWN, 0)
                several = np.flatnonzero((parts.value_lengths().to_numpy() > 1)[row])  # a list of one part is sorted
                values[several] = values[several][np.lexsort((values[several], row[several]))]
                first = np.flatnonzero(np.concatenate([[True], (values[1:] >> 4 != values[:-1] >> 4) | (row[1:] != row[:-1])]))
                values, row = values[first] >> 4 << 4 | np.bitwise_or.reduceat(values & 15, first), row[first]  # one token by two ways
                n_positions = np.bincount(row, minlength=len(parts))
                article = values >> ORD + 4
                begin = np.flatnonzero(np.concatenate([[True], (article[1:] != article[:-1]) | (row[1:] != row[:-1])]))
                has = lambda mask: np.bitwise_or.reduceat(mask.astype(np.int64), begin)  # noqa: B023, E731
                hits = lambda mask: 1 + np.add.reduceat(mask.astype(np.int64), begin)  # noqa: B023, E731
                rated, title = values & RATED > 0, values & TITLE > 0
                flags = has(values & SEARCHED > 0) * SEARCHED + has(rated & title) * IN_TITLE + has(rated & ~title) * IN_CONTENT
                n = np.bincount(row[begin], minlength=len(parts))
                last = np.cumsum(n)
                ids = article[begin] - 1 + some.column("block").to_numpy()[row[begin]] * wide
                coded = write_lists(article[begin] * 8 + flags, n)
                known = values & KNOWN > 0
                columns = [pa.array(ids[last - n]), pa.array(ids[last - 1]), pa.array(n, pa.int32()), pa.array(np.diff(np.frombuffer(coded.buffers()[1], np.int32)), pa.int32()), coded]
                columns += [write_digits(hits(known & title), n), write_digits(hits(known & ~title), n), pa.array(n_positions, pa.int32()), write_lists(values, n_positions)]
                yield pa.RecordBatch.from_arrays([some.column("ident"), some.column("block"), *columns], ["ident", "block", *names])

    forms = base_forms.select(F.col("word").alias("tok"), "base_form")
    lists = _inverted(articles).join(F.broadcast(forms) if forms.limit(SMALL + 1).count() <= SMALL else forms, "tok", "left")
    named = with_identifiers(lists.select(F.coalesce("base_form", "tok").alias("form"), F.col("base_form").isNotNull().alias("known"), "block", "coded"), clusters)
    rows = named.select("ident", "block", "coded", "known").repartition("ident", "block").sortWithinPartitions("ident", "block")
    schema = "ident string, block long, first long, last long, n int, bytes int, coded binary, title_hits binary, content_hits binary, n_positions int, positions binary"
    return rows.mapInArrow(merge, schema)


def _slices(batch: pa.RecordBatch, n: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of a batch of about ``AT_ONCE`` numbers, with the row of each number."""
    counts = batch.column(n).to_numpy()
    part = np.cumsum(counts) // AT_ONCE
    for k in np.unique(part):
        yield batch.filter(pa.array(part == k)), np.repeat(np.arange(int((part == k).sum())), counts[part == k])


def decoded(blocks: DataFrame, hits: bool = False) -> DataFrame:
    """(ident, id, flags) of the articles of ``blocks``, and title_hits and content_hits if asked."""
    more, wide = ["title_hits", "content_hits"] if hits else [], WIDE

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, row in _slices(batch, "n"):
                values, _ = read_lists(some.column("coded"))
                ids = values // 8 - 1 + some.column("block").to_numpy()[row] * wide
                beside = [pa.array(read_digits(some.column(c))[0] - 1) for c in more]
                yield pa.RecordBatch.from_arrays([some.column("ident").take(pa.array(row)), pa.array(ids), pa.array(values % 8, pa.int32()), *beside], ["ident", "id", "flags", *more])

    return blocks.select("ident", "block", "n", "coded", *more).mapInArrow(read, "ident string, id long, flags int" + "".join(f", {c} long" for c in more))


def decoded_positions(blocks: DataFrame) -> DataFrame:
    """(ident, id, ord, flags) of the positions of ``blocks``."""
    wide = WIDE

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, row in _slices(batch, "n_positions"):
                values, _ = read_lists(some.column("positions"))
                ids = (values >> ORD + 4) - 1 + some.column("block").to_numpy()[row] * wide
                yield pa.RecordBatch.from_arrays([some.column("ident").take(pa.array(row)), pa.array(ids), pa.array(values >> 4 & (1 << ORD) - 1), pa.array(values & 15, pa.int32())], ["ident", "id", "ord", "flags"])

    return blocks.select("ident", "block", "n_positions", "positions").mapInArrow(read, "ident string, id long, ord long, flags int")


def meeting(skips: DataFrame, needed: int) -> DataFrame:
    """(block, low, high): the blocks in which all of ``needed`` words (k) have a list, and the range in which all lists meet."""
    words = skips.groupBy("block", "k").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    spans = words.groupBy("block").agg(F.count("*").alias("words"), F.max("first").alias("low"), F.min("last").alias("high"))
    return spans.filter((F.col("words") == needed) & (F.col("low") <= F.col("high"))).select("block", "low", "high")


class TextIndex:
    """An index stored as Parquet, with searches over it. Identifiers of words are remembered from query to query."""

    def __init__(self, store, clusters: DataFrame | None = None):
        self.store, self.clusters = store, clusters
        self._known: dict[str, list[str]] = {}

    @classmethod
    def build(cls, store, articles: DataFrame, base_forms: DataFrame, clusters: DataFrame | None = None) -> TextIndex:
        store.write("wiki_articles", articles.select(F.col("id").alias("wiki_article_id"), "title", "content").sortWithinPartitions("wiki_article_id"))
        store.write("word_base_forms", base_forms.sortWithinPartitions("word"))
        store.write("document_positions", document_positions(articles).sortWithinPartitions("id"))
        store.write("indexed_terms", indexed_terms(articles, base_forms, clusters))
        return cls(store, clusters)

    def identifiers(self, words: list[str]) -> list[tuple[int, str]]:
        """(k, identifier) of the k-th word; only words that no query had before are looked up."""
        new = [w for w in dict.fromkeys(words) if w not in self._known]
        if new:
            self._known |= {w: [] for w in new}
            for r in query_identifiers(self.store.spark, new, self.store.lookup("word_base_forms", "word", new), self.clusters).collect():  # forms of a query's words
                self._known[r["word"]].append(r["ident"])
        return [(k, ident) for k, w in enumerate(words) for ident in self._known[w]]

    def _asked(self, rows: list[tuple[int, str]]) -> DataFrame:
        return F.broadcast(self.store.spark.createDataFrame(rows, "k int, ident string"))  # a query's identifiers

    def _blocks(self, rows: list[tuple[int, str]]) -> DataFrame:
        return self.store.lookup("indexed_terms", "ident", sorted({ident for _, ident in rows}))

    def document_blocks(self, words: list[str]) -> DataFrame:
        """(ident, block, low, high): the blocks of the document index in which all words can meet, from skip entries only."""
        rows = self.identifiers(words)
        skips = self._blocks(rows).select("ident", "block", "first", "last").join(self._asked(rows), "ident")
        met = skips.join(meeting(skips, len(words)), "block").filter((F.col("last") >= F.col("low")) & (F.col("first") <= F.col("high")))
        return met.select("ident", "block", "low", "high").distinct()

    def boolean(self, words: list[str]) -> DataFrame:
        """ids of the articles that hold all words."""
        rows = self.identifiers(words)
        blocks = self._blocks(rows).join(self.document_blocks(words), ["ident", "block"])
        hits = decoded(blocks).filter(F.col("flags").bitwiseAND(SEARCHED) > 0).join(self._asked(rows), "ident")
        return hits.groupBy("id").agg(F.count_distinct("k").alias("words")).filter(F.col("words") == len(words)).select("id")

    def _positions(self, rows: list[tuple[int, str]], ids: DataFrame) -> DataFrame:
        """(ident, id, ord, flags) of the identifiers in the articles ``ids``; only blocks with one of them are decoded."""
        inside = ids.select(F.floor(F.col("id") / WIDE).alias("block")).distinct()
        return decoded_positions(self._blocks(rows).join(inside, "block", "left_semi")).join(ids, "id", "left_semi")

    def _phrase_places(self, words: list[str]) -> DataFrame:
        """(id, ord) of the first words where the words stand one after the other; only articles with all words are looked into."""
        rows, ids = self.identifiers(words), stage(self.boolean(list(dict.fromkeys(words))), "within")
        hits = self._positions(rows, ids).filter(F.col("flags").bitwiseAND(SEARCHED) > 0).join(self._asked(rows), "ident")
        runs = hits.groupBy("id", (F.col("ord") - F.col("k")).alias("ord")).agg(F.count_distinct("k").alias("words"))
        return runs.filter(F.col("words") == len(words)).select("id", "ord")

    def phrase(self, words: list[str]) -> DataFrame:
        """(id, position) where the words stand one after the other, by positions over all articles."""
        starts = self.store.read("document_positions").select("id", "start")
        return self._phrase_places(words).join(starts, "id").select("id", (F.col("start") + F.col("ord")).alias("position"))

    def matches(self, query: str, mode: str = "mixed", exact_phrase: bool = False) -> DataFrame | None:
        """ids of the articles that match every part of the query; None for a query without words."""
        found = None
        for kind, words in query_parts(query, mode, exact_phrase):
            ids = self._phrase_places(words).select("id").distinct() if kind == "phrase" else self.boolean(words)
            found = ids if found is None else found.join(ids, "id", "left_semi")
        return found

    def bounds(self, ids: DataFrame, query: str) -> DataFrame:
        """(id, low, high): the rating of each article without its runs, and with all its known tokens in one run.

        Both come from the document index; they are equal where there can be no run.
        """
        inside = ids.select(F.floor(F.col("id") / WIDE).alias("block")).distinct()
        blocks = self._blocks(self.identifiers([w for w in query_words(query) if w])).join(inside, "block", "left_semi")
        rows = decoded(blocks, hits=True).join(ids, "id", "left_semi")
        has = lambda flag: F.count_if(F.col("flags").bitwiseAND(flag) > 0)  # noqa: E731  a row for each identifier of an article
        sums = rows.groupBy("id").agg(has(IN_TITLE).alias("in_title"), has(IN_CONTENT).alias("in_content"), F.sum("title_hits").alias("t"), F.sum("content_hits").alias("c"))
        low = TITLE_WEIGHT * F.col("in_title") + CONTENT_WEIGHT * F.col("in_content") + F.exp(-F.col("id") * DECAY)
        run = lambda n, weight: weight * F.col(n) * (F.col(n) - 1) / 2
        return sums.select("id", low.alias("low"), (low + run("t", TITLE_RUN) + run("c", CONTENT_RUN)).alias("high"))

    def _runs(self, ids: DataFrame, query: str) -> DataFrame:
        """(id, runs): the rating of neighbouring known tokens, from positions."""
        hits = self._positions(self.identifiers([w for w in query_words(query) if w]), ids).filter(F.col("flags").bitwiseAND(RATED | KNOWN) == (RATED | KNOWN))
        places = hits.select("id", "ord", (F.col("flags").bitwiseAND(TITLE) > 0).alias("title")).distinct()
        island = F.col("ord") - F.row_number().over(Window.partitionBy("id", "title").orderBy("ord"))
        runs = places.withColumn("island", island).groupBy("id", "title", "island").agg(F.count("*").alias("r"))
        weight = F.when(F.col("title"), TITLE_RUN).otherwise(CONTENT_RUN)
        return runs.groupBy("id").agg(F.sum(weight * F.col("r") * (F.col("r") - 1) / 2).alias("runs"))

    def rated(self, ids: DataFrame, query: str, k: int = RESULTS) -> DataFrame:
        """(id, rating) of articles among which the ``k`` best are: all that a bound can't rule out, so often few more."""
        bounds = stage(self.bounds(ids, query), "bounds")
        best = bounds.orderBy(F.desc("low")).limit(k).collect()
        least = best[-1]["low"] if len(best) == k else 0.0
        left = bounds.filter(F.round("high", 6) >= F.round(F.lit(least), 6))
        runs = self._runs(left.filter("high > low").select("id"), query)
        return left.join(runs, "id", "left").select("id", (F.col("low") + F.coalesce("runs", F.lit(0))).alias("rating"))

    def search(self, query: str, mode: str = "mixed", k: int = RESULTS, exact_phrase: bool = False) -> DataFrame:
        """id, title and rating of the ``k`` best matches; of the articles only these are read."""
        matched = self.matches(query, mode, exact_phrase)
        if matched is None:
            return self.store.spark.createDataFrame([], "id long, title string, rating double")
        matched = stage(matched, "matches")
        best = self.rated(matched, query, k).orderBy(F.desc(F.round("rating", 6)), "id").limit(k).collect()
        shown = self.store.lookup("wiki_articles", "wiki_article_id", [r["id"] for r in best]).select(F.col("wiki_article_id").alias("id"), "title")
        ratings = self.store.spark.createDataFrame([(r["id"], r["rating"]) for r in best], "id long, rating double")
        return shown.join(F.broadcast(ratings), "id").select("id", "title", "rating").orderBy(F.desc(F.round("rating", 6)), "id")

    def show(self, results: DataFrame) -> DataFrame:
        """id, title and content of the articles in ``results``."""
        ids = [r["id"] for r in results.select("id").collect()]  # a page of results
        return self.store.lookup("wiki_articles", "wiki_article_id", ids).select(F.col("wiki_article_id").alias("id"), "title", "content")
