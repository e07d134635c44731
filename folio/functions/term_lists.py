"""Terms counted and weighed in Arrow and numpy where the articles are; nothing of a token is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

BYTES = 8_000_000  # of text that is cut into words at once
PAIRS = 4_000_000  # (article, term) pairs that are laid out by term at once


def _hashes(strings: pa.Array) -> np.ndarray:
    return pd.util.hash_array(strings.to_numpy(zero_copy_only=False), categorize=False) if len(strings) else np.empty(0, np.uint64)


class Places:
    """The places of distinct strings, found by sorted hashes and compared in full: 25 bytes a string or so, and no table built again for each batch."""

    def __init__(self, strings: pa.Array):
        hashes = _hashes(strings)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes, self.strings = hashes[self.order], strings
        self.most = int(np.unique(hashes, return_counts=True)[1].max()) if len(hashes) else 0

    def of(self, wanted: pa.Array) -> np.ndarray:
        """The place of each string, -1 if it isn't there."""
        found = np.full(len(wanted), -1)
        if not self.most or not len(wanted):
            return found
        first = np.searchsorted(self.hashes, _hashes(wanted))
        for step in range(self.most):  # strings with one hash stand side by side
            place = self.order[np.minimum(first + step, len(self.order) - 1)]
            same = pc.equal(self.strings.take(pa.array(place)), wanted).to_numpy(zero_copy_only=False)
            found = np.where(same, place, found)
        return found


class Forms:
    """A dictionary of words with their terms; other words of a-z stand for themselves."""

    def __init__(self, table: pa.Table):
        words, terms = table["word"].combine_chunks(), table["terms"].combine_chunks()
        self.places, self.terms = Places(words), terms.flatten()
        self.counts = np.asarray(terms.value_lengths(), np.int64) if len(terms) else np.empty(0, np.int64)
        self.starts = np.cumsum(self.counts) - self.counts

    def terms_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """For distinct words: how many terms each has, the terms' numbers one word after the other, and the terms."""
        at = self.places.of(words)
        own = (at < 0) & pc.match_substring_regex(words, r"^[a-z]+\z").to_numpy(zero_copy_only=False)
        counts = own.astype(np.int64)
        known = np.flatnonzero(at >= 0)
        counts[known] = self.counts[at[known]]
        ends = np.cumsum(counts)
        source = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
        source[(ends - counts)[own]] = len(self.terms) + np.flatnonzero(own)
        n = counts[known]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        source[np.repeat((ends - counts)[known], n) + inner] = np.repeat(self.starts[at[known]], n) + inner
        taken = np.flatnonzero(source < len(self.terms))
        strings = pa.concat_arrays([self.terms.take(pa.array(source[taken])), words.take(pa.array(np.flatnonzero(own)))])
        encoded = strings.dictionary_encode()
        numbers = np.empty(len(source), np.int64)
        codes = encoded.indices.to_numpy()
        numbers[taken], numbers[source >= len(self.terms)] = codes[: len(taken)], codes[len(taken) :]
        return counts, numbers, encoded.dictionary


def _summed(row: np.ndarray, code: np.ndarray, n: np.ndarray | None, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each (row, code) once, with the sum of its n or the number of times it came."""
    key = row * wide + code
    if n is None:
        key, sums = np.unique(key, return_counts=True)
    else:
        key, inverse = np.unique(key, return_inverse=True)
        sums = np.bincount(inverse, n, len(key)).astype(np.int64)
    return key // max(1, wide), key % max(1, wide), sums


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
        a = 0
        while a < batch.num_rows:
            before = ends[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(ends, before + BYTES, "right")))
            yield batch.slice(a, b - a)
            a = b


def article_terms(batches: Iterator[pa.RecordBatch], forms: Forms) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """From rows (id, lower-case content): (ids, row, code, n, terms), where the article ids[row] has terms[code] n times; by row, then by code.

    Rows of one id that follow each other are one article, in whatever batches they come.
    """
    held = None  # the last article: its id, terms and counts
    for batch in _slices(batches):
        ids = batch.column(0)
        number, null = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), pc.is_null(ids).to_numpy(zero_copy_only=False)
        new = np.r_[True, (number[1:] != number[:-1]) | (null[1:] != null[:-1])]
        group, ids = np.cumsum(new) - 1, ids.take(pa.array(np.flatnonzero(new)))
        lists = pc.split_pattern(pc.drop_null(batch.column(1)), " ")
        encoded = lists.flatten().dictionary_encode()
        full = ~pc.is_null(batch.column(1)).to_numpy(zero_copy_only=False)
        row = np.repeat(group[full], np.asarray(lists.value_lengths(), np.int64))
        word = encoded.indices.to_numpy()
        counts, numbers, terms = forms.terms_of(encoded.dictionary)
        n = counts[word]
        starts = (np.cumsum(counts) - counts)[word]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        row, code, n = _summed(np.repeat(row, n), numbers[np.repeat(starts, n) + inner], None, len(terms))
        if held and held[0].equals(ids[0]):
            both = pa.concat_arrays([terms, held[1]]).dictionary_encode()
            to, terms = both.indices.to_numpy().astype(np.int64), both.dictionary
            code = np.r_[to[: len(to) - len(held[1])][code], to[len(to) - len(held[1]) :]]
            row, code, n = _summed(np.r_[row, np.zeros(len(held[1]), np.int64)], code, np.r_[n, held[2]], len(terms))
        elif held:
            yield _alone(held)
        last = int(np.searchsorted(row, len(ids) - 1))
        held = (ids[-1], terms.take(pa.array(code[last:])), n[last:])
        if len(ids) > 1:
            yield ids[:-1], row[:last], code[:last], n[:last], terms
    if held:
        yield _alone(held)


def _alone(held: tuple) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    return pa.array([held[0].as_py()], pa.int64()), np.zeros(len(held[1]), np.int64), np.arange(len(held[1])), held[2], held[1]


class Rarity:
    """log2(articles / articles with the term); terms that aren't in the table stand in one article."""

    def __init__(self, table: pa.Table, total: int):
        self.places, self.total = Places(table["term"].combine_chunks()), total
        self.df = np.r_[np.asarray(table["df"].combine_chunks(), np.int64), 1]

    def idf(self, terms: pa.Array) -> np.ndarray:
        return np.log2(self.total / self.df[self.places.of(terms)])


def factors(row: np.ndarray, n: np.ndarray, idf: np.ndarray, articles: int, floor: float) -> np.ndarray:
    """For each article what its counts times idf are multiplied by to be its weights."""
    sums = np.maximum(1, np.bincount(row, n, articles))
    length = np.sqrt(np.bincount(row, (n / sums[row] * idf) ** 2, articles))
    return 1 / sums / np.maximum(length, floor)


def frequencies(batches: Iterator[pa.RecordBatch], forms: Forms) -> Iterator[pa.RecordBatch]:
    """(term, df): in how many articles of a part of them each term stands."""
    for _, _, code, _, terms in article_terms(batches, forms):
        df = np.bincount(code, minlength=len(terms))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([terms.take(pa.array(some)), pa.array(df[some])], ["term", "df"])


def weight_rows(batches: Iterator[pa.RecordBatch], forms: Forms, rarity: Rarity, floor: float) -> Iterator[pa.RecordBatch]:
    """(id, term, weight)"""
    for ids, row, code, n, terms in article_terms(batches, forms):
        idf = rarity.idf(terms)[code]
        weight = n * idf * factors(row, n, idf, len(ids), floor)[row]
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), terms.take(pa.array(code)), pa.array(weight)], ["id", "term", "weight"])


def weight_lists(batches: Iterator[pa.RecordBatch], forms: Forms, rarity: Rarity, floor: float) -> Iterator[pa.RecordBatch]:
    """(id, terms, parts, factor): an article's weight of a term is part times idf times factor."""
    for ids, row, code, n, terms in article_terms(batches, forms):
        factor = factors(row, n, rarity.idf(terms)[code], len(ids), floor)
        ends = pa.array(np.r_[0, np.cumsum(np.bincount(row, minlength=len(ids)))].astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, terms.take(pa.array(code))), pa.ListArray.from_arrays(ends, pa.array(n.astype(float)))]
        yield pa.RecordBatch.from_arrays([ids, *lists, pa.array(factor)], ["id", "terms", "parts", "factor"])


def blocks(batches: Iterator[pa.RecordBatch], rarity: Rarity | None, wide: int) -> Iterator[pa.RecordBatch]:
    """(term, block, idf, n, top, ids, parts) from ``weight_lists``: up to ``wide`` articles that follow each other, laid out by term.

    A block is named by its smallest id; ``top`` is a term's greatest weight there, rounded up. Without ``rarity`` parts are weights.
    """

    def laid_out(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        lists = pa.concat_arrays([r.column(1) for r in rows])
        row = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths(), np.int64))
        encoded = lists.flatten().dictionary_encode()
        by_name = pc.array_sort_indices(encoded.dictionary).to_numpy()
        rank = np.empty(len(by_name), np.int64)
        rank[by_name] = np.arange(len(by_name))
        code = rank[encoded.indices.to_numpy()]
        ids = np.concatenate([r.column(0).to_numpy() for r in rows])
        order = np.lexsort((ids[row], code))
        code, row = code[order], row[order]
        parts = pa.concat_arrays([r.column(2) for r in rows]).flatten().to_numpy()[order]
        terms = encoded.dictionary.take(pa.array(by_name))
        idf = rarity.idf(terms) if rarity else np.ones(len(terms))
        starts = np.searchsorted(code, np.arange(len(terms)))
        factor = np.concatenate([r.column(3).to_numpy() for r in rows])
        top = np.maximum.reduceat(parts * idf[code] * factor[row], starts) if len(code) else np.empty(0)
        top = np.nextafter(top.astype(np.float32), np.float32(np.inf))
        ends = pa.array(np.r_[starts, len(code)].astype(np.int32))
        columns = [terms, pa.array(np.full(len(terms), ids.min() if len(ids) else 0)), pa.array(idf), pa.array(np.diff(np.r_[starts, len(code)]).astype(np.int32)), pa.array(top)]
        columns += [pa.ListArray.from_arrays(ends, pa.array(ids[row])), pa.ListArray.from_arrays(ends, pa.array(parts))]
        return pa.RecordBatch.from_arrays(columns, ["term", "block", "idf", "n", "top", "ids", "parts"])

    rows, n, pairs = [], 0, 0
    for batch in batches:
        for a in range(0, batch.num_rows, min(wide, 1024)):
            part = batch.slice(a, min(wide, 1024))
            more = pc.sum(pc.list_value_length(part.column(1))).as_py() or 0
            if rows and (n + part.num_rows > wide or pairs + more > PAIRS):
                yield laid_out(rows)
                rows, n, pairs = [], 0, 0
            rows, n, pairs = [*rows, part], n + part.num_rows, pairs + more
    if rows:
        yield laid_out(rows)
