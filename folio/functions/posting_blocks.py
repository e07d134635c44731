"""Blocks of coded posting lists in Arrow batches: the digits of `folio.functions.postings` in base 128, many lists at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

AT_ONCE = 1 << 20  # numbers

_LIMITS = [1 << 7 * k for k in range(1, 9)]


def write_digits(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary for each of the lists of positive numbers that stand one after the other in ``values``.

    Digits of 7 bits, the most significant first; the last one of a number has 128 added.
    """
    digits = np.ones(len(values), np.int64)
    for limit in _LIMITS:
        digits += values >= limit
    ends = digits.cumsum()
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(digits.max(initial=0))):
        there = digits > k
        out[ends[there] - 1 - k] = values[there] >> 7 * k & 127
    out[ends - 1] |= 128
    last = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(last.astype(np.int32)), pa.py_buffer(out)])


def read_digits(coded: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all lists one after the other, and how many each list has; bytes after a list's last flagged one are ignored."""
    coded = coded.cast(pa.binary())
    edges = np.frombuffer(coded.buffers()[1], np.int32)[coded.offset : coded.offset + len(coded) + 1].astype(np.int64)
    raw = np.frombuffer(coded.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    edges = edges - edges[0]
    ends = np.flatnonzero(raw >= 128)
    counts = np.diff(np.searchsorted(ends, edges))
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    starts = np.maximum(starts, edges[np.searchsorted(edges, ends, side="right") - 1])  # a list begins anew
    values, digits = np.zeros(len(ends), np.int64), (raw & 127).astype(np.int64)
    for k in range(int((ends - starts).max(initial=-1)) + 1):
        there = ends - starts >= k
        values[there] += digits[ends[there] - k] << 7 * k
    return values, counts


def write_lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Rising lists as digits of their gaps, the first of each from 0."""
    gaps = np.diff(values, prepend=0)
    first = np.cumsum(counts) - counts
    gaps[first[counts > 0]] = values[first[counts > 0]]
    if (gaps <= 0).any():
        raise ValueError("posting lists rise strictly from 1 on")
    return write_digits(gaps, counts)


def read_lists(coded: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    gaps, counts = read_digits(coded)
    sums = gaps.cumsum()
    before = np.concatenate([[0], sums])[np.cumsum(counts) - counts]
    return sums - np.repeat(before, counts), counts


def _parts(batch: pa.RecordBatch, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``AT_ONCE`` by the sum of their sizes."""
    part = np.cumsum(sizes) // AT_ONCE
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1), len(part)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def coded_lists(lists: DataFrame) -> DataFrame:
    """(ident, ids) with ``coded``, the list as digits of its gaps."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _parts(batch, batch.column(1).value_lengths().to_numpy()):
                ids = some.column(1)
                coded = write_lists(ids.flatten().to_numpy(), ids.value_lengths().to_numpy())
                yield pa.RecordBatch.from_arrays([*some.columns, coded], ["ident", "ids", "coded"])

    return lists.select("ident", "ids").mapInArrow(code, "ident string, ids array<long>, coded binary")


def decoded_lists(coded: DataFrame) -> DataFrame:
    """The rows with ``decoded``, the ids of the column ``coded``."""
    at, names = coded.columns.index("coded"), [*coded.columns, "decoded"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _parts(batch, np.diff(np.frombuffer(batch.column(at).cast(pa.binary()).buffers()[1], np.int32)[batch.column(at).offset :][: batch.num_rows + 1])):
                values, counts = read_lists(some.column(at))
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], counts.cumsum()]), pa.int32()), pa.array(values))
                yield pa.RecordBatch.from_arrays([*some.columns, ids], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema)
    return coded.mapInArrow(decode, f"{schema}, decoded array<bigint>")
