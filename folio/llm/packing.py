"""Operator 8: best-two-fit packing of token pieces into sequences of bounded length.

A bin is filled greedily: the longest unpacked piece, then again and again the longest that still
fits. If a gap is left, the bin's smallest piece is taken out where two unpacked pieces fit the
expanded gap more tightly than it did; of such pairs the one with the largest sum goes in.

Packing is sequential, so it runs in groups of about ``group_size`` pieces, dealt evenly whatever
the keys are. Every group is a task of bounded memory, and its last sequences may be underfilled where
its pieces are too long to share one.

Nulls: a null text is empty (its one piece is the end id), a null doc_id is kept. Repeated rows are
packed as often as they come, ties go by length, doc_id, piece. Empty tables give no rows. Columns
of the input named like the result's are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm.chunk_encoding import encoder
from folio.llm.shared import stage, whole_text

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer_path: str, *, end_id: int, capacity: int, keep_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids; only longer documents are cut.

    With ``keep_ids`` the little-endian unsigned 32-bit ids come along as a binary column ``ids``.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        end = np.array([end_id], "<u4")
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.concatenate([encode.ids(text.as_py()).astype("<u4"), end])
                for k, a in enumerate(range(0, len(ids), capacity)):
                    part = ids[a : a + capacity].tobytes()
                    rows.append((doc_id, k, a, len(part) // 4, zlib.crc32(part)) + ((part,) if keep_ids else ()))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * keep_ids
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(cut, PIECES + ", ids binary" * keep_ids)


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece. ``lengths`` are in 0..capacity."""
    order = np.argsort(lengths, kind="stable")[::-1]
    stacks: dict[int, list[int]] = {}
    for i in order.tolist():
        stacks.setdefault(int(lengths[i]), []).append(i)
    count = np.zeros(capacity + 1, np.int64)
    present = 0  # bit n: a piece of n ids is unpacked
    for n, stack in stacks.items():
        count[n] = len(stack)
        present |= 1 << n

    def take(n: int) -> int:
        nonlocal present
        count[n] -= 1
        if not count[n]:
            present &= ~(1 << n)
        return stacks[n].pop()

    def give_back(i: int) -> None:
        nonlocal present
        n = int(lengths[i])
        stacks[n].append(i)
        count[n] += 1
        present |= 1 << n

    bins, offsets, number = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    while present:
        held, gap = [], capacity
        while fits := present & ((2 << gap) - 1):
            n = fits.bit_length() - 1
            held.append(take(n))
            gap -= n
        if gap and present and len(held) > 1:
            smallest = int(lengths[held[-1]])
            pair = _best_pair(count, gap + smallest)
            if pair and sum(pair) > smallest:
                out = held.pop()
                held += [take(n) for n in pair]
                give_back(out)
        at = 0
        for i in held:
            bins[i], offsets[i] = number, at
            at += int(lengths[i])
        number += 1
    return bins, offsets


def _best_pair(count: np.ndarray, room: int) -> tuple[int, int] | None:
    """The two unpacked lengths with the largest sum up to ``room``; of equal sums the most unequal."""
    sizes = np.flatnonzero(count[: room + 1])
    if not len(sizes):
        return None
    at = np.searchsorted(sizes, room - sizes, "right") - 1
    own = (at >= 0) & (sizes[at] == sizes) & (count[sizes] < 2)
    at = np.where(own, at - 1, at)
    sums = np.where(at >= 0, sizes + sizes[at], -1)
    best = int(np.argmax(sums))
    return (int(sizes[at[best]]), int(sizes[best])) if sums[best] >= 0 else None


def pack(pieces: DataFrame, *, capacity: int, group_size: int = 32_768) -> DataFrame:
    """Adds sequence_id and offset to pieces with the columns doc_id, piece and length."""
    pieces = pieces.drop("sequence_id", "offset")
    n = pieces.count()
    groups = max(1, -(-n // group_size))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def fill(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.drop_columns("_group").sort_by([("length", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")])
        bins, offsets = best_two_fit(rows["length"].to_numpy(), capacity)
        return rows.append_column("sequence_id", pa.array((key[0].as_py() << 32) + bins)).append_column("offset", pa.array(offsets))

    # by position in the stored table: equal keys and repeated rows spread as well as others do
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("_group").applyInArrow(fill, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, *, end_id: int = 1, capacity: int = 4096, keep_ids: bool = False) -> DataFrame:
    """Cuts the documents into pieces and packs them; the pieces are stored once in between."""
    return pack(stage(token_pieces(docs, tokenizer_path, end_id=end_id, capacity=capacity, keep_ids=keep_ids), "pieces"), capacity=capacity)
