"""Operator 1: token ids in Arrow stream files with fixed-size lists.

Each shard of the corpus is one file in the Arrow stream format. A row is a sequence of
``seq_len`` ids with a mask of the same length (a byte each: 1, or 0 for padding, only at a shard's end). Masks are
dictionary-encoded, since all but a shard's last are equal: each is stored once, a sequence holds its number. Every batch
but the last has ``batch_rows`` rows, so sequence ``i`` is row ``i % batch_rows`` of batch
``i // batch_rows`` and position ``p`` of the shard is item ``p % seq_len`` of sequence
``p // seq_len``: a memory-mapped file answers without copying. A second stream file lists the
shard's documents (doc_id, first position, count).

Shards hold ranges of doc_id in ascending order (nulls first; equal ids by text), so the
concatenation of the shards is the corpus in order.

Nulls: a null text is empty, a null doc_id is kept. Every document ends with ``end_id``, also an
empty one. Repeated rows are written as often as they come. An empty table gives no files and no
rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.chunk_encoding import encoder
from folio.llm.shared import new_path, stage, whole_text

MANIFEST = "shard int, tokens_file string, docs_file string, n_docs long, n_tokens long"
DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def sequences_schema(dtype: np.dtype, seq_len: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), seq_len)), ("mask", pa.dictionary(pa.int8(), pa.list_(pa.uint8(), seq_len)))])


class ShardWriter:
    """Writes one shard; holds one batch of sequences at a time."""

    def __init__(self, filesystem, tokens_path: str, docs_path: str, dtype: np.dtype, seq_len: int, batch_rows: int):
        self.dtype, self.seq_len, self.room = dtype, seq_len, seq_len * batch_rows
        self.schema = sequences_schema(dtype, seq_len)
        self.token_sink, self.doc_sink = filesystem.open_output_stream(tokens_path), filesystem.open_output_stream(docs_path)
        self.tokens, self.docs = pa.ipc.new_stream(self.token_sink, self.schema), pa.ipc.new_stream(self.doc_sink, DOCS)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_tokens = self.n_docs = 0
        self.index: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.index.append((doc_id, self.n_tokens, len(ids)))
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_tokens += len(ids)
        self.n_docs += 1
        if self.n_held >= self.room:
            self._flush(self.n_held // self.room * self.room)
        if len(self.index) >= 65_536:
            self._flush_index()

    def _flush(self, n: int) -> None:
        flat = np.concatenate(self.held) if self.held else np.empty(0, self.dtype)
        for a in range(0, n, self.room):
            self._batch(flat[a : a + self.room])
        self.held, self.n_held = [flat[n:]], len(flat) - n

    def _batch(self, ids: np.ndarray) -> None:
        rows = -(-len(ids) // self.seq_len)
        full = np.zeros(rows * self.seq_len, self.dtype)
        full[: len(ids)] = ids
        padded = len(ids) % self.seq_len > 0  # the last sequence of the shard
        masks = np.ones((1 + padded, self.seq_len), np.uint8)
        masks[1:, len(ids) % self.seq_len :] = 0
        which = np.zeros(rows, np.int8)
        which[rows - padded :] = 1
        ids_, masks_ = (pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), self.seq_len) for x in (full, masks))
        self.tokens.write_batch(pa.RecordBatch.from_arrays([ids_, pa.DictionaryArray.from_arrays(pa.array(which), masks_)], schema=self.schema))

    def _flush_index(self) -> None:
        if self.index:
            self.docs.write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*self.index)], schema=DOCS))
            self.index = []

    def close(self) -> None:
        self._flush(self.n_held // self.room * self.room)
        if self.n_held:
            self._batch(np.concatenate(self.held))
        self._flush_index()
        for x in (self.tokens, self.docs, self.token_sink, self.doc_sink):
            x.close()


class TokenShard:
    """Random access to a shard. On a local file system the file is memory-mapped."""

    def __init__(self, tokens_file: str):
        self.batches = list(pa.ipc.open_stream(_source(tokens_file)))
        first = self.batches[0]
        self.seq_len = first.schema.field("ids").type.list_size
        self.batch_rows = first.num_rows
        self.flat = [b.column(0).flatten().to_numpy(zero_copy_only=True) for b in self.batches]
        self.masks = [b.column(1).dictionary.flatten().to_numpy(zero_copy_only=True) for b in self.batches]
        self.which = [b.column(1).indices.to_numpy(zero_copy_only=True) for b in self.batches]

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence ``i``, both views of the file."""
        batch, row = divmod(i, self.batch_rows)
        own = lambda i: slice(i * self.seq_len, (i + 1) * self.seq_len)
        return self.flat[batch][own(row)], self.masks[batch][own(int(self.which[batch][row]))]

    def views(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids from position ``start`` on as views, one for each batch that they touch."""
        room, end = self.seq_len * self.batch_rows, start + n
        while start < end:
            batch, at = divmod(start, room)
            view = self.flat[batch][at : min(at + end - start, room)]
            yield view
            start += len(view)


def _source(file: str):
    from pyarrow import fs

    filesystem, path = fs.FileSystem.from_uri(file)
    return pa.memory_map(path) if isinstance(filesystem, fs.LocalFileSystem) else filesystem.open_input_file(path)


def write_token_files(docs: DataFrame, tokenizer_path: str, out: str, *, end_id: int = 0, seq_len: int = 2048, batch_rows: int = 64) -> DataFrame:
    """Encodes the texts and writes the shards under ``out``; returns the table of shards.

    A shard is one task's range of doc_id. Its files get their names when they are complete, so a
    repeated task replaces them with the same content.
    """
    if "://" not in out and ":/" not in out:
        out = f"file://{out}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        task = TaskContext.get()
        shard, attempt = task.partitionId(), task.taskAttemptId()
        encode, writer = encoder(tokenizer_path), None
        filesystem, root = fs.FileSystem.from_uri(out)
        names = [f"{root}/{kind}-{shard:06d}.arrow" for kind in ("tokens", "docs")]
        end = np.array([end_id], encode.dtype)
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode.each(batch.column(1))):
                if writer is None:
                    filesystem.create_dir(root, recursive=True)
                    writer = ShardWriter(filesystem, *[f"{n}.{attempt}" for n in names], encode.dtype, seq_len, batch_rows)
                writer.add(doc_id, np.concatenate([ids, end]))
        if writer is not None:
            writer.close()
            for name in names:
                filesystem.move(f"{name}.{attempt}", name)
            row = [[shard], [f"{out}/tokens-{shard:06d}.arrow"], [f"{out}/docs-{shard:06d}.arrow"], [writer.n_docs], [writer.n_tokens]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()))], ["shard", "tokens_file", "docs_file", "n_docs", "n_tokens"])

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stage(ordered.mapInArrow(write, MANIFEST), "token-shards")


def read_token_files(shards: DataFrame) -> DataFrame:
    """One row for each document of the files: doc_id, start, n_tokens, ids_crc32 and its shard.

    ``start`` counts the ids of all documents before it over all shards.
    """
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = shards.select("shard", "tokens_file", "docs_file", before.alias("before"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tokens = TokenShard(row["tokens_file"])
                for docs in pa.ipc.open_stream(_source(row["docs_file"])):
                    crcs = []
                    for start, n in zip(docs.column(1).to_pylist(), docs.column(2).to_pylist()):
                        crc = 0
                        for view in tokens.views(start, n):
                            crc = zlib.crc32(view.astype("<u4").tobytes(), crc)
                        crcs.append(crc)
                    starts = pa.array(docs.column(1).to_numpy() + row["before"])
                    yield pa.RecordBatch.from_arrays([docs.column(0), starts, docs.column(2), pa.array(crcs, pa.int64()), pa.array([row["shard"]] * len(crcs), pa.int32())], ["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    n = shards.count()
    return placed.repartition(max(1, n), "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")


def token_file_index(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Writes ``docs`` to token files in the shared folder and reads the documents back from them."""
    out = new_path(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, tokenizer_path, out, **options))
