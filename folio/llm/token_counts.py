"""Operator 7: token counts of sections by offset-mapped attribution.

A document is encoded once, whole, so that its counts add up to what a model would see. Each token
keeps the code points it stands for, the spans are joined to the document's sections (intervals
that follow one another), and a token that crosses a boundary is given to one section by ``rule``:

* ``majority``: the section that holds most of its code points, the earlier one if equal;
* ``first`` or ``last``: the section of its first or last code point.

A section begins at the start of the text and after every match of ``boundary``.

Nulls: a null text is empty and has one section without tokens; a null doc_id is kept. Repeated
rows are counted as often as they come; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.chunk_encoding import encoder
from folio.llm.shared import whole_text

RULES = ("majority", "first", "last")


def attribute(first: np.ndarray, end: np.ndarray, starts: np.ndarray, rule: str) -> np.ndarray:
    """The section of each token [first, end); ``starts`` ascend from 0."""
    low = np.searchsorted(starts, first, "right") - 1
    high = np.searchsorted(starts, np.maximum(first, end - 1), "right") - 1
    if rule == "first":
        return low
    if rule == "last":
        return high
    owner = low.copy()
    for t in np.flatnonzero(low != high):
        edges = np.concatenate([[first[t]], starts[low[t] + 1 : high[t] + 1], [end[t]]])
        owner[t] = low[t] + int(np.argmax(np.diff(edges)))
    return owner


def section_counts(docs: DataFrame, tokenizer_path: str, *, boundary: str = "\n", rule: str = "majority") -> DataFrame:
    """doc_id, section (from 0), start, end (code points) and n_tokens of every section."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    names = ["doc_id", "section", "start", "end", "n_tokens"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, cut = encoder(tokenizer_path), re.compile(boundary)
        for batch in batches:
            ids, parts = [], [[], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                starts = np.array([0, *[m.end() for m in cut.finditer(text) if 0 < m.end() < len(text)]], np.int32)
                starts = np.unique(starts)
                spans = encode.spans(text)
                owner = attribute(spans[:, 1], spans[:, 2], starts, rule)
                ids += [doc_id] * len(starts)
                for part, column in zip(parts, (np.arange(len(starts)), starts, [*starts[1:], len(text)], np.bincount(owner, minlength=len(starts)))):
                    part.append(np.asarray(column, np.int64))
            columns = [np.concatenate(p) if p else np.empty(0, np.int64) for p in parts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(columns[0].astype(np.int32)), *map(pa.array, columns[1:])], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(count, "doc_id long, section int, start long, end long, n_tokens long")
