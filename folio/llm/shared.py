"""What the operators share: staged tables, the documents, whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.sources.staging import new_path, shared_dir, stage

__all__ = ["computed_once", "documents", "new_path", "shared_dir", "stage", "whole_text"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(column: str = "text"):
    """A null text counts as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def computed_once(value):
    """``value`` as an expression that the optimiser neither copies into later expressions nor moves
    below a projection; filters on it stay above the projection that makes it."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def with_ids(docs: DataFrame, ids: DataFrame, how: str, most: int = 1_000_000) -> DataFrame:
    """``docs`` with (``left_semi``) or without (``left_anti``) the doc_ids of ``ids``.

    Up to ``most`` ids (8 MB) are broadcast, so the texts stay where they are; more are joined by a
    shuffle.
    """
    ids = ids.select("doc_id")
    return docs.join(F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids, "doc_id", how)
