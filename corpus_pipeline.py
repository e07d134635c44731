"""A training corpus from `documents`: stages of folio.llm, each on all that the one before kept.

All stages but the last return documents with the columns of the table; the last returns the pieces
of the kept documents with their places in packed sequences. The classifier is fitted to labelled
documents of the table itself (see `folio.llm.quality_classifier`), so that what the rules reject can
serve as an example too.

Nulls: a document with a null text fails the rules; one with a null doc_id is judged by its text and
is nobody's near-duplicate. Repeated rows go or stay together, ties between copies go to the smallest
doc_id, columns beyond those of the table come along up to the last stage, and an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from folio.llm import near_duplicates, packing, quality_classifier, quality_rules, secrets
from folio.llm.queries import vocabulary
from folio.llm.shared import documents, stage
from folio.sources.shipping import ship


def _with_package(step: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage may be called by itself: its Python workers need the package then too."""

    @wraps(step)
    def run_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return step(spark, docs, sf_dir)

    return run_step


@_with_package
def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule go, those of distrusted hosts by the stricter rules."""
    return quality_rules.keep_good_documents(docs)


@_with_package
def keep_by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score under 0.5 go."""
    model = quality_classifier.train(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.keep_predicted(docs, model)


@_with_package
def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 over five-word shingles the smallest doc_id stays."""
    return near_duplicates.keep_one_of_each(docs, words=5, percent=80)


@_with_package
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mask; n_chars follows."""
    return secrets.redact(docs, *secrets.fit(spark, docs))


@_with_package
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their places in sequences."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), end_id=1, capacity=4096)


STAGES = [
    ("quality rules", keep_by_rules),
    ("quality classifier", keep_by_classifier),
    ("MinHash near-dedup", keep_one_of_each),
    ("secret scans", redact_secrets),
    ("best-fit packing", pack),
]
#: SQL expresses neither the classifier nor the Markov models nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{k + 1}")
    return docs
