"""One query for each operator: production parameters over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import chat, merkle, near_duplicates, neighbours, pieces, quality_classifier, quality_rules, ranked_search, secrets, sql, vector_duplicates
from folio.llm.packing import pack_documents
from folio.llm.shared import documents
from folio.llm.token_counts import section_counts
from folio.llm.token_files import token_file_index


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_index(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), end_id=0)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return secrets.scan(docs, *secrets.fit(spark, docs))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.classes(documents(spark, sf_dir), words=2, percent=80)


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, k=10)


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"  # a conversation whose texts hold control strings
    more = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{said}'), (-7L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    return chat.digests(chat.format_conversations(rows.union(more)))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(pieces.encode_pieces(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model")))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections are the lines of a document, each with the line feed that ends it."""
    return section_counts(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), boundary="\n", rule="majority")


def op8_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), end_id=1, capacity=4096)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality_rules.quality_report(documents(spark, sf_dir))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_classifier.score_documents(docs, quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=10)


def op12_vector_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_duplicates.classes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(documents(spark, sf_dir))


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_secrets": op2_secrets,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_neighbours": op4_neighbours,
    "op5_chat": op5_chat,
    "op6_pieces": op6_pieces,
    "op7_token_counts": op7_token_counts,
    "op8_best_two_fit": op8_best_two_fit,
    "op9_quality_rules": op9_quality_rules,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_ranked_search": op11_ranked_search,
    "op12_vector_duplicates": op12_vector_duplicates,
    "op13_merkle_manifest": op13_merkle_manifest,
}
SQL: dict[str, str] = {
    "op3_near_duplicates": sql.NEAR_DUPLICATES,
    "op5_chat": sql.CHAT,
    "op9_quality_rules": sql.QUALITY_RULES,
    "op11_ranked_search": sql.RANKED_SEARCH,
    "op12_vector_duplicates": sql.VECTOR_DUPLICATES,
    "op13_merkle_manifest": sql.MERKLE,
}
