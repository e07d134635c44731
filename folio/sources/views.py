"""The inputs of the engine as views over the synthetic tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    title = F.substring_index("text", "\n", 1)
    content = F.substring(F.col("text").cast("binary"), F.octet_length(title) + 2, F.octet_length("text")).cast("string")  # by bytes: characters would be counted from the start
    return docs.select((F.col("doc_id") + 1).alias("id"), title.alias("title"), content.alias("content"))


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select((F.col("page_id") + 1).alias("id"), F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"))


def base_forms(spark: SparkSession, sf_dir: str, graph: bool = False) -> DataFrame:
    """(word, base_form, pos): suffix rules over the words of the English documents; ``graph``: rules that give larger components."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("lang = 'en'")
    words = docs.select(F.explode(F.split(F.lower("text"), " ")).alias("word")).filter(F.col("word").rlike(r"^[a-z]{4,}\z")).distinct()
    stem = F.struct(F.regexp_replace("word", r"(ing|ed|es|s)\z", "").alias("base_form"), F.lit(0).alias("pos"))
    if graph:
        more = F.when((F.length("word") >= 8) & F.col("word").endswith("s"), F.struct(F.substring("word", 1, 5).alias("base_form"), F.lit(1).alias("pos")))
    else:
        more = F.when(F.col("word").endswith("es"), F.struct(F.regexp_replace("word", r"s\z", "").alias("base_form"), F.lit(1).alias("pos")))
    rows = words.select("word", F.explode(F.array_compact(F.array(stem, more))).alias("f"))
    return rows.groupBy("word", "f.base_form").agg(F.min("f.pos").alias("pos")).select("word", "base_form", "pos")


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("quote_id"), "text")
