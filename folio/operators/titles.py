"""Fuzzy title look-up by character trigrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import text as T

CANDIDATES, COUNT_PENALTY = 100, 3


def trigram_index(titles: DataFrame) -> DataFrame:
    """(trigram, id), distinct."""
    words = F.flatten(F.transform(T.space_tokens(F.col("title")), T.trigrams))
    return titles.select("id", F.explode(F.array_distinct(words)).alias("trigram"))


def title_candidates(query: str, index: DataFrame, spark: SparkSession) -> DataFrame:
    """(id, hits): how many trigram occurrences of the query each title shares."""
    asked = spark.createDataFrame([(query.lower(),)], "q string").select(F.explode(F.flatten(F.transform(T.space_tokens(F.col("q")), T.trigrams))).alias("trigram"))
    counts = asked.groupBy("trigram").agg(F.count("*").alias("times"))
    return index.join(F.broadcast(counts), "trigram").groupBy("id").agg(F.sum("times").alias("hits"))


def word_length_penalty(query: Column, title: Column, intended: bool = False) -> Column:
    """Always 0 as the engine defines it; ``intended``: summed differences of word lengths in order."""
    if not intended:
        return F.lit(0)
    lengths = F.zip_with(T.space_tokens(query), T.space_tokens(title), lambda a, b: F.abs(F.coalesce(F.length(a), F.lit(0)) - F.coalesce(F.length(b), F.lit(0))))
    return F.aggregate(lengths, F.lit(0), lambda s, x: s + x)


def find_title(query: str, titles: DataFrame, spark: SparkSession, index: DataFrame | None = None, intended: bool = False) -> DataFrame:
    """(id, title, hits, score, best): the best title and its siblings without parentheses, of the top candidates."""
    index = trigram_index(titles) if index is None else index
    top = title_candidates(query, index, spark).orderBy(F.desc("hits"), "id").limit(CANDIDATES)
    asked = F.lit(query.lower())
    penalty = COUNT_PENALTY * F.abs(F.size(T.space_tokens(asked)) - F.size(T.space_tokens(F.col("title"))))
    rows = titles.join(F.broadcast(top), "id").withColumn("score", F.col("hits") - word_length_penalty(asked, F.col("title"), intended) - penalty)
    best = rows.orderBy(F.desc("score"), "id").limit(1).select(F.col("id").alias("best_id"), T.without_parentheses(F.col("title")).alias("short"))
    joined = rows.withColumn("short", T.without_parentheses(F.col("title"))).join(F.broadcast(best), "short")
    return joined.select("id", "title", "hits", "score", (F.col("id") == F.col("best_id")).alias("best"))
