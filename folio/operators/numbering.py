"""Dense numbers over rows of any number, and the first-seen numbers of terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.sources.staging import stage


def numbered(df: DataFrame, *order: str, name: str = "id", start: int = 1) -> DataFrame:
    """``df`` with dense numbers from ``start`` by ``order``; rows that are equal in it get numbers of their own, in any order.

    Rows are dealt by ranges, so a number is a row's place in its partition plus one sum for each
    partition before it; equal rows spread over partitions too. The rows are staged once.
    """
    keys = [*order, "_at"]
    dealt = df.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = stage(dealt.drop("_at").withColumn("_seat", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_seat", 33)  # the partition; seats rise within it
    sizes = dealt.groupBy(part.alias("_part")).agg(F.min("_seat").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", (F.lit(start) + before - F.col("_first")).alias("_offset"))  # a row for each partition
    return dealt.join(F.broadcast(offsets), part == F.col("_part")).withColumn(name, F.col("_seat") + F.col("_offset")).drop("_seat", "_part", "_offset")


def term_numbers(articles: DataFrame, base_forms: DataFrame, add_missing: bool = True) -> DataFrame:
    """(term, number): base forms of the lower-case words of the content, numbered from 0 as they are first seen.

    Articles go by id, words by place, forms of a word by their place in the dictionary; unknown words of
    a-z stand for themselves if ``add_missing``. The first place of a word is found before the dictionary is
    joined, so each distinct word meets it once.
    """
    words = articles.select("id", F.posexplode(T.space_tokens(F.lower("content"))).alias("ord", "word"))
    first = words.groupBy("word").agg(F.min(F.struct("id", "ord")).alias("at"))
    joined = first.join(base_forms.select("word", "base_form", "pos"), "word", "left")
    own = F.when(F.col("word").rlike(r"^[a-z]+\z"), F.col("word")) if add_missing else F.lit(None).cast("string")
    named = joined.select(F.coalesce("base_form", own).alias("term"), F.struct("at.id", "at.ord", F.coalesce("pos", F.lit(0)).alias("pos")).alias("place")).filter("term is not null")
    once = named.groupBy("term").agg(F.min("place").alias("place"))
    return numbered(once.select("term", "place.*"), "id", "ord", "pos", "term", name="number", start=0).select("term", "number")
