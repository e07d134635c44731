"""Readers of the plain-text inputs and writers of the stored tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions.text import clean_word, strip


def _running(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` up to and with each row of ``_split_lines``, in the order of the files.

    Sums run within a split and over one row for each split, never over all rows in one task.
    """
    rows = rows.withColumn("_value", value.cast("long"))
    sums = rows.groupBy("file", "split").agg(F.sum("_value").alias("sum"))
    before = F.coalesce(F.sum("sum").over(Window.orderBy("file", "split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.sum("_value").over(Window.partitionBy("file", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    sums = sums.select("file", "split", before.alias("_before"))
    return rows.withColumn("_inside", inside).join(sums, ["file", "split"]).withColumn(name, F.col("_before") + F.col("_inside")).drop("_value", "_before", "_inside")


def _split_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, at, value): the lines; a file's splits start at ``split``, lines rise by ``at`` within a split."""
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    return read.withColumn("at", F.monotonically_increasing_id())


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, value): the lines of one file or of several in the order of their names, numbered from 0."""
    return _running(_split_lines(spark, path), F.lit(1), "n").select((F.col("n") - 1).alias("n"), "value")


def _blocks(spark: SparkSession, path: str, clean: Callable[[Column], Column]) -> DataFrame:
    """(file, block, split, at, lines) of the runs of lines between blank lines; a block is a row, files end blocks."""
    rows = _split_lines(spark, path).withColumn("value", clean(F.col("value")))
    rows = _running(rows, F.col("value") == "", "block").filter("value <> ''")
    # a block may lie in two splits: they follow each other, so (split, at) is the order of its lines
    lines = F.array_sort(F.collect_list(F.struct("split", "at", "value")))
    found = rows.groupBy("file", "block").agg(lines.alias("lines"))
    return found.select("file", "block", F.col("lines")[0]["split"].alias("split"), F.col("lines")[0]["at"].alias("at"), F.transform("lines", lambda x: x["value"]).alias("lines"))


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, content) of blocks separated by blank lines, numbered from 1 over all files; blocks without a title line are dropped first."""
    titled = _blocks(spark, path, lambda v: v).filter(F.get("lines", F.lit(0)).startswith("TITLE: "))
    rows = _running(titled, F.lit(1), "id")
    rest = F.slice("lines", F.lit(2), F.size("lines"))
    return rows.select("id", F.regexp_extract(F.get("lines", F.lit(0)), "TITLE: (.*)", 1).alias("title"), F.array_join(rest, "\n").alias("content"))


def read_base_forms(spark: SparkSession, path: str) -> DataFrame:
    """(word, base_form, pos) of lines base;word;...; shorter lines are dropped, pos keeps the order."""
    parts = F.split(F.col("value"), ";")
    rows = _lines(spark, path).filter(F.size(parts) >= 2)
    return rows.select(strip(F.get(parts, 1)).alias("word"), strip(F.get(parts, 0)).alias("base_form"), F.col("n").alias("pos"))


def read_quotes(spark: SparkSession, path: str) -> DataFrame:
    """(quote_id, text) with ids from 0, one for each line."""
    return _lines(spark, path).select(F.col("n").alias("quote_id"), strip(F.col("value")).alias("text"))


def read_ngrams(spark: SparkSession, path: str, n: int) -> DataFrame:
    """w1..wn of lines '<count> w1 .. wn'; the count is not used."""
    parts = F.split(strip(F.col("value")), r"\s+")
    rows = spark.read.text(path).filter(F.size(parts) > n)
    return rows.select(*[F.get(parts, k).alias(f"w{k}") for k in range(1, n + 1)])


def sample_rows(df: DataFrame, share: float, seed: int = 0) -> DataFrame:
    return df.sample(False, share, seed)


def sample_by_hash(df: DataFrame, share: float, *key: str, seed: int = 0) -> DataFrame:
    """The rows whose hash of ``key`` falls into ``share``: the same ones on each read; equal keys stay or go together."""
    return df.filter(hash_order(*key, seed=seed) < F.lit(share))


def hash_order(*key: str, seed: int = 0) -> Column:
    """A number from 0 to below 1 for each key."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in key])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(term, vec) of a word2vec text file without its header; of equal lower-case terms the last counts."""
    rows = _lines(spark, path).filter("n > 0 and value <> ''")
    parts = F.split(F.trim(F.col("value")), " ")
    vec = F.transform(F.slice(parts, F.lit(2), F.size(parts) - 1), lambda x: x.cast("double"))
    return rows.select("n", F.lower(F.get(parts, 0)).alias("term"), vec.alias("vec")).groupBy("term").agg(F.max_by("vec", "n").alias("vec"))


def read_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """(entity, content) of blocks that a blank line ends; the entity line loses four characters, the others are joined without a separator.

    Lines are stripped; a last block that no blank line ends is dropped.
    """
    rows = _blocks(spark, path, strip)
    blanks = _running(_split_lines(spark, path), strip(F.col("value")) == "", "block").groupBy("file").agg(F.max("block").alias("last"))
    closed = rows.join(F.broadcast(blanks), "file").filter("block < last")  # one row for each file
    first = F.get("lines", F.lit(0))
    return closed.select(F.substring(first, F.lit(5), F.length(first)).alias("entity"), F.array_join(F.slice("lines", F.lit(2), F.size("lines")), "").alias("content"))


def read_characters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.explode(F.split("value", " ")).alias("ch"))


def read_typos(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split(strip(F.col("value")), " ")
    return spark.read.text(path).filter(F.size(parts) >= 2).select(F.get(parts, 0).alias("correction"), F.get(parts, 1).alias("word"))


def read_term_clusters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep=" ", schema="term string, cluster string")


def read_cleaned_one_grams(spark: SparkSession, path: str) -> DataFrame:
    return read_ngrams(spark, path, 1).select(clean_word(F.col("w1")).alias("w")).filter("w is not null").groupBy("w").agg(F.count("*").alias("n"))


def write_term_clusters(clusters: DataFrame, path: str) -> None:
    clusters.select("term", F.col("cluster").cast("string")).write.mode("overwrite").csv(path, sep=" ")


class IndexStore:
    """The stored index: one Parquet table for each kind of row, under one folder."""

    TABLES = ("indexed_terms", "wiki_articles", "word_base_forms", "document_positions", "embeddings", "article_weights", "weight_blocks")

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def write(self, table: str, rows: DataFrame) -> None:
        if table not in self.TABLES:
            raise ValueError(f"no table {table}")
        rows.write.mode("overwrite").parquet(f"{self.folder}/{table}")

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{table}")

    def lookup(self, table: str, key: str, keys: list) -> DataFrame:
        """Rows with one of the keys; the filter reaches the Parquet scan."""
        return self.read(table).filter(F.col(key).isin(list(keys)))

    def one(self, table: str, key: str, value) -> Row:
        """The row of a key; KeyError without one."""
        found = self.read(table).filter(F.col(key) == value).limit(1).collect()
        if not found:
            raise KeyError(value)
        return found[0]

    def has(self, table: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{table}/_SUCCESS")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
