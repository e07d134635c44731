"""Quote search, phrase classes, cleaning, rarity scores and the weighted answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.sources.staging import stage

RARITY, POWER, DEFAULT_DRAWS = 5.0, 10.0, 64


def formatted_quotes(quotes: DataFrame) -> DataFrame:
    """(quote_id, part, text): sub-quotes, cleaned, of at least four words."""
    parts = quotes.select("quote_id", F.posexplode(T.sub_quotes(F.col("text"))).alias("part", "text"))
    return parts.withColumn("text", T.clean_quote(F.col("text"))).filter(T.accepted(F.col("text")))


def _cleaned_forms(words: DataFrame, base_forms: DataFrame) -> DataFrame:
    """``form`` of each ``word``: first letters a-z of its lower case, their base forms or themselves ('' too)."""
    cleaned = words.withColumn("word", T.first_letters(F.col("word")))
    return cleaned.join(base_forms.select("word", "base_form"), "word", "left").withColumn("form", F.coalesce("base_form", "word")).drop("base_form").distinct()


def answer_index(formatted: DataFrame, base_forms: DataFrame) -> DataFrame:
    """(form, quote_id, part): the index of the answers, over the output of ``formatted_quotes``."""
    words = formatted.select("quote_id", "part", F.explode(F.array_distinct(T.space_tokens(F.col("text")))).alias("word"))
    return _cleaned_forms(words, base_forms).select("form", "quote_id", "part").distinct()


def quote_index(quotes: DataFrame, base_forms: DataFrame) -> DataFrame:
    """(form, quote_id): distinct base forms of the words, case kept; words without one stand for themselves."""
    words = quotes.select("quote_id", F.explode(F.array_distinct(T.space_tokens(F.col("text")))).alias("word"))
    joined = words.join(base_forms.select("word", "base_form"), "word", "left")
    return joined.select(F.coalesce("base_form", "word").alias("form"), "quote_id").distinct()


def query_forms(queries: DataFrame, base_forms: DataFrame, punctuation: bool = True) -> DataFrame:
    """(query, word, form) of the distinct words of each query; punctuation is removed from the forms looked up."""
    words = queries.select("query", F.explode(F.array_distinct(T.space_tokens(F.col("query")))).alias("word"))
    form = F.coalesce("base_form", "word")
    joined = words.join(base_forms.select("word", "base_form"), "word", "left")
    return joined.select("query", "word", (T.without_punctuation(form) if punctuation else form).alias("form")).distinct()


def matching_quotes(queries: DataFrame, index: DataFrame, base_forms: DataFrame) -> DataFrame:
    """(query, quote_id): every word of the query has a form in the quote."""
    forms = query_forms(queries, base_forms)
    needed = forms.groupBy("query").agg(F.count_distinct("word").alias("needed"))
    hits = forms.join(index, "form").groupBy("query", "quote_id").agg(F.count_distinct("word").alias("n"))
    return hits.join(needed, "query").filter("n = needed").select("query", "quote_id")


def phrase_members(phrases: DataFrame, index: DataFrame, base_forms: DataFrame) -> DataFrame:
    """(class, phrase, n_quotes): phrases with the same matching quotes are a class, named by its smallest phrase; those without any are one.

    Sets of quotes are compared by their size and two 64-bit sums of exclusive or over hashed ids, which are
    added up piece by piece: no list of quotes or of phrases stands in a row.
    """
    queries = phrases.select(F.col("phrase").alias("query")).distinct()
    found = queries.join(matching_quotes(queries, index, base_forms), "query", "left")
    digest = [F.count("quote_id").alias("n"), *[F.coalesce(F.bit_xor(F.when(F.col("quote_id").isNotNull(), F.xxhash64(F.lit(k), "quote_id"))), F.lit(0)).alias(f"h{k}") for k in (1, 2)]]
    sets = stage(found.groupBy("query").agg(*digest), "phrase-sets")
    names = sets.groupBy("n", "h1", "h2").agg(F.min("query").alias("class"))
    return sets.join(names, ["n", "h1", "h2"]).select("class", F.col("query").alias("phrase"), F.col("n").alias("n_quotes"))


def phrase_classes(phrases: DataFrame, index: DataFrame, base_forms: DataFrame) -> DataFrame:
    """(quote_ids, phrases): the classes of ``phrase_members`` as lists, for display."""
    queries = phrases.select(F.col("phrase").alias("query")).distinct()
    found = queries.join(matching_quotes(queries, index, base_forms), "query", "left")
    keys = found.groupBy("query").agg(F.array_sort(F.collect_set("quote_id")).alias("quote_ids"))
    return keys.groupBy("quote_ids").agg(F.array_sort(F.collect_list("query")).alias("phrases"))


def highlight(quotes: DataFrame, query: str, base_forms: DataFrame, spark: SparkSession) -> DataFrame:
    """(quote_id, marked): words that share a base form with the query in brackets."""
    wanted = query_forms(spark.createDataFrame([(query,)], "query string"), base_forms, punctuation=False).select("form").distinct()
    words = quotes.select("quote_id", F.posexplode(T.space_tokens(F.col("text"))).alias("ord", "word"))
    forms = words.select("word").distinct().join(base_forms.select("word", "base_form"), "word", "left").select("word", F.coalesce("base_form", "word").alias("form"))
    hits = forms.join(F.broadcast(wanted), "form", "left_semi").select("word", F.lit(True).alias("hit")).distinct()
    marked = words.join(hits, "word", "left").select("quote_id", "ord", F.when(F.col("hit"), F.concat(F.lit("["), "word", F.lit("]"))).otherwise(F.col("word")).alias("word"))
    lists = marked.groupBy("quote_id").agg(F.array_sort(F.collect_list(F.struct("ord", "word"))).alias("words"))
    return lists.select("quote_id", F.array_join(F.transform("words", lambda w: w["word"]), " ").alias("marked"))


def rarity_weights(index: DataFrame) -> DataFrame:
    """(form, weight): exp(-5 * quotes with the form / most quotes of a form)."""
    counts = index.groupBy("form").agg(F.count("*").alias("df"))
    top = counts.agg(F.max("df").alias("top"))
    return counts.join(F.broadcast(top)).select("form", F.exp(-RARITY * F.col("df") / F.col("top")).alias("weight"))


def quote_scores(query: str, formatted: DataFrame, index: DataFrame, base_forms: DataFrame, spark: SparkSession) -> DataFrame:
    """(text, score): for each word of the query and each of its forms in the quote its weight; equal texts are one.

    ``index`` is that of ``answer_index``; the query's words are cleaned as those of the quotes.
    """
    asked = spark.createDataFrame([(w,) for w in query.split(" ")], "word string")
    hits = index.join(F.broadcast(_cleaned_forms(asked, base_forms)), "form")
    scored = hits.join(rarity_weights(index), "form").groupBy("quote_id", "part").agg(F.sum("weight").alias("score"))
    return formatted.join(scored, ["quote_id", "part"]).groupBy("text").agg(F.max("score").alias("score"))


def answer_probabilities(scores: DataFrame, power: float = POWER) -> DataFrame:
    """(text, probability) in proportion to score ** power."""
    weighed = scores.withColumn("w", F.pow("score", F.lit(power)))
    total = weighed.agg(F.sum("w").alias("total"))
    return weighed.join(F.broadcast(total)).select("text", (F.col("w") / F.col("total")).alias("probability"))


def answer(scores: DataFrame, past: DataFrame | None = None, fallback: DataFrame | None = None, default: str = "", seed: int = 0) -> str:
    """A text drawn with its probability, never one of ``past``; else one of ``fallback``, else ``default``."""
    for rows in (scores, fallback):
        if rows is not None:
            left = rows.join(past.select("text"), "text", "left_anti") if past is not None else rows
            drawn = left.orderBy(-F.log(F.rand(seed)) / F.pow("score", F.lit(POWER)), "text").limit(1).collect()
            if drawn:
                return drawn[0]["text"]
    return default


def scores_of_queries(queries: DataFrame, formatted: DataFrame, index: DataFrame, base_forms: DataFrame) -> DataFrame:
    """(query, text, score): ``quote_scores`` for each row of ``queries`` (query)."""
    asked = queries.select("query").distinct().select("query", F.explode(T.space_tokens(F.col("query"))).alias("word"))
    weights = index.join(rarity_weights(index), "form")
    scored = _cleaned_forms(asked, base_forms).join(weights, "form").groupBy("query", "quote_id", "part").agg(F.sum("weight").alias("score"))
    return formatted.join(scored, ["quote_id", "part"]).groupBy("query", "text").agg(F.max("score").alias("score"))


def _drawn(rows: DataFrame, key: str, seed: int, power: float) -> DataFrame:
    """(key, answer): of each key one text, drawn in proportion to score ** power.

    Every text has an exponential waiting time of that rate, from a hash of seed, key and text; the first one is
    the minimum, which needs no sort and no more than a partial aggregate.
    """
    share = (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"), "text").cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / 2.0**52
    waiting = -F.log(share) / F.pow("score", F.lit(power))
    return rows.groupBy(key).agg(F.min_by("text", F.struct(waiting.alias("w"), "text")).alias("answer"))


def answers(queries: DataFrame, formatted: DataFrame, index: DataFrame, base_forms: DataFrame, past: DataFrame, default: str, seed: int = 0, power: float = POWER) -> DataFrame:
    """(query, answer) for each distinct query: a text drawn by its score, never one of ``past`` (text).

    A query without one takes an answer to the query ``default``: ``DEFAULT_DRAWS`` of them are drawn once, and a
    hash of the query chooses. If that has none either, the answer is ``default`` itself.
    """
    asked = stage(queries.select("query").filter("query is not null").distinct(), "queries")
    extra = asked.sparkSession.createDataFrame([(default,)], "query string")
    scores = scores_of_queries(asked.union(extra), formatted, index, base_forms)
    left = stage(scores.join(past.select("text").distinct(), "text", "left_anti"), "scores")
    own = _drawn(left.join(asked, "query", "left_semi"), "query", seed, power)
    draws = F.explode(F.sequence(F.lit(0), F.lit(DEFAULT_DRAWS - 1))).alias("draw")
    others = _drawn(left.filter(F.col("query") == default).select("text", "score", draws), "draw", seed, power).withColumnRenamed("answer", "other")
    slot = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "query").cast("binary")), 1, 13), 16, 10).cast("long") % DEFAULT_DRAWS
    missing = asked.join(own, "query", "left_anti").withColumn("draw", slot.cast("int")).join(F.broadcast(others), "draw", "left")  # one row a draw
    return own.select("query", "answer").union(missing.select("query", F.coalesce("other", F.lit(default))))
