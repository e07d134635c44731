"""Inverted indexes, boolean, phrase and mixed search, ranking and snippets.

Dictionaries are tables (word, base_form, pos). A query's words become a table of the tokens that
match them; up to ``SMALL`` rows it is broadcast to the token stream before anything is shuffled, so
only matching tokens move. With clusters a token stands for the cluster of its forms, and for "0" if
it or its form has none; a query of "0" then matches every such token, and its table is joined.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.sources.staging import stage

TITLE_WEIGHT, CONTENT_WEIGHT = 30, 5
TITLE_RUN, CONTENT_RUN = 100, 10
DECAY = 1e-5
RESULTS, RADIUS = 10, 5
SMALL = 500_000


def token_table(articles: DataFrame) -> DataFrame:
    """(id, ord, tok): the stripped lower-case token stream of title and content, ord from 0."""
    return articles.select("id", F.posexplode(T.article_tokens(F.col("title"), F.col("content"))).alias("ord", "tok"))


def by_article(articles: DataFrame) -> DataFrame:
    """The articles dealt by id, once: what is counted, sorted or made distinct within an article then moves no token.

    As many partitions as the session sets for shuffles, not fewer: tokens take many times the room of a text.
    """
    return articles.repartition(int(articles.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")


def small(table: DataFrame) -> DataFrame:
    """The table, to be broadcast if it has at most ``SMALL`` rows."""
    return F.broadcast(table) if table.limit(SMALL + 1).count() <= SMALL else table


def title_size() -> Column:
    """The tokens of an article that come from its title."""
    return F.when(F.col("title").isNull(), F.lit(0)).otherwise(T.n_space_tokens(F.col("title")))


def with_forms(tokens: DataFrame, base_forms: DataFrame, default: bool = True, column: str = "tok") -> DataFrame:
    """A row for each base form of a token; without one the token itself, or no row if not ``default``."""
    forms = base_forms.select(F.col("word").alias(column), "base_form")
    joined = tokens.join(forms, column, "left" if default else "inner")
    return joined.withColumn("form", F.coalesce("base_form", column)).drop("base_form")


def with_identifiers(forms: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """``ident``: the form, or its cluster with "0" for those without one."""
    if clusters is None:
        return forms.withColumn("ident", F.col("form"))
    named = clusters.select(F.col("term").alias("form"), F.col("cluster").cast("string").alias("ident"))
    return forms.join(named, "form", "left").withColumn("ident", F.coalesce("ident", F.lit("0")))


def with_distinct_identifiers(tokens: DataFrame, base_forms: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """A row for each distinct ``ident`` of a token ``tok``: the dictionary's identifiers are made distinct before tokens meet it."""
    forms = base_forms.select(F.col("word").alias("tok"), F.coalesce("base_form", "word").alias("form"))
    joined = tokens.join(small(with_identifiers(forms, clusters).select("tok", "ident").distinct()), "tok", "left")
    if clusters is None:
        return joined.withColumn("ident", F.coalesce("ident", "tok"))
    own = clusters.select(F.col("term").alias("_unknown"), F.coalesce(F.col("cluster").cast("string"), F.lit("0")).alias("_own")).distinct()
    joined = joined.withColumn("_unknown", F.when(F.col("ident").isNull(), F.col("tok"))).join(small(own), "_unknown", "left")
    return joined.withColumn("ident", F.coalesce("ident", "_own", F.lit("0"))).drop("_own", "_unknown")


def traditional_index(articles: DataFrame, base_forms: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """(ident, id): in which article which identifier occurs."""
    tokens = by_article(articles).select("id", F.explode(F.array_distinct(T.article_tokens(F.col("title"), F.col("content")))).alias("tok"))
    return with_distinct_identifiers(tokens, base_forms, clusters).select("ident", "id").distinct()


def document_positions(articles: DataFrame) -> DataFrame:
    """(id, start, n_tokens, n_title): position of each article's first token; articles are one position apart.

    The running sum goes over one row for each block of ids and within blocks, not over one task.
    """
    sizes = articles.select("id", T.n_space_tokens(F.concat_ws(" ", F.col("title"), F.col("content"))).alias("n_tokens"), title_size().alias("n_title"))
    sizes = sizes.withColumn("block", F.floor(F.col("id") / 4096))
    inside = Window.partitionBy("block").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    sums = sizes.groupBy("block").agg(F.sum(F.col("n_tokens") + 1).alias("sum"))
    before = sums.select("block", F.coalesce(F.sum("sum").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    local = sizes.withColumn("inside", F.coalesce(F.sum(F.col("n_tokens") + 1).over(inside), F.lit(0)))
    return local.join(before, "block").select("id", (1 + F.col("before") + F.col("inside")).alias("start"), "n_tokens", "n_title")


def positional_index(articles: DataFrame, base_forms: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """(ident, position, id): every token takes a position, all its forms share it. Starts meet the texts, not their tokens."""
    placed = articles.join(document_positions(articles).select("id", "start"), "id")
    tokens = placed.select("id", "start", F.posexplode(T.article_tokens(F.col("title"), F.col("content"))).alias("ord", "tok"))
    tokens = tokens.select("id", (F.col("start") + F.col("ord")).alias("position"), "tok")
    return with_distinct_identifiers(tokens, base_forms, clusters).select("ident", "position", "id")


def build_index(kind: str, articles: DataFrame, base_forms: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """The index of a kind: traditional or positional. Mixed search uses both; there is no mixed index."""
    if kind == "traditional":
        return traditional_index(articles, base_forms, clusters)
    if kind == "positional":
        return positional_index(articles, base_forms, clusters)
    raise ValueError(f"no index of kind {kind}")


def posting_gaps(pairs: DataFrame, wide: int = 1 << 16) -> DataFrame:
    """(form, gap) of distinct (form, id): each id less the one before it in its form, the first one less 0.

    Gaps are taken within blocks of ids; the first of a block follows the last of the form's block
    before, so no form's ids need be in one task.
    """
    rows = pairs.withColumn("block", F.floor(F.col("id") / wide))
    inside = rows.select("form", (F.col("id") - F.lag("id").over(Window.partitionBy("form", "block").orderBy("id"))).alias("gap")).filter("gap is not null")
    ends = rows.groupBy("form", "block").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    before = F.coalesce(F.lag("last").over(Window.partitionBy("form").orderBy("block")), F.lit(0))
    return inside.union(ends.select("form", (F.col("first") - before).alias("gap")))


def article_at(positions: DataFrame, starts: DataFrame) -> DataFrame:
    """As-of look-up: the article whose start is the greatest up to ``position``.

    Positions and starts meet in blocks of positions; a block without a start takes the last one
    before it from the blocks' running maximum.
    """
    wide = 1 << 16
    events = positions.select("position", F.lit(None).cast("long").alias("id"), F.lit(1).alias("kind")).distinct()
    events = events.union(starts.select(F.col("start").alias("position"), "id", F.lit(0).alias("kind"))).withColumn("block", F.floor(F.col("position") / wide))
    last = events.groupBy("block").agg(F.max_by("id", F.when(F.col("kind") == 0, F.col("position"))).alias("last"))
    carried = last.select("block", F.last("last", ignorenulls=True).over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    within = F.last("id", ignorenulls=True).over(Window.partitionBy("block").orderBy("position", "kind").rowsBetween(Window.unboundedPreceding, 0))
    found = events.withColumn("near", within).join(carried, "block").filter("kind = 1")
    return found.select("position", F.coalesce("near", "carried").alias("id")).filter("id is not null")


# queries


def query_words(query: str) -> list[str]:
    """Distinct words of the lower-cased query in first-seen order."""
    return list(dict.fromkeys(w for w in query.lower().replace('"', "").split(" ")))


def parse_mixed(query: str) -> list[tuple[str, str]]:
    """Parts (kind, text) of a mixed query: quoted parts are phrases, the rest is one normal part."""
    query = query.lower()
    parts = [("phrase", p) for p in re.findall('"(.*?)"', query)]
    rest = " ".join(re.sub('"(.*?)"', " ", query).replace('"', "").split())
    return [(k, p.strip()) for k, p in parts if p.strip()] + ([("normal", rest)] if rest else [])


def query_identifiers(spark: SparkSession, words: list[str], base_forms: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """(k, word, ident): identifiers of the base forms of each query word, k its place."""
    rows = spark.createDataFrame([(k, w) for k, w in enumerate(words)], "k int, tok string")
    return with_identifiers(with_forms(rows, base_forms), clusters).select("k", F.col("tok").alias("word"), "ident").distinct()


def matching_tokens(tokens: DataFrame, identifiers: DataFrame, base_forms: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """(tok, ident, known and the columns of ``identifiers``): every token that stands for an identifier; known if the dictionary has it.

    With clusters, tokens that the dictionary lacks have identifiers too (mostly "0"), so all tokens that occur are named.
    """
    asked = F.broadcast(identifiers)
    if clusters is None:
        forms = base_forms.select(F.col("word").alias("tok"), F.col("base_form").alias("ident"), F.lit(True).alias("known"))
        own = identifiers.select(F.col("ident").alias("tok")).distinct().join(base_forms.select(F.col("word").alias("tok")), "tok", "left_anti")
        named = forms.join(asked, "ident").unionByName(own.select("tok", F.col("tok").alias("ident"), F.lit(False).alias("known")).join(asked, "ident"))
    else:
        forms = tokens.select("tok").distinct().join(base_forms.select(F.col("word").alias("tok"), "base_form"), "tok", "left")
        forms = forms.select("tok", F.coalesce("base_form", "tok").alias("form"), F.col("base_form").isNotNull().alias("known"))
        named = with_identifiers(forms, clusters).drop("form").join(asked, "ident")
    named = stage(named.groupBy("tok", *identifiers.columns).agg(F.max("known").alias("known")), "matching-tokens")
    return F.broadcast(named) if named.limit(SMALL + 1).count() <= SMALL else named


def _asked(spark: SparkSession, parts: list[tuple[str, list[str]]], base_forms: DataFrame, clusters: DataFrame | None) -> DataFrame:
    """(part, k, ident) of the words of all parts."""
    rows = spark.createDataFrame([(p, k, w) for p, (_, words) in enumerate(parts) for k, w in enumerate(words)], "part int, k int, tok string")
    return with_identifiers(with_forms(rows, base_forms), clusters).select("part", "k", "ident").distinct()


def _complete(spark: SparkSession, parts: list[tuple[str, list[str]]], articles: DataFrame, base_forms: DataFrame, clusters: DataFrame | None) -> DataFrame:
    """(id, part, place): where a part's words all stand; of a phrase the place of its first token, else -1.

    One pass over the tokens for all parts.
    """
    tokens = token_table(articles)
    hits = tokens.join(matching_tokens(tokens, _asked(spark, parts, base_forms, clusters), base_forms, clusters), "tok")
    kinds = F.array(*[F.lit(kind == "phrase") for kind, _ in parts])
    needed = F.array(*[F.lit(len(words)) for _, words in parts])
    place = F.when(F.get(kinds, F.col("part")), F.col("ord") - F.col("k")).otherwise(F.lit(-1))
    met = hits.groupBy("id", "part", place.alias("place")).agg(F.collect_set("k").alias("ks"))  # at most the words of a query
    return met.filter(F.size("ks") == F.get(needed, F.col("part"))).select("id", "part", "place")


def phrase_matches(spark: SparkSession, words: list[str], articles: DataFrame, base_forms: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """(id, position) where the words stand one after the other."""
    found = _complete(spark, [("phrase", words)], articles, base_forms, clusters)
    return found.join(document_positions(articles), "id").select("id", (F.col("start") + F.col("place")).alias("position"))


def boolean_search(index: DataFrame, identifiers: DataFrame, n_words: int) -> DataFrame:
    """ids of the articles that hold, for every query word, one of its identifiers."""
    hits = index.join(F.broadcast(identifiers.select("ident", "k")), "ident")
    return hits.groupBy("id").agg(F.count_distinct("k").alias("n")).filter(F.col("n") == n_words).select("id")


def phrase_search(index: DataFrame, identifiers: DataFrame, n_words: int) -> DataFrame:
    """(id, position) where the words stand one after the other."""
    hits = index.join(F.broadcast(identifiers.select("ident", "k")), "ident")
    runs = hits.groupBy("id", (F.col("position") - F.col("k")).alias("position")).agg(F.count_distinct("k").alias("n"))
    return runs.filter(F.col("n") == n_words).select("id", "position")


def query_parts(query: str, mode: str, exact_phrase: bool = False) -> list[tuple[str, list[str]]]:
    """(kind, words) of the parts of a query; ``mode`` is traditional, positional or mixed.

    Words are distinct, in first-seen order; with ``exact_phrase`` a phrase keeps repeated ones.
    """
    if mode not in ("traditional", "positional", "mixed"):
        raise ValueError(f"no mode {mode}")
    parts = parse_mixed(query) if mode == "mixed" else [("phrase" if mode == "positional" else "normal", query.lower())]
    words = lambda kind, text: text.replace('"', "").split(" ") if exact_phrase and kind == "phrase" else query_words(text)
    found = [(kind, [w for w in words(kind, text) if w]) for kind, text in parts]
    return [(kind, words) for kind, words in found if words]


def search(spark: SparkSession, query: str, mode: str, articles: DataFrame, base_forms: DataFrame, clusters: DataFrame | None = None, exact_phrase: bool = False) -> DataFrame:
    """ids of the articles that match every part of the query."""
    parts = query_parts(query, mode, exact_phrase)
    if not parts:
        return articles.select("id").limit(0)
    found = _complete(spark, parts, articles, base_forms, clusters)
    return found.groupBy("id").agg(F.collect_set("part").alias("parts")).filter(F.size("parts") == len(parts)).select("id")


def mixed_search(spark: SparkSession, query: str, articles: DataFrame, base_forms: DataFrame, clusters: DataFrame | None = None, exact_phrase: bool = False) -> DataFrame:
    return search(spark, query, "mixed", articles, base_forms, clusters, exact_phrase)


# ranking


def run_rating(flags: Column, weight: int) -> Column:
    """weight * r * (r - 1) / 2 for every run of r true flags of an array."""
    start = F.struct(F.lit(0).alias("run"), F.lit(0).cast("long").alias("sum"))

    def step(s, flag):
        return F.when(flag, F.struct((s["run"] + 1).alias("run"), (s["sum"] + s["run"]).alias("sum"))).otherwise(F.struct(F.lit(0).alias("run"), s["sum"].alias("sum")))

    return F.aggregate(flags, start, step, lambda s: s["sum"] * weight)


def rate(articles: DataFrame, spark: SparkSession, query: str, base_forms: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """(id, title, rating) of the articles for a query.

    Title and content count the query's identifiers that occur in them, runs count neighbouring
    tokens that the dictionary knows and that match, and small ids weigh a little more.
    """
    words = [w for w in query_words(query) if w]
    identifiers = query_identifiers(spark, words, base_forms, clusters).select("ident").distinct()
    dealt = articles if clusters is None else by_article(articles)  # "0" matches most tokens
    tokens = dealt.select("id", F.explode(F.array(*[F.struct(F.lit(part).alias("part"), T.space_tokens(F.lower(part)).alias("toks")) for part in ("title", "content")])).alias("p"))
    tokens = tokens.select("id", "p.part", F.posexplode("p.toks").alias("ord", "tok"))
    hits = tokens.join(matching_tokens(tokens, identifiers, base_forms, clusters), "tok")
    held = lambda part: F.max(F.when(F.col("part") == part, F.lit(1)).otherwise(F.lit(0))).alias(f"in_{part}")
    once = hits.groupBy("id", "ident").agg(held("title"), held("content")).groupBy("id").agg(F.sum("in_title").alias("in_title"), F.sum("in_content").alias("in_content"))
    places = hits.filter("known").select("id", "part", "ord").distinct()
    island = F.col("ord") - F.row_number().over(Window.partitionBy("id", "part").orderBy("ord"))
    runs = places.withColumn("island", island).groupBy("id", "part", "island").agg(F.count("*").alias("r"))
    weight = F.when(F.col("part") == "title", TITLE_RUN).otherwise(CONTENT_RUN)
    runs = runs.groupBy("id").agg(F.sum(weight * F.col("r") * (F.col("r") - 1) / 2).alias("runs"))
    joined = articles.select("id", "title").join(once, "id", "left").join(runs, "id", "left").na.fill(0, ["in_title", "in_content", "runs"])
    rating = TITLE_WEIGHT * F.col("in_title") + CONTENT_WEIGHT * F.col("in_content") + F.col("runs") + F.exp(-F.col("id") * DECAY)
    return joined.select("id", "title", rating.alias("rating"))


def ranked_search(spark: SparkSession, query: str, mode: str, articles: DataFrame, base_forms: DataFrame, clusters: DataFrame | None = None, k: int = RESULTS) -> DataFrame:
    """The ``k`` best matches: id, title and rating."""
    ids = search(spark, query, mode, articles, base_forms, clusters)
    rated = rate(articles.join(ids, "id", "left_semi"), spark, query, base_forms, clusters)
    return rated.orderBy(F.desc(F.round("rating", 6)), "id").limit(k)


def snippets(articles: DataFrame, spark: SparkSession, query: str, base_forms: DataFrame, clusters: DataFrame | None = None, radius: int = RADIUS) -> DataFrame:
    """(id, snippet_no, snippet): words around matches in the content, matches in brackets."""
    identifiers = query_identifiers(spark, [w for w in query_words(query) if w], base_forms, clusters).select("ident").distinct()
    tokens = articles.select("id", F.posexplode(T.space_tokens(F.lower("content"))).alias("ord", "tok"))
    lookup = matching_tokens(tokens, identifiers, base_forms, clusters).groupBy("tok").agg(F.lit(True).alias("hit"))
    if clusters is None:  # articles without a hit have no snippet, their words need no window
        tokens = tokens.join(tokens.join(lookup, "tok", "left_semi").select("id").distinct(), "id", "left_semi")
    words = tokens.join(lookup, "tok", "left")
    near = F.max(F.coalesce("hit", F.lit(False))).over(Window.partitionBy("id").orderBy("ord").rowsBetween(-radius, radius))
    shown = words.withColumn("near", near).filter("near")
    island = F.col("ord") - F.row_number().over(Window.partitionBy("id").orderBy("ord"))
    marked = F.when(F.col("hit"), F.concat(F.lit("["), "tok", F.lit("]"))).otherwise(F.col("tok"))
    runs = shown.withColumn("island", island).groupBy("id", "island").agg(F.array_sort(F.collect_list(F.struct("ord", marked.alias("word")))).alias("words"))
    text = F.array_join(F.transform("words", lambda w: w["word"]), " ")
    number = F.row_number().over(Window.partitionBy("id").orderBy("island"))
    return runs.select("id", number.alias("snippet_no"), text.alias("snippet"))
