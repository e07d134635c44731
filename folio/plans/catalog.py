"""Queries by name over the synthetic tables, each with the DuckDB SQL that returns the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions import posting_blocks as B
from folio.functions import postings as P
from folio.functions import text as T
from folio.operators import extraction, keyed_kmeans, ngrams, quotes, retrieval, sentences, spelling, stored_index, titles, vectors
from folio.operators.numbering import numbered, term_numbers
from folio.plans import oracle as O
from folio.sources import readers
from folio.sources import views as V
from folio.sources.staging import new_path, stage

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


WORDS, PHRASE, MIXED = "with that", "in the", 'with "of the"'


def _forms(spark: SparkSession, sf: str) -> DataFrame:
    """The dictionary as a stored table, made once for a query."""
    return stage(V.base_forms(spark, sf), "base-forms")


def _both(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return V.articles(spark, sf), _forms(spark, sf)


# files: written from the tables to the shared folder, then read


def _file(lines: DataFrame, *order: str) -> str:
    """The path of the text files with the rows of ``line`` in the order given."""
    path = new_path(lines.sparkSession, "text")
    lines.orderBy(*order).select("line").write.text(path)
    return path


def _flat(text: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[ \t\n\x0b\f\r]+", " ")


@query(O.READ_ARTICLES)
def read_articles(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    gap = F.when(F.col("doc_id") % 3 == 0, F.lit("\n")).otherwise(F.lit(""))  # two blank lines after some
    line = F.concat(F.lit("TITLE: Doc "), F.col("doc_id").cast("string"), F.lit("\n"), F.concat(F.lit("x"), _flat("text")), F.lit("\nend\n"), gap)
    return readers.read_articles(spark, _file(docs.select("doc_id", line.alias("line")), "doc_id"))


@query(O.READ_FORMS)
def read_base_forms(spark: SparkSession, sf: str) -> DataFrame:
    rows = _forms(spark, sf)
    path = _file(rows.select("word", "pos", "base_form", F.concat_ws(";", "base_form", "word", F.lit("x")).alias("line")), "word", "pos", "base_form")
    return readers.read_base_forms(spark, path)


@query(O.READ_QUOTES)
def read_quotes(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.quotes(spark, sf).select("quote_id", F.concat(F.lit("  "), _flat("text")).alias("line"))
    return readers.read_quotes(spark, _file(rows, "quote_id"))


@query(O.READ_NGRAMS)
def read_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    rows = _forms(spark, sf).select("word", F.concat_ws(" ", F.lit("7"), "word", "base_form").alias("line"))
    return readers.read_ngrams(spark, _file(rows, "word"), 2)


@query(O.READ_VECTORS)
def read_word_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Two lines for each term of every third vector; the later one counts."""
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    line = F.concat(F.lit("T"), F.col("vec_id").cast("string"), F.lit(" "), F.array_join(F.transform("embedding", lambda x: x.cast("string")), " "))
    old = table.filter("vec_id % 3 = 0").select(F.lit(1).alias("k"), "vec_id", F.concat(F.lit("t"), F.col("vec_id").cast("string"), F.lit(" 1 2")).alias("line"))
    head = spark.createDataFrame([(0, -1, "9 64")], "k int, vec_id long, line string")
    found = readers.read_word_vectors(spark, _file(head.union(old).union(table.select(F.lit(2), "vec_id", line)), "k", "vec_id"))
    return found.select("term", F.size("vec").alias("wide"), F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query(O.READ_PARAGRAPHS)
def read_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.concat(F.lit("### "), F.col("page_id").cast("string"), F.lit("\n a"), _flat("html"), F.lit("\nz\n")).alias("line"))
    return readers.read_paragraphs(spark, _file(pages, "page_id"))


@query(O.READ_CHARACTERS)
def read_characters(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.quotes(spark, sf).select("quote_id", _flat("text").alias("line"))
    return readers.read_characters(spark, _file(rows, "quote_id")).groupBy("ch").agg(F.count("*").alias("n"))


@query(O.READ_TYPOS)
def read_typos(spark: SparkSession, sf: str) -> DataFrame:
    return readers.read_typos(spark, _file(_typos(spark, sf).select("correction", F.concat_ws(" ", "correction", "word").alias("line")), "correction"))


@query(O.READ_CLUSTERS)
def read_term_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Written by the writer of term clusters, then read."""
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.concat(F.lit("t"), F.col("vec_id").cast("string")).alias("term"), F.col("label").alias("cluster"))
    path = new_path(spark, "clusters")
    readers.write_term_clusters(rows, path)
    return readers.read_term_clusters(spark, path)


def _stored(spark: SparkSession, sf: str) -> stored_index.TextIndex:
    """An index that is written and read again."""
    return stored_index.TextIndex.build(readers.IndexStore(spark, new_path(spark, "index")), *_both(spark, sf))


@query(O.STORED_SEARCH)
def search_stored_index(spark: SparkSession, sf: str) -> DataFrame:
    """The mixed query, matched and rated by coded posting lists."""
    return _stored(spark, sf).search(MIXED).select("id", "title", F.round("rating", 6).alias("rating"))


@query(O.BOOLEAN)
def stored_boolean(spark: SparkSession, sf: str) -> DataFrame:
    return _stored(spark, sf).boolean(retrieval.query_words(WORDS))


@query(O.PHRASE)
def stored_phrase(spark: SparkSession, sf: str) -> DataFrame:
    return _stored(spark, sf).phrase(retrieval.query_words(PHRASE))


@query(O.STORED_ARTICLES)
def stored_articles(spark: SparkSession, sf: str) -> DataFrame:
    """Title and content of the best matches, and the stored forms of a word by its key."""
    index = _stored(spark, sf)
    form = index.store.one("word_base_forms", "word", WORDS.split()[0])
    return index.show(index.search(MIXED)).withColumn("form", F.lit(form["base_form"]))


@query(O.CODED_BLOCKS)
def stored_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The blocks of the document index: skip entries and lists."""
    blocks = stored_index.indexed_terms(*_both(spark, sf))
    return blocks.select("ident", "block", "first", "last", "n", "bytes", F.hex("coded").alias("coded_hex"), "n_positions")


# search


@query(O.RANKED)
def search_boolean_ranked(spark: SparkSession, sf: str) -> DataFrame:
    articles, forms = _both(spark, sf)
    return retrieval.ranked_search(spark, WORDS, "traditional", articles, forms).select("id", "title", F.round("rating", 6).alias("rating"))


@query(O.PHRASE)
def search_phrase(spark: SparkSession, sf: str) -> DataFrame:
    articles, forms = _both(spark, sf)
    return retrieval.phrase_matches(spark, retrieval.query_words(PHRASE), articles, forms).select("id", "position")


@query(O.MIXED)
def search_mixed(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.mixed_search(spark, MIXED, *_both(spark, sf)).select("id")


@query(O.CLUSTERED)
def search_clustered(spark: SparkSession, sf: str) -> DataFrame:
    articles, forms = _both(spark, sf)
    return retrieval.search(spark, "with that", "traditional", articles, forms, _clusters(spark, sf)).select("id")


@query(O.SNIPPETS)
def snippet_kwic(spark: SparkSession, sf: str) -> DataFrame:
    articles, forms = _both(spark, sf)
    return retrieval.snippets(articles, spark, "with", forms)


@query(O.RATINGS)
def run_rating(spark: SparkSession, sf: str) -> DataFrame:
    articles, forms = _both(spark, sf)
    return retrieval.rate(articles, spark, WORDS, forms).select("id", F.round("rating", 6).alias("rating"))


@query(O.RATINGS_CLUSTERED)
def run_rating_clustered(spark: SparkSession, sf: str) -> DataFrame:
    articles, forms = _both(spark, sf)
    return retrieval.rate(articles, spark, "with unheard", forms, _clusters(spark, sf)).select("id", F.round("rating", 6).alias("rating"))


@query(O.SNIPPETS_CLUSTERED)
def snippet_clustered(spark: SparkSession, sf: str) -> DataFrame:
    articles, forms = _both(spark, sf)
    return retrieval.snippets(articles, spark, "with", forms, _clusters(spark, sf))


@query(O.DOC_FREQUENCY)
def index_doc_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.build_index("traditional", *_both(spark, sf)).groupBy("ident").agg(F.count("*").alias("df"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query(O.POSITIONS)
def index_positions(spark: SparkSession, sf: str) -> DataFrame:
    index = retrieval.build_index("positional", *_both(spark, sf))
    return index.groupBy("ident").agg(F.count("*").alias("n"), F.min("position").alias("first_position"), F.sum("position").alias("positions_sum"))


@query(O.STARTS)
def index_document_positions(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.document_positions(V.articles(spark, sf)).select("id", "start", F.col("n_tokens").cast("long").alias("n_tokens"))


@query(O.AS_OF)
def position_to_article(spark: SparkSession, sf: str) -> DataFrame:
    starts = retrieval.document_positions(V.articles(spark, sf))
    asked = starts.select((F.col("start") + F.floor(F.col("n_tokens") / 2)).alias("position"))
    return retrieval.article_at(asked, starts).select("position", "id")


@query(O.TERM_NUMBERS)
def first_seen_terms(spark: SparkSession, sf: str) -> DataFrame:
    return term_numbers(*_both(spark, sf))


# postings


def _lists(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.traditional_index(*_both(spark, sf)).groupBy("ident").agg(F.sort_array(F.collect_list("id")).alias("ids"))


@query(O.HEX)
def postings_hex(spark: SparkSession, sf: str) -> DataFrame:
    coded = B.coded_lists(_lists(spark, sf))
    return B.decoded_lists(coded).select("ident", F.hex("coded").alias("coded_hex"), (F.col("decoded") == F.col("ids")).alias("round_trip"))


@query(O.POSTING_ENDS)
def postings_ends(spark: SparkSession, sf: str) -> DataFrame:
    """Of each coded list its last element, whether it is in order, and its members by iteration."""
    back = B.decoded_lists(B.coded_lists(_lists(spark, sf)).drop("ids"))
    members = F.aggregate("decoded", F.lit(0).cast("bigint"), lambda s, x: s + x)
    return back.select("ident", F.try_element_at("decoded", F.lit(-1)).alias("last"), P.is_ordered(F.col("decoded")).alias("ordered"), F.size("decoded").cast("bigint").alias("n"), members.alias("sum"))


@query(O.SIZES)
def postings_sizes(spark: SparkSession, sf: str) -> DataFrame:
    articles, forms = _both(spark, sf)
    tokens = articles.select("id", F.explode(F.array_distinct(T.article_tokens(F.col("title"), F.col("content")))).alias("tok"))
    pairs = retrieval.with_forms(tokens, forms, default=False).select("form", "id").distinct()
    gaps = retrieval.posting_gaps(stage(pairs, "postings"))
    sizes = gaps.groupBy("form").agg(F.sum(P.n_digits(F.col("gap"), 128)).alias("d128"), F.sum(P.n_digits(F.col("gap"), 16)).alias("d16"), F.count("*").alias("n"), F.sum(2 * P.bits(F.col("gap")) - 1).alias("gamma"))
    return sizes.agg(F.sum("d128").alias("base_128"), F.sum("d16").alias("base_16"), F.sum(4 * F.col("n")).alias("int32"), F.sum(F.ceil(F.col("gamma") / 8)).alias("gamma"))


@query(O.LISTS)
def list_operations(spark: SparkSession, sf: str) -> DataFrame:
    """Articles of two forms as ordered lists: intersection and union."""
    index = retrieval.traditional_index(*_both(spark, sf)).filter(F.col("ident").isin("with", "that"))
    lists = index.groupBy().pivot("ident", ["with", "that"]).agg(F.array_sort(F.collect_list("id")))
    return lists.select(F.array_join(P.intersection(F.col("with"), F.col("that")), ",").alias("both"), F.array_join(P.union(F.col("with"), F.col("that")), ",").alias("either"))


# quotes


@query(O.QUOTE_SEARCH)
def quote_search(spark: SparkSession, sf: str) -> DataFrame:
    rows, forms = V.quotes(spark, sf), _forms(spark, sf)
    asked = spark.createDataFrame([("the of",), ("that and",), ("nowhere",)], "query string")
    return quotes.matching_quotes(asked, quotes.quote_index(rows, forms), forms).join(rows, "quote_id").select("query", "quote_id", "text")


def _phrases(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows, forms = V.quotes(spark, sf), _forms(spark, sf)
    words = rows.select(T.space_tokens(F.col("text")).alias("w")).filter("size(w) >= 2")
    phrases = words.select(F.concat_ws(" ", F.get("w", F.lit(0)), F.get("w", F.lit(1))).alias("phrase")).union(words.select(F.get("w", F.lit(1)).alias("phrase")))
    return phrases, quotes.quote_index(rows, forms), forms


@query(O.PHRASE_CLASSES)
def phrase_equivalence(spark: SparkSession, sf: str) -> DataFrame:
    found = quotes.phrase_classes(*_phrases(spark, sf))
    return found.select(F.array_join("quote_ids", ",").alias("quote_ids"), F.array_join("phrases", "|").alias("phrases"))


@query(O.PHRASE_MEMBERS)
def phrase_members(spark: SparkSession, sf: str) -> DataFrame:
    return quotes.phrase_members(*_phrases(spark, sf))


@query(O.QUOTE_CLEANING)
def quote_cleaning(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame([(r,) for r in O.DIRTY_QUOTES], "text string").union(V.quotes(spark, sf).select("text"))
    return rows.select("text", T.clean_quote(F.col("text")).alias("cleaned"), T.accepted(F.col("text")).alias("accepted"))


@query(O.SUB_QUOTES)
def quote_splitting(spark: SparkSession, sf: str) -> DataFrame:
    return quotes.formatted_quotes(V.quotes(spark, sf)).select("text")


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    rows, forms = stage(quotes.formatted_quotes(V.quotes(spark, sf)), "quotes"), _forms(spark, sf)
    return quotes.quote_scores("With that, the", rows, quotes.answer_index(rows, forms), forms, spark)


@query(O.QUOTE_SCORES)
def quote_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _answers(spark, sf).select("text", F.round("score", 6).alias("score"))


@query(O.ANSWERS)
def answer_probability(spark: SparkSession, sf: str) -> DataFrame:
    return quotes.answer_probabilities(_answers(spark, sf)).select("text", F.round("probability", 6).alias("probability"))


@query(O.ANSWERS_DRAWN)
def answers_drawn(spark: SparkSession, sf: str) -> DataFrame:
    """Each quote's first two words and a query without a match are asked; every fifth quote was given before."""
    rows, forms = V.quotes(spark, sf), _forms(spark, sf)
    formatted = stage(quotes.formatted_quotes(rows), "quotes")
    asked = rows.select(F.substring_index("text", " ", 2).alias("query")).union(rows.select(F.concat(F.lit("0 "), F.col("quote_id").cast("string")).alias("query")))
    past = formatted.filter("quote_id % 5 = 0").select("text")
    return quotes.answers(asked, formatted, quotes.answer_index(formatted, forms), forms, past, O.DEFAULT_QUERY)


@query(O.HIGHLIGHT)
def quote_highlight(spark: SparkSession, sf: str) -> DataFrame:
    return quotes.highlight(V.quotes(spark, sf), "the with", V.base_forms(spark, sf), spark)


# titles


@query(O.TITLES)
def title_fuzzy_search(spark: SparkSession, sf: str) -> DataFrame:
    return titles.find_title("the thonble ofth and", V.titles(spark, sf), spark)


# vectors


@query(O.TFIDF)
def tfidf_weights(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.tfidf(*_both(spark, sf)).select("id", "term", F.round("weight", 6).alias("weight"))


@query(O.TFIDF)
def tfidf_stored(spark: SparkSession, sf: str) -> DataFrame:
    """Saved by the first call, loaded by the second."""
    store = readers.IndexStore(spark, new_path(spark, "index"))
    for _ in range(2):
        found = vectors.stored_tfidf(store, *_both(spark, sf))
    return found.select("id", "term", F.round("weight", 6).alias("weight"))


@query(O.SIMILAR)
def tfidf_similar(spark: SparkSession, sf: str) -> DataFrame:
    articles, forms = _both(spark, sf)
    return vectors.similar(vectors.tfidf(articles, forms), articles, 1).select("id", F.round("similarity", 6).alias("similarity"))


@query(O.SIMILAR)
def tfidf_similar_stored(spark: SparkSession, sf: str) -> DataFrame:
    store, articles = readers.IndexStore(spark, new_path(spark, "index")), V.articles(spark, sf)
    vectors.store_weights(store, articles, _forms(spark, sf))
    return vectors.similar_stored(store, 1, articles).select("id", F.round("similarity", 6).alias("similarity"))


@query(O.BANNED)
def banned_terms(spark: SparkSession, sf: str) -> DataFrame:
    articles, forms = _both(spark, sf)
    return vectors.banned_terms(vectors.idf(vectors.document_terms(articles, forms), articles)).select("term", "df")


def _word_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The most frequent base forms, one for each row of embeddings, in order of frequency and vec_id; stored."""
    articles, forms = _both(spark, sf)
    words = spark.read.parquet(f"{sf}/embeddings.parquet")
    top = vectors.term_counts(articles, forms).orderBy(F.desc("n"), "term").limit(words.count())
    ranked = numbered(top.withColumn("minus", -F.col("n")), "minus", "term", name="rank")
    places = numbered(words.select("vec_id"), "vec_id", name="rank")  # numbers only; the vectors join them
    found = ranked.join(places, "rank").join(words, "vec_id")
    return stage(found.select("term", F.col("embedding").cast("array<double>").alias("vec"), F.col("label").cast("string").alias("cluster")), "word-vectors")


def _clusters(spark: SparkSession, sf: str) -> DataFrame:
    return _word_vectors(spark, sf).select("term", "cluster")


def _prefix(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    articles, forms = _both(spark, sf)
    words = _word_vectors(spark, sf)
    banned = vectors.banned_terms(vectors.idf(vectors.document_terms(articles, forms), articles))
    return articles, words, vectors.prefix_terms(articles, forms, words, banned)


@query(O.PREFIX)
def prefix_terms(spark: SparkSession, sf: str) -> DataFrame:
    return _prefix(spark, sf)[2].select("id", "i", "term")


@query(O.ARTICLE_VECTORS)
def article_vectors(spark: SparkSession, sf: str) -> DataFrame:
    articles, words, prefix = _prefix(spark, sf)
    found = vectors.article_vectors(articles, prefix, words)
    return found.select("id", F.round(F.get("vec", F.lit(0)), 6).alias("first"), F.round(T.norm(F.col("vec")), 6).alias("length"))


@query(O.SHARING)
def sharing_articles(spark: SparkSession, sf: str) -> DataFrame:
    prefix = stage(_prefix(spark, sf)[2], "prefix")
    some = prefix.groupBy("id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(1).first()
    return vectors.sharing_articles(prefix, some["id"] if some else 0)


@query(O.COSINE)
def cosine_near(spark: SparkSession, sf: str) -> DataFrame:
    words = _word_vectors(spark, sf).select("term", "vec")
    own = words.orderBy("term").limit(1).select(F.col("vec").alias("own"))
    near = words.join(F.broadcast(own)).withColumn("distance", T.cosine_distance(F.col("vec"), F.col("own")))
    return near.filter("distance <= 0.75").select("term", F.round("distance", 6).alias("distance"))


@query(O.UNIT_VECTORS)
def corpus_unit_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Unit vectors of the terms that stand in titles of the articles."""
    words = V.articles(spark, sf).select(F.explode(T.space_tokens(F.lower("title"))).alias("term"))
    found = vectors.corpus_unit_vectors(words, _word_vectors(spark, sf))
    return found.select("term", F.round(F.get("vec", F.lit(0)), 6).alias("first"), F.round(T.norm(F.col("vec")), 6).alias("length"))


@query(O.MEMBERS)
def cluster_members(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.cluster_members(_clusters(spark, sf), 3)


@query(O.ASSIGN)
def kmeans_assign_step(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    centres = rows.filter("vec_id < 8").select(F.col("vec_id").alias("cluster"), "vec")
    return vectors.assign(rows.select(F.col("vec_id").cast("string").alias("term"), "vec"), centres)


@query(O.MOVE)
def kmeans_move_step(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("term"), F.col("embedding").cast("array<double>").alias("vec"))
    return vectors.moved_centres(rows, kmeans_assign_step(spark, sf)).select("cluster", "n", "d", F.round("x", 6).alias("x"))


@query(O.KEYED_STEP)
def kmeans_keyed_step(spark: SparkSession, sf: str) -> DataFrame:
    """One round within each label at once: two runs of four centres, the first and the last vectors of a label."""
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    points = rows.select(F.col("vec_id").cast("string").alias("term"), F.col("embedding").cast("array<double>").alias("vec"))
    chunks = keyed_kmeans.chunked(points, rows.select(F.col("vec_id").cast("string").alias("term"), F.col("label").cast("long").alias("cluster")))
    ends = [F.row_number().over(Window.partitionBy("label").orderBy(order)).alias("r") for order in (F.asc("vec_id"), F.desc("vec_id"))]
    first = [rows.select(F.col("label").cast("long").alias("parent"), F.lit(start).alias("start"), r, F.col("embedding").cast("array<double>").alias("x")).filter("r <= 4") for start, r in enumerate(ends)]
    lists = first[0].union(first[1]).groupBy("parent", "start").agg(F.array_sort(F.collect_list(F.struct("r", "x"))).alias("xs"))
    centres = stage(lists.select("parent", "start", F.size("xs").alias("n_centres"), F.size(F.col("xs")[0]["x"]).alias("wide"), F.flatten("xs.x").alias("centres")), "centres")
    sums = stage(keyed_kmeans.keyed_step(chunks, centres), "sums")
    now = keyed_kmeans.moved(centres, sums).join(sums.select("parent", "start", "ns", "cost"), ["parent", "start"])
    flat = now.select("parent", "start", "wide", "ns", "cost", F.posexplode("centres").alias("i", "x"))
    child = F.floor(F.col("i") / F.col("wide")).cast("int")
    return flat.select("parent", "start", child.alias("child"), F.get("ns", child).cast("long").alias("n"), (F.col("i") % F.col("wide")).alias("d"), F.round("x", 6).alias("x"), F.round("cost", 6).alias("cost"))


def _hundred(words: DataFrame) -> DataFrame:
    return vectors.kmeans(words.select("term", T.unit(F.col("vec")).alias("vec")), k=100, rounds=10, starts=5)


@query()
def kmeans_terms(spark: SparkSession, sf: str) -> DataFrame:
    return _hundred(_word_vectors(spark, sf))


@query()
def kmeans_terms_1000(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.kmeans(_word_vectors(spark, sf).select("term", T.unit(F.col("vec")).alias("vec")), k=1000, rounds=10, starts=5)


@query()
def kmeans_hierarchical(spark: SparkSession, sf: str) -> DataFrame:
    """100 children of each of the 100 clusters of ``kmeans_terms``, over raw vectors."""
    words = _word_vectors(spark, sf)  # counted and stored once for both levels
    return keyed_kmeans.hierarchical_kmeans(words.select("term", "vec"), _hundred(words), k=100, rounds=50, starts=10)


# n-grams and lemmas


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return ngrams.word_pairs(spark.read.parquet(f"{sf}/documents.parquet").select("text"))


def _ones(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return stage(ngrams.one_grams(docs.select(F.explode(T.space_tokens(F.col("text"))).alias("w"))), "one-grams")


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select("text")


@query(O.MERGED)
def merged_words(spark: SparkSession, sf: str) -> DataFrame:
    texts, ones = _texts(spark, sf), _ones(spark, sf)
    candidates = stage(ngrams.merge_candidates(ones, ngrams.dotted_tokens(texts), _forms(spark, sf)), "candidates")
    twos = ngrams.pair_counts(ngrams.only_pairs(ngrams.cleaned_pairs(texts, ngrams.LONGER_THAN), candidates))
    return ngrams.merged_words(ones, twos, candidates)


@query(O.EXPECTED)
def merged_expected(spark: SparkSession, sf: str) -> DataFrame:
    listed = spark.createDataFrame(O.LISTED, "w1 string, w2 string")
    return ngrams.membership(listed, merged_words(spark, sf))


@query(O.SAMPLED)
def sampled_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """A hundredth of the distinct pairs of neighbouring words, and ten of those."""
    some = readers.sample_by_hash(_pairs(spark, sf).distinct(), 0.01, "w1", "w2")
    ten = ngrams.sample_of_results(some, 10).withColumn("of_ten", F.lit(True))
    return some.join(ten, ["w1", "w2"], "left").select("w1", "w2", F.coalesce("of_ten", F.lit(False)).alias("of_ten"))


@query(O.SPLIT)
def split_words(spark: SparkSession, sf: str) -> DataFrame:
    ones = _ones(spark, sf)
    pairs = ngrams.mergeable(ngrams.cleaned_pairs(_texts(spark, sf), ngrams.LONGER_THAN), ones)
    return ngrams.split_words(ones, ngrams.pair_counts(pairs))


@query(O.SUPERBASE)
def superbase_forms(spark: SparkSession, sf: str) -> DataFrame:
    return ngrams.superbase_forms(V.base_forms(spark, sf, graph=True))


@query(O.SUPERBASE_NAMES)
def superbase_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names in parts of four forms."""
    return ngrams.superbase_names(ngrams.superbase_members(V.base_forms(spark, sf, graph=True)), size=4)


def _form_classes(spark: SparkSession, sf: str) -> DataFrame:
    forms = stage(V.base_forms(spark, sf, graph=True), "base-forms")
    return ngrams.pair_classes(_pairs(spark, sf), forms, ngrams.superbase_members(forms))


@query(O.AMBIGUOUS)
def ambiguous_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    return ngrams.ambiguous_pairs(_form_classes(spark, sf))


@query(O.AMBIGUOUS_LINKS)
def ambiguous_links(spark: SparkSession, sf: str) -> DataFrame:
    return ngrams.ambiguous_links(stage(_form_classes(spark, sf), "form-classes"))


# spelling


@query(O.FOLD)
def fold_words(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    words = docs.select(F.explode(T.space_tokens(F.lower("text"))).alias("word")).distinct()
    return spelling.folded_dictionary(words)


@query(O.DELETIONS)
def deletion_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.deletion_dictionary(spelling.folded_dictionary(V.base_forms(spark, sf).select("word").distinct()))


def _typos(spark: SparkSession, sf: str) -> DataFrame:
    return _typos_of(V.base_forms(spark, sf).select("word").distinct())


def _typos_of(words: DataFrame) -> DataFrame:
    swapped = F.concat(F.substring("word", 1, 1), F.substring("word", 3, 1), F.substring("word", 2, 1), F.substring("word", F.lit(4), F.length("word")))
    return words.select(F.col("word").alias("correction"), swapped.alias("word"))


@query(O.CORRECT)
def spell_correct(spark: SparkSession, sf: str) -> DataFrame:
    deletions = spelling.deletion_dictionary(spelling.folded_dictionary(V.base_forms(spark, sf).select("word").distinct()))
    return spelling.correct_one_step(_typos(spark, sf), deletions)


@query(O.ACCURACY)
def spell_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    words = stage(V.base_forms(spark, sf).select("word").distinct(), "words")
    deletions, typos = spelling.deletion_dictionary(spelling.folded_dictionary(words)), _typos_of(words)
    return spelling.accuracy(typos.join(spelling.correct(typos.select("word").distinct(), deletions), "word"))


# sentences


@query(O.ABBREVIATIONS)
def abbreviations(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.abbreviations(spark.read.parquet(f"{sf}/documents.parquet")).select("word", "n", "with_stop", F.round("score", 6).alias("score"))


@query(O.SENTENCES)
def sentence_splitting(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return sentences.sentences(docs, sentences.abbreviations(docs), "doc_id")


# extraction


@query(O.ALIASES)
def alias_extraction(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame(O.PARAGRAPHS, "entity string, content string").union(V.articles(spark, sf).select("title", "content"))
    return rows.select("entity", extraction.alias(F.col("entity"), F.col("content")).alias("alias"))


@query(O.QUOTED)
def quoted_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return extraction.quoted_pairs(spark.createDataFrame([(t,) for t in O.QUOTED_TEXTS], "text string").union(spark.read.parquet(f"{sf}/documents.parquet").select("text")))


@query(O.LATEX_QUOTED)
def latex_quoted_pairs(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame([(t,) for t in O.LATEX_TEXTS], "text string").union(spark.read.parquet(f"{sf}/documents.parquet").select("text"))
    return extraction.quoted_pairs(rows, extraction.LATEX)


@query(O.SYNONYMS)
def close_synonyms(spark: SparkSession, sf: str) -> DataFrame:
    forms, words = _forms(spark, sf), _word_vectors(spark, sf)
    after = F.lead("term").over(Window.partitionBy("cluster").orderBy("term"))
    rows = words.select(F.col("term").alias("left"), after.alias("right")).filter("right is not null")
    return extraction.close_base_forms(rows, forms, words)


@query(O.CLASSES)
def character_classes(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    chars = docs.select(F.explode(F.split("text", "")).alias("ch")).distinct()
    return chars.select("ch", T.character_class(F.col("ch")).alias("class")).filter("class is not null")


@query(O.DIFFERENCE)
def token_difference(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.quotes(spark, sf)
    words = rows.select("quote_id", T.punctuation_tokens(F.col("text")).alias("a"))
    other = words.select((F.col("quote_id") + 1).alias("quote_id"), F.col("a").alias("b"))
    return words.join(other, "quote_id").select("quote_id", F.array_join(T.only_in_first(F.col("a"), F.col("b")), " ").alias("only_here"), F.array_join(T.only_in_first(F.col("b"), F.col("a")), " ").alias("only_before"))
