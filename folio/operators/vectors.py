"""TF-IDF, article vectors, similarity and clusters of terms."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import term_lists
from folio.functions import text as T
from folio.operators.retrieval import by_article, small
from folio.sources.staging import stage

FLOOR = 1e-3
BANNED, PREFIX, FADE, SHARED, WIDE = 100, 20, 0.1, 7, 1 << 14
NUMBERS = 8_000_000  # of vectors that are broadcast
FORMS, TERMS = 1_000_000, 5_000_000  # rows of a dictionary, and terms of several articles, that go to all workers: some 25 bytes each


def document_terms(articles: DataFrame, base_forms: DataFrame, add_missing: bool = True) -> DataFrame:
    """(id, term, n): base forms of the lower-case words of the content (titles don't count); unknown words of a-z stand for themselves if ``add_missing``."""
    words = by_article(articles).select("id", F.explode(T.space_tokens(F.lower("content"))).alias("word"))
    joined = words.join(small(base_forms.select("word", "base_form")), "word", "left")
    own = F.when(F.col("word").rlike(r"^[a-z]+\z"), F.col("word")) if add_missing else F.lit(None)
    return joined.select("id", F.coalesce("base_form", own).alias("term")).filter("term is not null").groupBy("id", "term").agg(F.count("*").alias("n"))


def term_counts(articles: DataFrame, base_forms: DataFrame) -> DataFrame:
    """(term, n): how often each base form stands in the content of all articles; words are counted before they meet the dictionary."""
    words = articles.select(F.explode(T.space_tokens(F.lower("content"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return words.join(base_forms.select("word", F.col("base_form").alias("term")), "word").groupBy("term").agg(F.sum("n").alias("n"))


def tf(terms: DataFrame) -> DataFrame:
    return terms.withColumn("tf", F.col("n") / F.sum("n").over(Window.partitionBy("id"))).select("id", "term", "tf")


def idf(terms: DataFrame, articles: DataFrame) -> DataFrame:
    """log2(all articles / articles with the term), unsmoothed; ``terms`` has a row for each term of an article."""
    total = articles.agg(F.count("*").alias("total"))
    return terms.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(total)).select("term", "df", F.log2(F.col("total") / F.col("df")).alias("idf"))


def normalised(weights: DataFrame) -> DataFrame:
    """Rows of (id, term, weight) divided by their length, at least FLOOR."""
    length = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("id")))
    return weights.withColumn("weight", F.col("weight") / F.greatest(length, F.lit(FLOOR)))


def telling_forms(base_forms: DataFrame) -> DataFrame:
    """(word, terms): the words that don't just stand for themselves as unknown words do."""
    own = F.when(F.col("word").rlike(r"^[a-z]+\z"), F.col("word"))
    rows = base_forms.filter("word is not null").select("word", F.coalesce("base_form", own).alias("term")).filter("term is not null")
    words = rows.groupBy("word").agg(F.collect_list("term").alias("terms"))  # the forms of a word
    itself = (F.size("terms") == 1) & (F.get("terms", F.lit(0)) == F.col("word")) & F.col("word").rlike(r"^[a-z]+\z")
    return words.filter(~itself)


def weighing(articles: DataFrame, base_forms: DataFrame, deal: bool = False):
    """What weighs articles where they are: (texts, forms, rarity), the last two broadcast; None if a dictionary is too large for that.

    ``texts`` are rows (id, content), as they come if no id comes twice, else (or if ``deal``) dealt and sorted by it. Only how often a
    term stands in a part of the articles is shuffled, and of the terms only those of several articles are kept: any other stands in one.
    """
    context, schema = articles.sparkSession.sparkContext, "term string, df long"
    known = stage(telling_forms(base_forms), "telling-forms")
    if (known.agg(F.sum(F.size("terms"))).first()[0] or 0) > FORMS:
        return None
    forms = context.broadcast(term_lists.Forms(known.toArrow()))
    texts = articles.select(F.col("id").cast("long").alias("id"), F.lower("content").alias("content"))
    again = not articles.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    together = by_article(texts).sortWithinPartitions("id")
    counts = (together if again else texts).mapInArrow(lambda batches: term_lists.frequencies(batches, forms.value), schema).groupBy("term").agg(F.sum("df").alias("df"))
    several = stage(counts.filter("df > 1"), "terms")
    if several.count() > TERMS:
        return None
    return together if again or deal else texts, forms, context.broadcast(term_lists.Rarity(several.toArrow(), articles.count()))


def tfidf(articles: DataFrame, base_forms: DataFrame) -> DataFrame:
    ready = weighing(articles, base_forms, deal=True)
    if ready is None:
        return joined_tfidf(articles, base_forms)
    texts, forms, rarity = ready
    return texts.mapInArrow(lambda batches: term_lists.weight_rows(batches, forms.value, rarity.value, FLOOR), "id long, term string, weight double")


def joined_tfidf(articles: DataFrame, base_forms: DataFrame) -> DataFrame:
    """As ``tfidf``, for dictionaries and vocabularies of any size: tokens and terms are shuffled to meet them."""
    terms = document_terms(articles, base_forms)
    weighed = small(stage(idf(terms, articles).select("term", "idf"), "idf"))
    return normalised(tf(terms).join(weighed, "term").select("id", "term", (F.col("tf") * F.col("idf")).alias("weight")))


def stored_tfidf(store, articles: DataFrame, base_forms: DataFrame) -> DataFrame:
    """The weights in a store's table ``embeddings``, as they are; made and saved where it has none."""
    if not store.has("embeddings"):
        store.write("embeddings", tfidf(articles, base_forms))
    return store.read("embeddings")


def similar(weights: DataFrame, articles: DataFrame, article_id: int, k: int = 10) -> DataFrame:
    """(id, similarity) of the ``k`` articles nearest to one; similarity falls, then ids rise."""
    own = weights.filter(F.col("id") == article_id).select("term", F.col("weight").alias("w"))
    dots = weights.filter(F.col("id") != article_id).join(F.broadcast(own), "term").groupBy("id").agg(F.sum(F.col("weight") * F.col("w")).alias("similarity"))
    rows = articles.filter(F.col("id") != article_id).select("id").join(dots, "id", "left").na.fill(0.0, ["similarity"])
    return rows.orderBy(F.desc(F.round("similarity", 6)), "id").limit(k)


def store_weights(store, articles: DataFrame, base_forms: DataFrame) -> None:
    """Saves TF-IDF weights twice: a row for each article, and by term in blocks of up to ``WIDE`` articles that follow each other there.

    A weight is kept as count (``parts``), idf of the term and factor of the article, whose product it is: small numbers take little room.
    Blocks are made where the articles' rows are, so no weight is shuffled.
    """
    floor, wide, ready = FLOOR, WIDE, weighing(articles, base_forms)
    if ready:
        texts, forms, rarity = ready
        rows = texts.mapInArrow(lambda batches: term_lists.weight_lists(batches, forms.value, rarity.value, floor), "id long, terms array<string>, parts array<double>, factor double")
    else:
        rarity, pairs = None, F.sort_array(F.collect_list(F.struct("term", "weight")))
        rows = joined_tfidf(articles, base_forms).groupBy("id").agg(pairs.alias("p")).select("id", F.col("p.term").alias("terms"), F.col("p.weight").alias("parts"), F.lit(1.0).alias("factor")).sortWithinPartitions("id")
    store.write("article_weights", rows.filter("id is not null"))
    saved = store.read("article_weights").select("id", "terms", "parts", "factor")
    schema = "term string, block long, idf double, n int, top float, ids array<bigint>, parts array<double>"
    store.write("weight_blocks", saved.mapInArrow(lambda batches: term_lists.blocks(batches, rarity and rarity.value, wide), schema))


def similar_stored(store, article_id: int, ids: DataFrame, k: int = 10, first: int = 64) -> DataFrame:
    """(id, similarity) as ``similar``, from stored blocks: only the article's own terms are read, and of their blocks only ids that can be among the best.

    A range of articles can give no more than the sum of its blocks' tops times the article's weights. The ``first``
    ranges by that bound are summed up, then those that reach the k-th similarity of these. ``ids`` (id) fills up
    with articles that share no term.
    """
    own = store.lookup("article_weights", "id", [article_id]).select("factor", F.explode(F.arrays_zip("terms", "parts")).alias("p"))
    own = stage(own.select(F.col("p.terms").alias("term"), (F.col("p.parts") * F.col("factor")).alias("w")), "own-weights")  # the terms of an article
    terms = [r["term"] for r in own.select("term").collect()]
    blocks = store.lookup("weight_blocks", "term", terms)
    own = stage(own.join(blocks.select("term", "idf").distinct(), "term").select("term", (F.col("w") * F.col("idf")).alias("w")), "own-weights")
    factors = store.read("article_weights").select("id", "factor")
    bounds = blocks.select("term", "block", "top").join(F.broadcast(own), "term").groupBy("block").agg(F.sum(F.col("top") * F.col("w")).alias("bound"))
    bounds = stage(bounds, "bounds")

    def sums(wanted: DataFrame) -> DataFrame:
        rows = blocks.join(wanted.select("block"), "block", "left_semi").join(F.broadcast(own), "term")
        pairs = rows.select((F.col("w") * F.col("idf")).alias("w"), F.explode(F.arrays_zip("ids", "parts")).alias("p")).filter(F.col("p.ids") != article_id)
        dots = pairs.groupBy(F.col("p.ids").alias("id")).agg(F.sum(F.col("p.parts") * F.col("w")).alias("dot"))
        return dots.join(factors, "id").select("id", (F.col("dot") * F.col("factor")).alias("similarity"))

    order = [F.desc("bound"), F.asc("block")]
    began = stage(bounds.orderBy(*order).limit(first), "first-ranges")
    nearest = [F.desc(F.round("similarity", 6)), F.asc("id")]
    best = stage(sums(began).orderBy(*nearest).limit(k), "nearest")
    reached = best.agg(F.when(F.count("*") >= k, F.min("similarity")).otherwise(F.lit(0.0))).first()[0]
    later = bounds.join(began.select("block"), "block", "left_anti").filter(F.col("bound") >= reached - 1e-6)
    met = stage(best.union(sums(later)).orderBy(*nearest).limit(k), "nearest")
    if met.count() < k:
        rest = ids.select("id").filter(F.col("id") != article_id).join(met.select("id"), "id", "left_anti").orderBy("id").limit(k)
        met = met.union(rest.withColumn("similarity", F.lit(0.0)))
    return met.orderBy(*nearest).limit(k)


def banned_terms(idfs: DataFrame, n: int = BANNED) -> DataFrame:
    return idfs.orderBy(F.round("idf", 9), "term").limit(n)


def prefix_terms(articles: DataFrame, base_forms: DataFrame, vectors: DataFrame, banned: DataFrame, n: int = PREFIX) -> DataFrame:
    """(id, i, term): the first ``n`` distinct allowed terms of the content, i from 0; the dictionary is looked up case-sensitively."""
    words = by_article(articles).select("id", F.posexplode(T.space_tokens(F.col("content"))).alias("ord", "word"))
    wanted = vectors.select("term").distinct().join(F.broadcast(banned.select("term")), "term", "left_anti")
    forms = stage(base_forms.select("word", F.col("base_form").alias("term"), "pos").join(wanted, "term", "left_semi"), "wanted-forms")
    allowed = words.join(small(forms), "word")
    place = F.col("ord").cast("long") * F.lit(1 << 32) + F.coalesce(F.col("pos").cast("long"), F.lit(-1))  # by place, then by the form's place
    first = allowed.groupBy("id", "term").agg(F.min(place).alias("at"))
    order = Window.partitionBy("id").orderBy("at", "term")
    return first.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= n).select("id", (F.col("r") - 1).alias("i"), "term")


def article_vectors(articles: DataFrame, prefix: DataFrame, vectors: DataFrame, n: int = PREFIX) -> DataFrame:
    """(id, vec): mean of the unit vectors of the prefix terms, fading by exp(-0.1 i); zeros for articles with fewer than ``n``."""
    wide = vectors.agg(F.max(F.size("vec"))).first()[0] or 0
    units = vectors.select("term", T.unit(F.col("vec")).alias("u"))
    parts = prefix.join(F.broadcast(units) if vectors.limit(NUMBERS // max(1, wide) + 1).count() * wide <= NUMBERS else units, "term")
    fading = F.exp(-FADE * F.col("i"))
    sums = parts.groupBy("id").agg(F.count("*").alias("terms"), F.min(F.size("u")).alias("least"), *[F.sum(fading * F.get("u", F.lit(d))).alias(f"x{d}") for d in range(wide)])
    means = F.slice(F.array(*[F.col(f"x{d}") / n for d in range(wide)]), 1, F.col("least"))
    full = sums.filter((F.col("terms") == n) & (F.col("least") > 0)).select("id", means.alias("xs"))
    zeros = F.array_repeat(F.lit(0.0), F.lit(_wide(vectors)))
    return articles.select("id").join(full, "id", "left").select("id", F.coalesce("xs", zeros).alias("vec"))


def _wide(vectors: DataFrame) -> int:
    first = vectors.select(F.size("vec").alias("n")).first()
    return first["n"] if first else 0


def sharing_articles(prefix: DataFrame, article_id: int, least: int = SHARED) -> DataFrame:
    """(id, shared): articles that share at least ``least`` prefix terms with one."""
    own = prefix.filter(F.col("id") == article_id).select("term")
    shared = prefix.join(F.broadcast(own), "term", "left_semi").groupBy("id").agg(F.count("*").alias("shared"))
    return shared.filter(F.col("shared") >= least)


def corpus_unit_vectors(terms: DataFrame, vectors: DataFrame) -> DataFrame:
    return vectors.join(terms.select("term").distinct(), "term", "left_semi").select("term", T.unit(F.col("vec")).alias("vec"))


def assign(points: DataFrame, centres: DataFrame) -> DataFrame:
    """(term, cluster): the nearest centre of each point, the smaller number if equal. Centres are k rows."""
    gap = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    rows = centres.select(F.collect_list(F.struct("cluster", F.col("vec").alias("c"))).alias("cs"))
    near = points.join(F.broadcast(rows)).select("term", F.array_min(F.transform("cs", lambda c: F.struct(F.round(gap(F.col("vec"), c["c"]), 9).alias("d"), c["cluster"].alias("cluster")))).alias("m"))
    return near.select("term", F.col("m.cluster").alias("cluster"))


def moved_centres(points: DataFrame, assigned: DataFrame) -> DataFrame:
    """(cluster, n, d, x): size and new centre of each cluster, a row for each dimension."""
    rows = points.join(assigned, "term").select("cluster", F.posexplode("vec").alias("d", "x"))
    return rows.groupBy("cluster", "d").agg(F.count("*").alias("n"), F.avg("x").alias("x")).select("cluster", "n", "d", "x")


def kmeans(points: DataFrame, k: int = 100, rounds: int = 10, starts: int = 5, seed: int = 1) -> DataFrame:
    """(term, cluster) of the best of ``starts`` k-means runs."""
    data = stage(points.select("term", "vec"), "points").select("term", array_to_vector("vec").alias("features"))
    fits = [KMeans(k=k, maxIter=rounds, seed=seed + s).fit(data) for s in range(starts)]
    best = min(fits, key=lambda m: m.summary.trainingCost)
    return best.transform(data).select("term", F.col("prediction").alias("cluster"))


def cluster_members(clusters: DataFrame, cluster: int) -> DataFrame:
    return clusters.filter(F.col("cluster") == cluster).select("term")
