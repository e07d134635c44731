"""n-gram counts, wrongly merged and split words, lemma components and ambiguous n-grams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators.components import connected_components
from folio.operators.numbering import numbered
from folio.sources.readers import hash_order
from folio.sources.staging import stage

LONGER_THAN, SHARE, OFTEN, DIFFERENCE, RARE, SPLIT_SHARE = 3, 0.5, 20, 0.3, 0.01, 0.4
NAME_PART, SUBSETS, BLOCK, SMALL, SMALL_HASHES = 1_000, 8, 1_000, 500_000, 4_000_000


def word_pairs(texts: DataFrame) -> DataFrame:
    """(w1, w2): neighbouring single-space tokens of ``text``."""
    words = texts.select(T.space_tokens(F.col("text")).alias("w"))
    return words.select(F.explode(F.transform(T.positions(1, F.size("w") - 1), lambda i: F.struct(F.get("w", i - 1).alias("w1"), F.get("w", i).alias("w2")))).alias("p")).select("p.*")


def cleaned_pairs(texts: DataFrame, longer_than: int = 0) -> DataFrame:
    """(w1, w2): neighbouring tokens of ``text``, cleaned, of which both have letters and more than ``longer_than`` of them; each token is cleaned once."""
    words = texts.select(F.transform(T.space_tokens(F.col("text")), T.clean_word).alias("w"))
    pair = lambda i: F.struct(F.get("w", i - 1).alias("w1"), F.get("w", i).alias("w2"))
    long = lambda i: (F.length(F.get("w", i - 1)) > longer_than) & (F.length(F.get("w", i)) > longer_than)  # noqa: E731  null without letters
    return words.select(F.explode(F.transform(F.filter(T.positions(1, F.size("w") - 1), long), pair)).alias("p")).select("p.*")


def dotted_tokens(texts: DataFrame) -> DataFrame:
    """(w): the cleaned pieces of tokens with full stops that have letters, as has a neighbour of theirs."""
    tokens = texts.filter(F.contains("text", F.lit("."))).select(T.space_tokens(F.col("text")).alias("t"))
    some = lambda i: F.coalesce(F.get("t", i).rlike("[a-zA-Z]"), F.lit(False))
    wanted = lambda i: F.contains(F.get("t", i), F.lit(".")) & some(i) & (some(i - 1) | some(i + 1))
    found = tokens.select(F.explode(F.transform(F.filter(T.positions(0, F.size("t") - 1), wanted), lambda i: F.get("t", i))).alias("token")).distinct()
    return found.select(F.explode(T.dotted_words(F.col("token"))).alias("w")).distinct()


def only_pairs(pairs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The pairs that are in ``wanted`` (w1, w2), before anything is shuffled if these are at most ``SMALL``."""
    wanted = wanted.select("w1", "w2").distinct()
    return pairs.join(F.broadcast(wanted) if wanted.limit(SMALL + 1).count() <= SMALL else wanted, ["w1", "w2"], "left_semi")


def pair_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("w1", "w2").agg(F.count("*").alias("n"))


def one_grams(words: DataFrame) -> DataFrame:
    return words.select(T.clean_word(F.col("w")).alias("w")).filter("w is not null").groupBy("w").agg(F.count("*").alias("n"))


def two_grams(pairs: DataFrame) -> DataFrame:
    cleaned = pairs.select(T.clean_word(F.col("w1")).alias("w1"), T.clean_word(F.col("w2")).alias("w2"))
    return cleaned.filter("w1 is not null and w2 is not null").groupBy("w1", "w2").agg(F.count("*").alias("n"))


def correction_words(pairs: DataFrame) -> DataFrame:
    """(w): cleaned pieces of words with full stops, of pairs whose words both have letters."""
    both = pairs.filter(F.contains("w1", F.lit(".")) | F.contains("w2", F.lit("."))).distinct().filter(T.clean_word(F.col("w1")).isNotNull() & T.clean_word(F.col("w2")).isNotNull())
    return both.select(F.explode(F.concat(T.dotted_words(F.col("w1")), T.dotted_words(F.col("w2")))).alias("w")).distinct()


def merge_candidates(ones: DataFrame, corrections: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(w, w1, w2): the ways to cut words into two long enough ones of the dictionary."""
    words = ones.select("w").union(corrections.select("w")).distinct().filter(F.length("w") > 2 * LONGER_THAN + 1)
    cut = words.select("w", F.explode(T.splits(F.col("w"))).alias("s")).select("w", F.col("s.left").alias("w1"), F.col("s.right").alias("w2"))
    cut = cut.filter((F.length("w1") > LONGER_THAN) & (F.length("w2") > LONGER_THAN))
    known = dictionary.select("word").distinct()
    return cut.join(known.withColumnRenamed("word", "w1"), "w1", "left_semi").join(known.withColumnRenamed("word", "w2"), "w2", "left_semi").select("w", "w1", "w2")


def merged_words(ones: DataFrame, twos: DataFrame, candidates: DataFrame) -> DataFrame:
    """(w1, w2) of words that stand as one although they are two; ``twos`` needs the counts of the candidates only."""
    cut = candidates
    count = lambda column, name: ones.select(F.col("w").alias(column), F.col("n").alias(name))
    rows = cut.join(count("w", "c"), "w", "left").join(count("w1", "c1"), "w1", "left").join(count("w2", "c2"), "w2", "left")
    rows = rows.join(twos.withColumnRenamed("n", "c12"), ["w1", "w2"], "left").na.fill(0, ["c", "c1", "c2", "c12"])
    together = (F.col("c12") >= F.col("c") * SHARE) & (F.col("c") > 0)
    low = F.least("c1", "c2")
    alike = (low > OFTEN) & (F.abs(F.col("c1") - F.col("c2")) <= low * DIFFERENCE) & ((F.col("c1") + F.col("c2")) * RARE >= F.col("c"))
    return rows.filter(together | alike).select("w1", "w2")


def mergeable(pairs: DataFrame, ones: DataFrame) -> DataFrame:
    """The pairs of words of ``ones`` that are one of its words when joined.

    Words are cut in two first, and only the cuts of which both parts are words meet the pairs; up to
    ``SMALL_HASHES`` do by their hashes before anything is shuffled, which lets by a pair of equal hash, if any.
    """
    words = ones.filter(F.length("w") > LONGER_THAN).select("w")
    ends = T.positions(LONGER_THAN + 1, F.length("w") - LONGER_THAN - 1)
    parts = F.transform(ends, lambda i: F.struct(F.substring("w", F.lit(1), i).alias("w1"), F.substring("w", i + 1, F.length("w")).alias("w2")))
    cut = words.filter(F.length("w") > 2 * LONGER_THAN + 1).select(F.explode(parts).alias("p")).select("p.*")
    for side in ("w1", "w2"):
        cut = cut.join(words.withColumnRenamed("w", side), side, "left_semi")
    wanted = stage(cut.select("w1", "w2"), "mergeable")
    if wanted.limit(SMALL_HASHES + 1).count() > SMALL_HASHES:
        return pairs.join(wanted, ["w1", "w2"], "left_semi").select("w1", "w2")
    hashes = wanted.select(F.xxhash64("w1", "w2").alias("h")).distinct()
    return pairs.join(F.broadcast(hashes), F.xxhash64("w1", "w2") == F.col("h"), "left_semi").select("w1", "w2")


def split_words(ones: DataFrame, twos: DataFrame) -> DataFrame:
    """(w1, w2, merged) of pairs that mostly stand as one word; pairs of words too short can go before ``twos`` is counted."""
    pairs = twos.filter((F.length("w1") > LONGER_THAN) & (F.length("w2") > LONGER_THAN)).withColumn("merged", F.concat("w1", "w2"))
    rows = pairs.join(ones.select(F.col("w").alias("merged"), F.col("n").alias("c")), "merged")
    return rows.filter((F.col("c") > 0) & (F.col("n") < F.col("c") * SPLIT_SHARE)).select("w1", "w2", "merged")


def sample_of_results(rows: DataFrame, n: int = 10, seed: int = 0) -> DataFrame:
    """``n`` rows drawn without replacement, by a hash of the row: the same ones for a seed."""
    return rows.orderBy(hash_order(*rows.columns, seed=seed + 1), *rows.columns).limit(n)


def membership(listed: DataFrame, rows: DataFrame) -> DataFrame:
    """(w1, w2, found): whether each listed pair is among the rows."""
    found = rows.select("w1", "w2", F.lit(True).alias("found")).distinct()
    return listed.join(found, ["w1", "w2"], "left").select("w1", "w2", F.coalesce("found", F.lit(False)).alias("found"))


def superbase_members(base_forms: DataFrame) -> DataFrame:
    """(base_form, component): forms that share a word, directly or through others; a component is named by its smallest form."""
    first = base_forms.groupBy("word").agg(F.min_by("base_form", F.struct("pos", "base_form")).alias("first"))
    edges = base_forms.join(first, "word").select(F.col("first").alias("a"), F.col("base_form").alias("b"))
    return connected_components(edges).select(F.col("id").alias("base_form"), "component")


def superbase_names(members: DataFrame, size: int = NAME_PART) -> DataFrame:
    """(component, part, name): the forms of a component in order, joined, stored once in parts of ``size`` forms from 0."""
    rows = numbered(members, "component", "base_form", name="n")
    lowest = rows.groupBy("component").agg(F.min("n").alias("lowest"))
    parts = rows.join(lowest, "component").withColumn("part", F.floor((F.col("n") - F.col("lowest")) / size))
    return parts.groupBy("component", "part").agg(F.array_join(F.array_sort(F.collect_list("base_form")), "|").alias("name"))


def superbase_forms(base_forms: DataFrame) -> DataFrame:
    """(base_form, superbase): each form with the whole name of its component. For display: the name is repeated for every form."""
    members = stage(superbase_members(base_forms), "members")
    whole = superbase_names(members).groupBy("component").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "name"))), lambda p: p["name"]), "|").alias("superbase"))
    return members.join(whole, "component").select("base_form", "superbase")


def known_words(base_forms: DataFrame, members: DataFrame) -> DataFrame:
    """(word, component, forms, open): each word with the component of its forms; ``open``: no form is shared by all words of the component.

    Words of other components share a form with each other, so that n-grams of one key can't differ by them.
    """
    first = base_forms.groupBy("word").agg(F.min_by("base_form", F.struct("pos", "base_form")).alias("base_form"), F.array_sort(F.collect_set("base_form")).alias("forms"))
    words = first.join(members, "base_form").select("word", "component", "forms")
    sizes = words.groupBy("component").agg(F.count("*").alias("n"))
    shared = words.select("component", F.explode("forms").alias("form")).groupBy("component", "form").agg(F.count("*").alias("n")).groupBy("component").agg(F.max("n").alias("shared"))
    return words.join(sizes.join(shared, "component").select("component", (F.col("shared") < F.col("n")).alias("open")), "component").select("word", "component", "forms", "open")


def open_pairs(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """(ngram): the distinct pairs (w1, w2), in lower case, of which a word is open; others are in no class.

    Up to ``SMALL_HASHES`` open words meet the pairs by their hashes before anything is shuffled; ``_classes`` drops what hashes let by.
    """
    words = known.filter("open").select(F.xxhash64("word").alias("h")).distinct()
    lower = pairs.select(F.lower("w1").alias("w1"), F.lower("w2").alias("w2"))
    if words.limit(SMALL_HASHES + 1).count() <= SMALL_HASHES:
        for w in ("w1", "w2"):
            lower = lower.join(F.broadcast(words.select(F.col("h").alias(f"h_{w}"))), F.xxhash64(w) == F.col(f"h_{w}"), "left")
        lower = lower.filter("h_w1 is not null or h_w2 is not null").select("w1", "w2")
    return lower.distinct().select(F.array("w1", "w2").alias("ngram"))


def form_classes(ngrams: DataFrame, base_forms: DataFrame, members: DataFrame) -> DataFrame:
    """(ngram, key, at, forms): each distinct n-gram (array) of known words in its class at each place with an open word.

    The key are the components of its words, ``forms`` the base forms of its word at the place.
    """
    return _classes(ngrams, stage(known_words(base_forms, members), "known"))


def pair_classes(pairs: DataFrame, base_forms: DataFrame, members: DataFrame) -> DataFrame:
    """``form_classes`` of the pairs (w1, w2) in lower case."""
    known = stage(known_words(base_forms, members), "known")
    return _classes(open_pairs(pairs, known), known)


def _classes(ngrams: DataFrame, known: DataFrame) -> DataFrame:
    words = ngrams.distinct().select("ngram", F.posexplode("ngram").alias("i", "word")).join(known, "word")
    rows = words.groupBy("ngram").agg(F.array_sort(F.collect_list(F.struct("i", "component", "forms", "open"))).alias("s"))
    rows = rows.filter(F.size("s") == F.size("ngram")).select("ngram", F.transform("s", lambda x: x["component"]).alias("key"), F.explode(F.filter("s", lambda x: x["open"])).alias("x"))
    return rows.select("ngram", "key", F.col("x.i").alias("at"), "x.forms")


def class_links(classes: DataFrame) -> DataFrame:
    """(key, at, forms, n, n_links): how many n-grams a class has, and with how many of its key each of them shares no form at the place.

    No pairs are made: the n-grams that share a form with a class are counted by inclusion and exclusion over
    the subsets of its forms. Classes of more than ``SUBSETS`` forms meet the classes that share one instead.
    Classes that are alone with their key at a place link with nothing and are left out.
    """
    sizes = stage(classes.groupBy("key", "at", "forms").agg(F.count("*").alias("n")), "classes")
    totals = sizes.groupBy("key", "at").agg(F.sum("n").alias("total"), F.count("*").alias("classes")).filter("classes > 1")
    sizes = stage(sizes.join(totals, ["key", "at"]).select("key", "at", "forms", "n", "total"), "classes")
    few = F.size("forms") <= SUBSETS
    bit = lambda mask, i: F.floor(mask / F.pow(F.lit(2.0), i)) % 2 == 1
    subsets = lambda c: F.transform(F.sequence(F.lit(1), F.pow(F.lit(2.0), F.size(c)).cast("int") - 1), lambda m: F.filter(c, lambda _, i: bit(m, i)))
    asked = sizes.filter(few).select("key", "at", "forms", F.explode(subsets(F.col("forms"))).alias("subset"))
    wanted = asked.select("key", "at", "subset").distinct()
    of_few = sizes.filter(few).select("key", "at", "n", F.explode(subsets(F.col("forms"))).alias("subset"))
    large = sizes.filter(~few).select("key", "at", "n", F.col("forms").alias("held"), F.explode("forms").alias("form"))
    of_large = wanted.withColumn("form", F.get("subset", F.lit(0))).join(large, ["key", "at", "form"]).filter(F.size(F.array_except("subset", "held")) == 0)
    counts = of_few.unionByName(of_large.select("key", "at", "n", "subset")).groupBy("key", "at", "subset").agg(F.sum("n").alias("n"))
    sign = F.when(F.size("subset") % 2 == 1, F.lit(1)).otherwise(F.lit(-1))
    sharing = asked.join(counts, ["key", "at", "subset"]).groupBy("key", "at", "forms").agg(F.sum(sign * F.col("n")).alias("sharing"))
    held = sizes.select("key", "at", "n", F.col("forms").alias("other"), F.explode("forms").alias("form"))
    met = large.select("key", "at", F.col("held").alias("forms"), "form").join(held, ["key", "at", "form"]).select("key", "at", "forms", "other", "n").distinct()
    sharing = sharing.union(met.groupBy("key", "at", "forms").agg(F.sum("n").alias("sharing")))
    linked = sizes.join(sharing, ["key", "at", "forms"])
    return linked.select("key", "at", "forms", "n", (F.col("total") - F.col("sharing")).alias("n_links"))


def ambiguous_links(classes: DataFrame) -> DataFrame:
    """(ngram, at, n_links): the n-grams that share no form at a place with others of their key, and with how many."""
    linked = class_links(classes).filter("n_links > 0").select("key", "at", "forms", "n_links")
    return classes.join(linked, ["key", "at", "forms"]).select(F.array_join("ngram", " ").alias("ngram"), "at", "n_links")


def ambiguous_pairs(classes: DataFrame) -> DataFrame:
    """(first, second, at): the pairs behind ``ambiguous_links``, expanded; as many rows as they are.

    Only classes with links meet, a hot key's in blocks of about ``BLOCK`` classes on one side; then
    n-grams join the pairs of their classes.
    """
    classes = stage(classes, "form-classes")
    linked = stage(class_links(classes).filter("n_links > 0").select("key", "at", "forms"), "linked")
    blocks = linked.groupBy("key", "at").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = linked.join(blocks, ["key", "at"])
    a = dealt.select("key", "at", F.pmod(F.xxhash64("forms"), F.col("blocks")).cast("int").alias("block"), F.col("forms").alias("forms_a"))
    b = dealt.select("key", "at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("forms").alias("forms_b"))
    apart = a.join(b, ["key", "at", "block"]).filter((F.col("forms_a") < F.col("forms_b")) & ~F.arrays_overlap("forms_a", "forms_b")).drop("block")
    side = lambda x: classes.select("key", "at", F.col("forms").alias(f"forms_{x}"), F.array_join("ngram", " ").alias(x))
    pairs = apart.join(side("a"), ["key", "at", "forms_a"]).join(side("b"), ["key", "at", "forms_b"])
    return pairs.select(F.least("a", "b").alias("first"), F.greatest("a", "b").alias("second"), "at")
