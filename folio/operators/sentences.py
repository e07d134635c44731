"""Sentences by learnt abbreviations, and tokens by treebank rules.

Abbreviations are words that come with a full stop far oftener than words do by chance, weighed by their
length, their inner full stops and how often they come without one. Both parts follow published rules; they
don't claim to equal any library's output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.sources.staging import stage

STOP_SHARE, LEAST_SCORE = 0.99, 0.3
SMALL, FEW = 500_000, 1_000
WHITE = "[ \\t\\n\\x0b\\f\\r]+"
OPENING, CLOSING = r"^[\"'(\[{„“‘]+", r"[\"')\]}”’]+\z"
#: What treebank tokens part, in order.
RULES = [
    (r'^"', "`` "), (r'(``)', " $1 "), (r'([ (\[{<])"', "$1 `` "),
    (r"([:,])([^\d])", " $1 $2"), (r"([:,])$", " $1 "), (r"\.\.\.", " ... "), (r"[;@#$%&]", " $0 "), (r"([^.])(\.)([\])}>\"']*)\s*$", "$1 $2$3 "), (r"[?!]", " $0 "), (r"([^'])' ", "$1 ' "),
    (r"[\]\[(){}<>]", " $0 "), (r"--", " -- "), (r"^|$", " "), (r'"', " '' "),
    (r"([^' ])('[sS]|'[mM]|'[dD]|') ", "$1 $2 "), (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", "$1 $2 "),
    (r"(?i)\b(can)(not)\b", "$1 $2"), (r"(?i)\b(gim|lem)(me)\b", "$1 $2"), (r"(?i)\b(gon|wan)(na)\b", "$1 $2"), (r"(?i)\b(got)(ta)\b", "$1 $2"),
]


def _core(token: Column) -> Column:
    """A token without the quotes and brackets at its edges."""
    return F.regexp_replace(F.regexp_replace(token, OPENING, ""), CLOSING, "")


def _base(core: Column) -> Column:
    """The lower-case word of a token with or without its final full stop, null if it has other characters than letters and full stops."""
    word = F.regexp_replace(F.lower(core), r"\.\z", "")
    return F.when(word.rlike(r"^\p{L}[\p{L}.]*\z"), word)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, WHITE), lambda w: w != "")


def _tokens(texts: DataFrame, key: str) -> DataFrame:
    return texts.select(key, F.posexplode(_words(F.col("text"))).alias("ord", "token")).withColumn("core", _core(F.col("token")))


def abbreviations(texts: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """(word, n, with_stop, score) of the words of ``texts`` (text) that stand for abbreviations.

    The score is twice the logarithm of the likelihood ratio of "this word is followed by a full stop with
    probability 0.99" and "as often as any token", times exp(-letters), the full stops (the final one too),
    and letters to the power of minus the times it came without one.
    """
    tokens = texts.select(F.explode(_words(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))  # each distinct token is taken apart once
    tokens = tokens.withColumn("core", _core(F.col("token"))).select(_base(F.col("core")).alias("word"), "n", F.col("core").endswith(".").alias("stop"))
    counts = stage(tokens.groupBy("word").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("stop"), F.col("n")).otherwise(0)).alias("with_stop")), "word-counts")
    share = counts.agg((F.sum("with_stop") / F.sum("n")).alias("share"))
    a, ab, p = F.col("n"), F.col("with_stop"), F.col("share")
    ratio = 2 * (ab * F.log(F.lit(STOP_SHARE)) + (a - ab) * F.log(F.lit(1 - STOP_SHARE)) - ab * F.log(p) - (a - ab) * F.log(1 - p))
    letters = F.length(F.replace("word", F.lit("."), F.lit("")))
    score = ratio * F.exp(-letters) * (1 + F.length("word") - letters) * F.pow(letters.cast("double"), ab - a)
    scored = counts.filter("word is not null and with_stop > 0").join(F.broadcast(share)).filter("share < 1").withColumn("score", score)
    return scored.filter(F.col("score") >= least).select("word", "n", "with_stop", "score")


def sentences(texts: DataFrame, known: DataFrame, key: str = "id") -> DataFrame:
    """(key, n, sentence): the sentences of ``texts`` (key, text), numbered from 0; white space between tokens becomes one space.

    A token ending in ``.``, ``?`` or ``!`` ends a sentence unless the next one begins with a lower-case letter; one with a
    full stop neither if its word is ``known`` (word) as an abbreviation or is a single letter. Null and empty
    texts have none. With up to ``FEW`` known words texts are parted where they are; with more, tokens are dealt by
    their text, whose key must be its own.
    """
    if known.limit(FEW + 1).count() <= FEW:
        return _sentences_in_place(texts, known, key)
    words = known.select("word", F.lit(True).alias("short"))
    words = F.broadcast(words) if words.limit(SMALL + 1).count() <= SMALL else words
    rows = _tokens(texts, key).withColumn("word", F.when(F.col("core").endswith("."), _base(F.col("core")))).join(words, "word", "left")
    place = Window.partitionBy(key).orderBy("ord")
    following = F.lead("token").over(place)
    goes_on = following.isNull() | F.regexp_like(following, F.lit(r"^[\"'(\[{„“‘]*\p{Ll}"))
    stop = F.col("core").endswith(".") & ~(F.coalesce("short", F.lit(False)) | (F.length("core") == 2) & F.col("word").isNotNull())
    ends = ~goes_on & (stop | F.col("core").rlike(r"[?!]\z"))
    numbered = rows.withColumn("ends", ends.cast("int")).withColumn("n", F.coalesce(F.sum("ends").over(place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    lists = numbered.groupBy(key, "n").agg(F.array_sort(F.collect_list(F.struct("ord", "token"))).alias("tokens"))
    return lists.select(key, "n", F.array_join("tokens.token", " ").alias("sentence"))


def _sentences_in_place(texts: DataFrame, known: DataFrame, key: str) -> DataFrame:
    held = F.broadcast(known.agg(F.collect_set("word").alias("_known")))
    once = lambda value: F.when(F.monotonically_increasing_id() >= 0, value)  # noqa: E731  not copied into the expressions that use it
    rows = texts.select(key, once(_words(F.col("text"))).alias("_tokens")).crossJoin(held)

    def ends(i: Column) -> Column:
        token, following = F.get("_tokens", i), F.get("_tokens", i + 1)
        core = _core(token)
        marked = F.contains(token, F.lit(".")) | F.contains(token, F.lit("?")) | F.contains(token, F.lit("!"))  # cheaper than the patterns
        single = (F.length(core) == 2) & _base(core).isNotNull()
        stop = core.endswith(".") & ~(F.coalesce(F.array_contains("_known", _base(core)), F.lit(False)) | single)
        return marked & ~F.regexp_like(following, F.lit(r"^[\"'(\[{„“‘]*\p{Ll}")) & (stop | core.rlike(r"[?!]\z"))

    last = F.size("_tokens") - 1
    found = rows.select(key, "_tokens", once(F.concat(F.filter(T.positions(0, last - 1), ends), F.when(last >= 0, F.array(last)).otherwise(F.array().cast("array<int>")))).alias("_ends"))
    first = lambda j: F.coalesce(F.get("_ends", j - 1) + 1, F.lit(0))
    parts = F.transform("_ends", lambda e, j: F.array_join(F.slice("_tokens", first(j) + 1, e - first(j) + 1), " "))
    return found.select(key, F.posexplode(parts).alias("n", "sentence")).select(key, F.col("n").cast("long").alias("n"), "sentence")


def treebank_tokens(sentence: Column) -> Column:
    """The tokens of one sentence by treebank rules: quotes become `` and '', contractions and punctuation are parted, a final full stop too."""
    found = sentence
    for pattern, parted in RULES:
        found = F.regexp_replace(found, pattern, parted)
    return F.filter(F.split(found, " +"), lambda w: w != "")
