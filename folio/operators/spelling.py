"""Spelling correction against a dictionary of one-character deletions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators.numbering import numbered
from folio.sources.staging import stage

#: Keys near each letter.
NEIGHBOURS = {
    "a": "qwedszxcy", "b": "vfghnmjc", "c": "zxvbsdfg", "d": "asfgwerxcv", "e": "qwrtasdf", "f": "sdghertcvbx", "g": "dfhjrtycvbn",
    "h": "fgjktyuvbnm", "i": "yuophjkl", "j": "ghklyuibnm", "k": "hjluionm", "l": "poikjhmn", "m": "nblkjhgi", "n": "vbmghjk",
    "o": "yuiphjkl", "p": "uiojklhm", "q": "asdwerfz", "r": "wetysdfg", "s": "adfqwerzxcv", "t": "eryudfgh", "u": "tyioghjk",
    "v": "xcbndfgh", "w": "qertasdf", "x": "zcvbasdf", "y": "rtuifghj", "z": "asdfxcvq",
}
SWAP, SUBSTITUTE, DELETE = 1.0, 1.5, 1.0
MOST_STEPS, MOST_STATES, DEEP = 5, 2_000_000, 1_000
MOST_WAYS = 3 + max(map(len, NEIGHBOURS.values()))  # modifications for a character, at most
SMALL_HASHES = 4_000_000


def folded_dictionary(words: DataFrame) -> DataFrame:
    """(folded, word): a word that equals its folding wins, else the first in order."""
    rows = words.select("word", T.fold(F.col("word")).alias("folded"))
    return rows.groupBy("folded").agg(F.min_by("word", F.struct((F.col("word") != F.col("folded")).alias("other"), "word")).alias("word"))


def deletion_dictionary(folded: DataFrame) -> DataFrame:
    """(variant, word, cost): folded words at cost 0, their one-character deletions at cost 1; the cheapest, then first word."""
    exact = folded.select(F.col("folded").alias("variant"), "word", F.lit(0).alias("cost"))
    cut = folded.select(F.explode(F.array_distinct(T.deletions(F.col("folded")))).alias("variant"), "word", F.lit(1).alias("cost"))
    best = exact.union(cut).groupBy("variant").agg(F.min(F.struct("cost", "word")).alias("best"))
    return best.select("variant", "best.word", "best.cost")


def modifications(word: Column) -> Column:
    """Structs (variant, cost): swaps of neighbours and over one, near keys, deletions."""
    n = F.length(word)
    at = lambda i: F.substring(word, i, F.lit(1))
    cut = lambda a, b: F.when(b >= a, F.substring(word, a, b - a + 1)).otherwise("")
    one = F.lit(1)
    weighed = lambda c, cost: F.transform(c, lambda v: F.struct(v.alias("variant"), F.lit(cost).alias("cost")))
    near = F.create_map(*[F.lit(x) for k, v in NEIGHBOURS.items() for x in (k, v)])
    swaps = F.transform(T.positions(2, n), lambda i: F.concat(cut(one, i - 2), at(i), at(i - 1), cut(i + 1, n)))
    far = F.transform(T.positions(3, n), lambda i: F.concat(cut(one, i - 3), at(i), at(i - 1), at(i - 2), cut(i + 1, n)))
    keys = lambda i: F.filter(F.split(F.coalesce(F.element_at(near, at(i)), F.lit("")), ""), lambda c: c != "")
    others = F.flatten(F.transform(T.positions(1, n), lambda i: F.transform(keys(i), lambda c: F.concat(cut(one, i - 1), c, cut(i + 1, n)))))
    return F.concat(weighed(swaps, SWAP), weighed(far, SWAP), weighed(others, SUBSTITUTE), weighed(T.deletions(word), DELETE))


def correct_one_step(words: DataFrame, deletions: DataFrame) -> DataFrame:
    """(word, corrected, cost): the cheapest dictionary word over at most one modification, by joins only."""
    rows = words.select("word", T.fold(F.col("word")).alias("folded")).distinct()
    tried = rows.select("word", F.explode(F.concat(F.array(F.struct(F.col("folded").alias("variant"), F.lit(0.0).alias("cost"))), modifications(F.col("folded")))).alias("m"))
    hits = tried.select("word", "m.variant", F.col("m.cost").alias("steps")).join(deletions.select("variant", F.col("word").alias("found"), F.col("cost").alias("more")), "variant")
    best = hits.groupBy("word").agg(F.min(F.struct((F.col("steps") + F.col("more")).alias("cost"), F.col("found").alias("corrected"))).alias("best"))
    return rows.select("word").distinct().join(best, "word", "left").select("word", "best.corrected", "best.cost")


def _pops(entries: DataFrame, frontier: DataFrame, searches: DataFrame) -> DataFrame:
    """The strings of a level as they are looked up, with ``stops``: the search may end at them.

    It ends at the first string that has taken ``MOST_STEPS``, or no less than the best found up to it. The
    best so far can only take a dozen values, so its first places are a short list for each word.
    """
    looked = stage(frontier.join(entries, "variant", "left").select("folded", "variant", "steps", "rank", "found", (F.col("steps") + F.col("more")).alias("total")), "looked-up")
    better = looked.join(searches.select("folded", "cost"), "folded").filter("total < coalesce(cost, double('inf'))")
    firsts = better.groupBy("folded", "total").agg(F.min("rank").alias("rank")).groupBy("folded").agg(F.collect_list(F.struct("total", "rank")).alias("firsts"))
    bests = searches.select("folded", "cost").join(firsts, "folded", "left")
    met = F.exists(F.coalesce("firsts", F.array().cast("array<struct<total:double,rank:bigint>>")), lambda h: (h["total"] <= F.col("steps")) & (h["rank"] <= F.col("rank")))
    ends = (F.col("steps") >= MOST_STEPS) | F.coalesce(F.col("cost") <= F.col("steps"), F.lit(False)) | met
    return looked.join(bests, "folded").withColumn("stops", ends).select(*looked.columns, "stops")


def _search(entries: DataFrame, searches: DataFrame, frontier: DataFrame, seen: list[DataFrame], most: int, deep: int, level: int = 0) -> DataFrame:
    """(folded, corrected) of searches (folded, wide, cost, found, met) that stand before a level of strings (folded, variant, steps, rank)."""
    settled = None
    while True:
        pops = stage(_pops(entries, frontier, searches), "popped")
        sums = pops.groupBy("folded").agg(F.min(F.when(F.col("stops"), F.col("rank"))).alias("stop"), F.min("rank").alias("first"), F.count("*").alias("n"))
        now = searches.join(sums, "folded")
        now = now.withColumn("stop", F.when(F.col("met") >= most, F.col("first")).otherwise(F.col("stop")))
        # a search that ends here goes on only if the limit of strings could end it before
        further = F.col("stop").isNull() | ((F.col("met") < most) & (F.col("met") + F.col("n") * F.col("wide") >= most))
        now = stage(now.withColumn("further", further), "searches")
        parents = pops.join(now.filter("further").select("folded", "stop"), "folded").filter("stop is null or rank < stop")
        tried = parents.select("folded", "steps", "rank", F.posexplode(modifications(F.col("variant"))).alias("place", "m"))
        made = tried.groupBy("folded", F.col("m.variant").alias("variant")).agg(F.min(F.struct("rank", "place", (F.col("steps") + F.col("m.cost")).alias("steps"))).alias("by"))
        for before in seen:
            made = made.join(before, ["folded", "variant"], "left_anti")
        made = made.select("folded", "variant", F.col("by.steps").alias("steps"), F.col("by.rank").alias("parent"), F.col("by.place").alias("place"))
        made = numbered(made, "folded", "parent", "place", name="rank").drop("place")  # staged there
        counts = made.groupBy("folded").agg(F.count("*").alias("new"), F.min("rank").alias("lowest"))
        full = counts.join(now.select("folded", "met"), "folded").filter(F.col("met") + F.col("new") >= most).select("folded", (F.col("lowest") + most - F.col("met") - 1).alias("rank"))
        filled = made.join(full, ["folded", "rank"]).select("folded", "parent")  # whose string fills the limit: the next one popped ends the search
        limits = pops.join(filled, "folded").filter(F.col("rank") > F.col("parent")).groupBy("folded").agg(F.min("rank").alias("limit"))
        now = now.join(counts.select("folded", "new"), "folded", "left").join(limits, "folded", "left").withColumn("stop", F.least("stop", "limit"))
        hits = pops.filter("total is not null").join(now.select("folded", "stop"), "folded").filter("stop is null or rank <= stop")
        best = hits.groupBy("folded").agg(F.min(F.struct("total", "rank", "found")).alias("hit"))
        better = F.coalesce(F.col("hit.total") < F.coalesce("cost", F.lit(float("inf"))), F.lit(False))
        now = now.join(best, "folded", "left").select(
            "folded",
            F.when(better, F.col("hit.total")).otherwise(F.col("cost")).alias("cost"),
            F.when(better, F.col("hit.found")).otherwise(F.col("found")).alias("found"),
            (F.col("met") + F.coalesce("new", F.lit(0))).alias("met"),
            "wide",
            (F.col("stop").isNotNull() | F.col("new").isNull()).alias("done"),
        )
        now = stage(now, "searched")
        ended = now.filter("done").select("folded", F.col("found").alias("corrected"))
        settled = ended if settled is None else settled.union(ended)
        searches = now.filter("not done").drop("done")
        left = searches.count()
        if not left:
            return settled
        frontier = made.join(searches.select("folded"), "folded", "left_semi").select("folded", "variant", "steps", "rank")
        seen, level = [*seen, made.select("folded", "variant")], level + 1
        if level > 1 and left > deep:
            groups = -(-left // deep)
            for k in range(groups):
                of = lambda df: df.filter(F.pmod(F.xxhash64("folded"), F.lit(groups)) == k)  # noqa: B023, E731
                settled = settled.union(_search(entries, of(searches), of(frontier), [of(s) for s in seen], most, left, level))
            return settled


def _ended_near(asked: DataFrame, entries: DataFrame, most: int) -> DataFrame:
    """(folded, corrected) of the searches that end before a second modification; no level of strings is staged for them.

    Entries cost 0 or 1. So a search with an entry for the word itself ends there, or at its first modification, which is no cheaper; any
    other ends at its first modification that has an entry of cost 0, since those of cost 1 leave more than any modification's steps.
    Words so long that the limit of strings might be met before are left to ``_search``. Up to ``SMALL_HASHES`` entries of cost 0 meet
    the modifications by their hashes before these are shuffled.
    """
    ways = F.length("folded").cast("long") * MOST_WAYS
    short = asked.filter(ways * (ways + 1) < most).select("folded")
    own = short.join(entries.select(F.col("variant").alias("folded"), F.col("found").alias("corrected")), "folded")
    tried = short.join(entries.select(F.col("variant").alias("folded")), "folded", "left_anti").select("folded", F.posexplode(modifications(F.col("folded"))).alias("place", "m")).select("folded", "place", "m.variant")
    exact = entries.filter("more = 0").select("variant", "found")
    if exact.limit(SMALL_HASHES + 1).count() <= SMALL_HASHES:
        hashes = exact.select(F.xxhash64("variant").alias("h")).distinct()
        tried = tried.join(F.broadcast(hashes), F.xxhash64("variant") == F.col("h"), "left_semi")
    first = tried.join(exact, "variant").groupBy("folded").agg(F.min_by("found", "place").alias("corrected"))
    return stage(own.select("folded", "corrected").union(first), "ended-near")


def correct(words: DataFrame, deletions: DataFrame, most_states: int = MOST_STATES, deep: int = DEEP) -> DataFrame:
    """(word, corrected): the bounded search, first in first out, of each word for a dictionary word.

    A string is looked up when its turn comes; a hit counts if its steps and the entry's cost are below
    the best so far. Then the search ends if its steps have reached ``MOST_STEPS`` or the best, or if
    ``most_states`` strings were queued; otherwise its modifications queue up in their order, each string
    once, at the cost of its first way there. The word itself isn't queued, so it may come again.

    Turns are ranks: a level's strings are numbered by their first parent's rank and the place of the
    modification, over all words together, so that a level is a few joins and no word's strings
    stand in one task. Words that two modifications don't end are searched ``deep`` at a time,
    since each may queue ``most_states`` strings. Searches that end before a second modification are found
    by two joins without any of this (``_ended_near``). Nulls and words without a hit: null.
    """
    rows = words.select("word", T.fold(F.col("word")).alias("folded"))
    entries = stage(deletions.select("variant", F.col("word").alias("found"), F.col("cost").alias("more")), "deletions")
    wide = F.size(modifications(F.col("folded")))  # no string of a search is longer
    asked = stage(rows.filter("folded is not null").select("folded").distinct().withColumn("wide", wide), "asked")
    ended = _ended_near(asked, entries, most_states)
    asked = stage(asked.join(ended, "folded", "left_anti"), "asked")
    if asked.isEmpty():
        return rows.join(ended, "folded", "left").select("word", "corrected")
    searches = asked.select("folded", "wide", F.lit(None).cast("double").alias("cost"), F.lit(None).cast("string").alias("found"), F.lit(0).cast("long").alias("met"))
    frontier = asked.select("folded", F.col("folded").alias("variant"), F.lit(0.0).alias("steps"), F.lit(0).cast("long").alias("rank"))
    return rows.join(ended.union(_search(entries, searches, frontier, [], most_states, deep)), "folded", "left").select("word", "corrected")


def accuracy(corrected: DataFrame) -> DataFrame:
    """(n, right, accuracy) of rows (correction, corrected)."""
    right = F.col("correction").eqNullSafe(F.col("corrected")).cast("long")
    return corrected.agg(F.count("*").alias("n"), F.sum(right).alias("right"), F.avg(right).alias("accuracy"))
