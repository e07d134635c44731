"""Counts over whole texts as column expressions; no text leaves its row, so nothing is shuffled.

Words are runs of characters other than space and U+0009 to U+000D. The counts of a null text are
those of the empty text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.shared import computed_once, whole_text

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
DIGITS = "0123456789"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
STOPS = ".,;:!?"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
MORE_COUNTS = ("n_distinct_words", "n_digits", "n_capitals", "n_stops", "line_chars", "n_long_words", "n_distinct_windows", "n_chars_all")


def _without(characters: str):
    return F.length("_text") - F.length(F.translate("_text", characters, ""))


def with_counts(docs: DataFrame, more: bool = False) -> DataFrame:
    """Adds a struct column ``_counts``; with ``more`` it also holds what the classifier reads.

    A column that feeds several expressions, or one inside a lambda, gets a projection of its own:
    it is then computed once a row.
    """
    own = [c for c in docs.columns if c != "_counts"]
    # in one struct, so that no name can clash with the columns made here
    step = docs.select(F.struct(F.lit(0).alias("_none"), *[F.col(f"`{c}`") for c in own]).alias("_own"), whole_text().alias("_text"))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    step = step.select("*", F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)).alias("_words"), lines.alias("_lines"))
    window = F.transform(F.sequence(F.lit(0), F.size("_words") - 3), lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)))
    step = step.select("*", F.when(F.size("_words") >= 3, window).otherwise(F.array().cast("array<bigint>")).alias("_windows"))
    step = step.select("*", F.size(F.array_distinct("_windows")).alias("_n_windows"))
    # windows in the order of their hash; equal ones are then neighbours
    pairs = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    step = step.select("*", F.when(F.col("_n_windows") < F.size("_windows"), pairs).otherwise(none).alias("_sorted"))
    twice = F.filter("_sorted", lambda x, k: F.coalesce(F.get("_sorted", k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("_sorted", k + 1)["h"] == x["h"], F.lit(False)))
    step = step.select("*", F.sort_array(F.transform(twice, lambda x: x["i"])).alias("_starts"))
    covered = F.aggregate(F.transform("_starts", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("_starts", k + 1) - x, F.lit(3)))), F.lit(0), lambda s, x: s + x)
    counts = {
        "n_words": F.size("_words"),
        "word_chars": F.length(F.translate("_text", BLANKS, "")),
        "n_symbols": _without(SYMBOLS),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": covered,
        "n_lines": F.size("_lines"),
    }
    if more:
        counts |= {
            "n_distinct_words": F.size(F.array_distinct("_words")),
            "n_digits": _without(DIGITS),
            "n_capitals": _without(CAPITALS),
            "n_stops": _without(STOPS),
            "line_chars": F.aggregate("_lines", F.lit(0), lambda s, x: F.greatest(s, F.length(x))),
            "n_long_words": F.size(F.filter("_words", lambda w: F.length(w) > 14)),
            "n_distinct_windows": F.col("_n_windows"),
            "n_chars_all": F.length("_text"),
        }
    step = step.select("_own", computed_once(F.struct(*[c.cast("long").alias(n) for n, c in counts.items()])).alias("_counts"))
    return step.select(*[F.col(f"_own.`{c}`") for c in own], "_counts")
