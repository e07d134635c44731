"""Scalar text functions as column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE_SPACE = r"(?U)^\s+|\s+$"
EMPTY = "array<string>"


def no_strings() -> Column:
    return F.array().cast(EMPTY)


def positions(first: int, last: Column) -> Column:
    """first..last, empty where last is smaller (sequence would count down)."""
    return F.when(last >= first, F.sequence(F.lit(first), last)).otherwise(F.array().cast("array<int>"))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, EDGE_SPACE, "")


def space_tokens(c: Column) -> Column:
    """Single-space split; empty tokens stay, line feeds don't split."""
    return F.split(c, " ")


def n_space_tokens(c: Column) -> Column:
    """How many ``space_tokens`` there are; none of them is made."""
    return F.octet_length(c) - F.octet_length(F.replace(c, F.lit(" "), F.lit(""))) + 1


def article_tokens(title: Column, content: Column) -> Column:
    """The lower-case token stream of an article, each token stripped."""
    return F.transform(space_tokens(F.lower(F.concat_ws(" ", title, content))), strip)


def first_letters(word: Column) -> Column:
    """First run of a-z of the lower-cased word, '' if there is none before other letters end."""
    return F.regexp_extract(F.lower(word), "^[^a-z]*([a-z]*)", 1)


def clean_word(word: Column) -> Column:
    """First run of ASCII letters, null without one."""
    return F.nullif(F.regexp_extract(word, "([a-zA-Z]+)", 1), F.lit(""))


def punctuation_tokens(c: Column) -> Column:
    """White-space split, ASCII punctuation trimmed at both ends, empty tokens dropped."""
    return F.filter(F.transform(F.split(c, r"(?U)\s+"), lambda w: F.regexp_replace(w, r"^\p{Punct}+|\p{Punct}+$", "")), lambda w: w != "")


def without_punctuation(word: Column) -> Column:
    return F.regexp_replace(word, r"\p{Punct}", "")


def word_tokens(c: Column) -> Column:
    """Words, numbers and single punctuation marks: a regular approximation of a treebank tokenizer."""
    return F.regexp_extract_all(c, F.lit(r"(?U)\w+(?:['’.-]\w+)*|[^\w\s]"), F.lit(0))


def only_in_first(a: Column, b: Column) -> Column:
    """Items of ``a`` that aren't in ``b``; order and repetitions stay."""
    return F.filter(a, lambda x: ~F.array_contains(b, x))


def dotted_words(word: Column) -> Column:
    """Cleaned pieces between full stops; none if there is no full stop."""
    pieces = F.split(word, r"\.")
    return F.when(F.size(pieces) > 1, F.filter(F.transform(pieces, clean_word), lambda w: w.isNotNull())).otherwise(no_strings())


#: Letters with marks and what stands for them.
FOLDED = ("ąężźśóćłń", "aezzsucln")


def fold(word: Column) -> Column:
    return F.translate(word, *FOLDED)


def trigrams(word: Column) -> Column:
    """All windows of three characters of '$' and the lower-cased word."""
    marked = F.concat(F.lit("$"), F.lower(word))
    return F.transform(positions(1, F.length(marked) - 2), lambda i: F.substring(marked, i, F.lit(3)))


def without_parentheses(c: Column) -> Column:
    """Takes out parenthesised parts, the last pair first, as long as one is left."""

    def once(t: Column, _: Column) -> Column:
        left, right = F.regexp_extract(t, r"(?s)^(.*)\((.*)\)(.*)$", 1), F.regexp_extract(t, r"(?s)^(.*)\((.*)\)(.*)$", 3)
        return F.when(t.rlike(r"(?s)^.*\(.*\).*$"), F.concat(strip(left), F.lit(" "), strip(right))).otherwise(t)

    return strip(F.aggregate(positions(1, F.length(F.regexp_replace(c, r"[^(]", ""))), c, once))


def deletions(word: Column) -> Column:
    """The word without one character, for each of its characters."""
    return F.transform(positions(1, F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))


def splits(word: Column) -> Column:
    """Structs (left, right) of all ways to cut the word in two."""
    return F.transform(positions(1, F.length(word) - 1), lambda i: F.struct(F.substring(word, F.lit(1), i).alias("left"), F.substring(word, i + 1, F.length(word)).alias("right")))


#: Unicode categories and the names of their classes.
CLASSES = [("So", "symbol"), ("Sm", "math"), ("P", "punctuation"), ("Sc", "currency"), ("Sk", "modifier"), ("Nd", "number"), ("No", "number"), ("Cf", "format"), ("Zs", "separator"), ("Zl", "separator")]


def character_class(c: Column) -> Column:
    """Class of a character by category, else the first word of its Unicode name; null for controls."""
    script = F.split_part(F.reflect(F.lit("java.lang.Character"), F.lit("getName"), F.ascii(c)), F.lit(" "), F.lit(1))
    found = F.when(c.rlike(r"^\p{C}") | (c == ""), F.lit(None)).otherwise(script)
    for category, name in reversed(CLASSES):
        found = F.when(c.rlike(rf"^\p{{{category}}}"), F.lit(name)).otherwise(found)
    return found


# quotes


def clean_prefix(q: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(q, r"^[ \p{Punct}–]+", ""), F.lit("")), q)


def clean_numbers(q: Column) -> Column:
    return F.regexp_replace(q, r"(?U)^\d*\.[\d\s.]*", "")


def cut_at(q: Column, marker: str) -> Column:
    return F.split_part(q, F.lit(marker), F.lit(1))


def final_mark(q: Column) -> Column:
    return F.when(q.rlike(r"[?!.]\z") | (q == ""), q).otherwise(F.concat(q, F.lit(".")))


def clean_quote(q: Column) -> Column:
    return final_mark(cut_at(cut_at(clean_numbers(clean_prefix(q)), "&lt;"), "&gt;"))


def sub_quotes(q: Column) -> Column:
    parts = F.split(q, r"&lt;.*?&gt; (?=[A-Z])")
    return F.flatten(F.transform(parts, lambda p: F.split(p, r"\. (?=[A-Z])")))


def accepted(q: Column, least: int = 4) -> Column:
    return F.size(space_tokens(q)) >= least


# vectors


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    return F.transform(a, lambda x: x / norm(a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null for a zero vector."""
    size = norm(a) * norm(b)
    return F.when(size > 0, 1 - dot(a, b) / F.when(size > 0, size))
