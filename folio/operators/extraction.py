"""Aliases and synonyms by regular expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import text as T

QUOTED = "„([a-z]+)” , „([a-z]+)”"
LATEX = "`` ([a-z]+) '' , `` ([a-z]+) ''"
#: What stands between two names of a thing.
CALLED = "('+)([^']+)('+)([^']+)zwana([^']+)('*)([^']+)('+)"
NAMED_TWICE = "('+)([^']+)('+)([^']+)nazywana([^']+)('*)([^']+)('+)"
NAMED = "nazywana([^']+)('+)([^']+)('+)"
OR = "('+)([^']+)('+) lub ('+)([^']+)('+)"
FARTHEST, SHORTEST = 0.75, 3


def alias(entity: Column, content: Column) -> Column:
    """'left # right' by the first rule that matches: called, named (twice quoted or of the entity), or."""
    both = lambda a, b: F.concat(a, F.lit(" # "), b)
    got = lambda p, g: F.regexp_extract(content, p, g)
    return (
        F.when(content.rlike(CALLED), both(got(CALLED, 2), got(CALLED, 7)))
        .when(content.rlike(NAMED_TWICE), both(got(NAMED_TWICE, 2), got(NAMED_TWICE, 7)))
        .when(content.rlike(NAMED), both(entity, got(NAMED, 3)))
        .when(content.rlike(OR), both(got(OR, 2), got(OR, 5)))
    )


def quoted_pairs(texts: DataFrame, pattern: str = QUOTED) -> DataFrame:
    """(left, right) of all matches that follow one another without overlap; both are single words."""
    pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)).alias("left"), F.regexp_extract_all("text", F.lit(pattern), F.lit(2)).alias("right"))
    rows = texts.filter(F.col("text").rlike(pattern)).select(F.explode(pairs).alias("p")).select("p.*")
    return rows.filter(~F.contains("left", F.lit(" ")) & ~F.contains("right", F.lit(" ")))


def close_base_forms(pairs: DataFrame, base_forms: DataFrame, vectors: DataFrame, farthest: float = FARTHEST) -> DataFrame:
    """(form1, form2), distinct: for each pair of longer words the first pair of base forms with near vectors.

    Forms are tried in the dictionary's order; an equal second form ends the tries for a first form.
    """
    pairs = pairs.filter((F.length("left") >= SHORTEST) & (F.length("right") >= SHORTEST)).distinct()
    side = lambda c, k: base_forms.select(F.col("word").alias(c), F.col("base_form").alias(f"form{k}"), F.col("pos").alias(f"pos{k}"))
    vec = lambda k: vectors.select(F.col("term").alias(f"form{k}"), F.col("vec").alias(f"vec{k}"))
    tried = pairs.join(side("left", 1), "left").join(side("right", 2), "right")
    ends = tried.filter("form1 = form2").groupBy("left", "right", "pos1").agg(F.min("pos2").alias("end"))
    tried = tried.join(ends, ["left", "right", "pos1"], "left").filter("end is null or pos2 < end")
    near = tried.join(vec(1), "form1").join(vec(2), "form2").filter(T.cosine_distance(F.col("vec1"), F.col("vec2")) <= farthest)
    first = near.groupBy("left", "right").agg(F.min_by(F.struct("form1", "form2"), F.struct("pos1", "pos2")).alias("f"))
    return first.select("f.*").distinct()
