"""Worked examples and properties of the scalar functions and of the posting-list codec."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folio.functions import postings as P
from folio.functions import text as T
from folio.operators import extraction
from folio.operators.retrieval import parse_mixed, query_words, run_rating


def one(spark, f, *values):
    row = spark.createDataFrame([values], ", ".join(f"c{k} string" for k in range(len(values))))
    return row.select(f(*[F.col(f"c{k}") for k in range(len(values))]).alias("x")).first()["x"]


def test_tokens(spark):
    assert one(spark, T.space_tokens, "a  b ") == ["a", "", "b", ""]
    assert one(spark, T.article_tokens, "Ti", "a\nB  c\n") == ["ti", "a\nb", "", "c"]
    assert one(spark, T.first_letters, "«Abc-d") == "abc" and one(spark, T.clean_word, "12aB3c") == "aB" and one(spark, T.clean_word, "12") is None
    assert one(spark, T.punctuation_tokens, "(a, b) -- c.d!") == ["a", "b", "c.d"] and one(spark, T.without_punctuation, "a.b'c") == "abc"
    assert one(spark, T.dotted_words, "ab.c1.2") == ["ab", "c"] and one(spark, T.dotted_words, "ab") == []
    assert one(spark, T.word_tokens, "It's 5, ok.") == ["It's", "5", ",", "ok", "."]


def test_words(spark):
    assert one(spark, T.fold, "żółć") == "zulc" and one(spark, T.trigrams, "kot") == ["$ko", "kot"] and one(spark, T.trigrams, "k") == []
    assert one(spark, T.without_parentheses, "Rock (a) b (c)") == "Rock b" and one(spark, T.without_parentheses, "x (y (z))") == "x (y"
    assert one(spark, T.deletions, "abc") == ["bc", "ac", "ab"] and one(spark, T.deletions, "") == []
    assert [tuple(s) for s in one(spark, T.splits, "abc")] == [("a", "bc"), ("ab", "c")] and one(spark, T.splits, "a") == []
    classes = {c: one(spark, T.character_class, c) for c in "a5+,$^ я©\t"}
    assert classes == {"a": "LATIN", "5": "number", "+": "math", ",": "punctuation", "$": "currency", "^": "modifier", " ": "separator", "я": "CYRILLIC", "©": "symbol", "\t": None}


def test_quotes(spark):
    assert one(spark, T.clean_quote, " 12. 3. Words") == "Words." and one(spark, T.clean_quote, "...") == ""
    assert one(spark, T.clean_prefix, "... ") == "... " and one(spark, T.clean_quote, "– a &gt; b") == "a ."
    assert one(spark, T.sub_quotes, "A b. C d. e &lt;i&gt; F g") == ["A b", "C d. e ", "F g"]
    assert one(spark, T.final_mark, "x") == "x." and one(spark, T.final_mark, "x?") == "x?" and one(spark, T.final_mark, "") == ""


def test_posting_lists(spark):
    row = spark.sql("SELECT array(2L, 5L, 1000L) AS ids, array(2, 3, 5) AS a, array(1, 2, 5, 8) AS b, array(1L, 6L, 306L) AS g")
    got = row.select(F.hex(P.encode(F.col("ids"))), P.decode(P.encode(F.col("ids"))), P.union(F.col("a"), F.col("b")), P.intersection(F.col("a"), F.col("b")), F.hex(P.encode(F.col("g"), 16)), P.is_ordered(F.col("a"))).first()
    assert list(got) == ["828307E3", [2, 5, 1000], [1, 2, 3, 5, 8], [2, 5], "111501021C", True]
    gamma = row.select(F.explode(P.gaps(F.col("g"))).alias("x")).agg(F.sum(2 * P.bits(F.col("x")) - 1)).first()[0]
    assert gamma == 23
    with pytest.raises(Exception, match="strictly"):
        spark.sql("SELECT array(3L, 3L) AS ids").select(P.encode(F.col("ids"))).collect()


@settings(max_examples=5, deadline=None)
@given(st.lists(st.sets(st.integers(1, 1 << 40), max_size=12), min_size=5, max_size=20), st.sampled_from([128, 16]))
def test_decoding_inverts_encoding(spark, lists, coding):
    rows = spark.createDataFrame([(sorted(x),) for x in lists], "ids array<bigint>")
    assert rows.filter(P.decode(P.encode(F.col("ids"), coding), coding) != F.col("ids")).count() == 0


def test_runs_and_queries(spark):
    flags = spark.sql("SELECT array(true, true, false, true, true, true) AS f")
    assert flags.select(run_rating(F.col("f"), 10)).first()[0] == 40
    assert query_words("to be OR to") == ["to", "be", "or"]
    assert parse_mixed('a "B c" d "e"') == [("phrase", "b c"), ("phrase", "e"), ("normal", "a d")] and parse_mixed('""') == []


def test_aliases(spark):
    assert one(spark, extraction.alias, "E", "''asd'' lub ''ced''") == "asd # ced"
    assert one(spark, extraction.alias, "E", "plain") is None
