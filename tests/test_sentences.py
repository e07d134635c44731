import math

from pyspark.sql import functions as F

from folio.operators import sentences as S


def test_abbreviations_and_sentences(spark):
    """Worked by hand: dr and e.g come with a full stop each time, end and day mostly without."""
    said = ["We saw dr. Smith at the end of the day.", "Ask dr. Jones, e.g. today. Is it \"late\"? Yes! and so on.", "By the end all of us, e.g. me, and J. Doe met dr. Who.", "The end (of a day.) Then more words go on and on", None, " ", "Day by day the end comes"]
    texts = spark.createDataFrame(list(enumerate(said)), "id int, text string")
    found = {r.word: r for r in S.abbreviations(texts).collect()}
    assert set(found) == {"dr", "e.g", "j"}
    n = sum(len(t.split()) for t in said if t)
    p = 11 / n  # tokens with a full stop at their end, inside a bracket too
    want = 2 * (3 * math.log(0.99) - 3 * math.log(p)) * math.exp(-2) * 1
    assert abs(found["dr"].score - want) < 1e-9 and found["dr"].n == found["dr"].with_stop == 3
    got = {}
    for r in S.sentences(texts, S.abbreviations(texts)).collect():
        got.setdefault(r.id, {})[r.n] = r.sentence
    assert [got.get(i, {}).get(k) for i, k in ((1, 0), (1, 1), (1, 2), (3, 0), (3, 1))] == ["Ask dr. Jones, e.g. today.", 'Is it "late"?', "Yes! and so on.", "The end (of a day.)", "Then more words go on and on"]
    assert len(got[0]) == len(got[2]) == 1 and 4 not in got and 5 not in got


def test_sentences_are_parted_where_their_text_is(spark, monkeypatch):
    said = ["He met dr. Who. \"And then?\" (Yes!) ok. no", "a. b. C. D? x", "one", "", None, " \n", "End. Of it.\tAll", "?! Who... me. Żaba. żaba", "Ask. “Quoted” start. “lower” too."]
    texts = spark.createDataFrame(list(enumerate(said)), "id int, text string")
    known = spark.createDataFrame([("dr",), ("ok",)], "word string")
    plan = S.sentences(texts, known)
    assert "hashpartitioning(id" not in plan._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(tuple, plan.collect()))
    monkeypatch.setattr(S, "FEW", 0)  # by tokens
    assert got == sorted(map(tuple, S.sentences(texts, known).collect())) and len(got) > 12


def test_treebank_tokens(spark):
    cases = {
        'He said "stop," didn\'t he?': ["He", "said", "``", "stop", ",", "''", "did", "n't", "he", "?"],
        "They'll cost $3.88 (in U.S.A.), cannot they...": ["They", "'ll", "cost", "$", "3.88", "(", "in", "U.S.A.", ")", ",", "can", "not", "they", "..."],
        "It is Mary's -- at 5:30, I'm sure.": ["It", "is", "Mary", "'s", "--", "at", "5:30", ",", "I", "'m", "sure", "."],
        "": [],
    }
    rows = spark.createDataFrame([(k,) for k in cases], "s string").select("s", S.treebank_tokens(F.col("s")).alias("t")).collect()
    assert {r.s: r.t for r in rows} == cases
