import random

from folio.operators.numbering import numbered, term_numbers


def test_numbers_are_dense_and_in_order(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, 1, 1, 1, 7, rng.randrange(500)]), rng.choice("abc")) for _ in range(3000)]
    got = numbered(spark.createDataFrame(rows, "x int, y string").repartition(5), "x", "y", name="n", start=10).collect()
    assert [r.n for r in sorted(got, key=lambda r: r.n)] == list(range(10, 3010))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert [key((r.x, r.y)) for r in sorted(got, key=lambda r: r.n)] == sorted(map(key, rows))
    assert numbered(spark.createDataFrame([], "x int"), "x").collect() == []


def test_terms_are_numbered_as_first_seen(spark):
    """Worked by hand: ran has the forms run and ran in the dictionary's order, 9x is no word, Dog is looked up in lower case."""
    articles = spark.createDataFrame([(2, "t", "zebra dog ran"), (1, "zebra", "9x ran Dog cat"), (3, "", "")], "id long, title string, content string")
    forms = spark.createDataFrame([("ran", "run", 0), ("ran", "ran", 1), ("dog", "dog", 2)], "word string, base_form string, pos int")
    got = {r.term: r.number for r in term_numbers(articles, forms).collect()}
    assert got == {"run": 0, "ran": 1, "dog": 2, "cat": 3, "zebra": 4}
    assert {r.term: r.number for r in term_numbers(articles, forms, add_missing=False).collect()} == {"run": 0, "ran": 1, "dog": 2}
