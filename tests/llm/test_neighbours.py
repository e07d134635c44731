import numpy as np
from pyspark.sql import functions as F

from folio.llm import neighbours as nn


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")


def brute(ids, x, q, k):
    d = np.sqrt(((x - x[ids.index(q)]) ** 2).sum(1))
    order = sorted((float(d[i]), ids[i]) for i in range(len(ids)) if ids[i] != q)
    return order[:k]


def test_recall_scores_and_ties(spark, monkeypatch):
    monkeypatch.setattr(nn, "LEAF_ROWS", 40)
    monkeypatch.setattr(nn, "CELL_ROWS", 64)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 16))
    x = (centres[rng.integers(30, size=2500)] + 0.4 * rng.normal(size=(2500, 16))).astype(np.float32)
    x[500:900] = x[500]  # one vector many times
    docs = table(spark, [(i, v.tolist(), "x") for i, v in enumerate(x)])
    got = {}
    for r in nn.nearest(docs, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.score, r.vec_id)
    ids, xs, hits = list(range(len(x))), x.astype(float), 0
    assert sorted(got) == list(range(0, 2500, 50))
    for q, found in got.items():
        want = brute(ids, xs, q, 10)
        assert sorted(found) == list(range(1, 11)) and list(found.values()) and [found[k] for k in range(1, 11)] == sorted(found.values())
        hits += len({v for _, v in want} & {v for _, v in found.values()})
        for s, v in found.values():
            assert abs(s - np.sqrt(((xs[v] - xs[q]) ** 2).sum())) < 1e-12
        if 500 <= q < 900:
            assert [found[k] for k in range(1, 11)] == want
    assert hits >= 0.9 * 10 * len(got)


def test_odd_vectors_small_and_empty_tables(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(0, None, ""), (100, [0.0, 0.0], ""), (200, [1.0, None], ""), (300, [nan, 1.0], ""), (400, [inf, 1.0], ""), (None, [1.0, 1.0], ""), (600, [1.0, 2.0, 3.0, 4.0], "")]
    fine = [(500, [1.0, 0.0], None), (501, [1.0, 0.0], None), (502, [0.0, 1.0], None), (502, [0.0, 1.0], None)]
    got = nn.nearest(table(spark, fine), F.col("vec_id") % 100 == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == [(500, 1, 501), (500, 2, 502), (500, 3, 502)]
    more = nn.nearest(table(spark, fine + odd[:-1]), F.col("vec_id") % 100 == 0).collect()
    assert sorted(map(tuple, more)) == sorted(map(tuple, got))
    assert nn.nearest(table(spark, odd[:-1]), F.col("vec_id") % 100 == 0).collect() == []
    assert nn.nearest(table(spark, fine).limit(0), F.col("vec_id") % 100 == 0).collect() == []


def test_an_odd_dimension_with_the_lowest_hash_loses_no_others(spark):
    fine = [(i, [1.0, float(i)], None) for i in range(500, 504)]
    ids = spark.range(10_000).filter("id < 500 or id > 503").orderBy(F.xxhash64("id"), "id").limit(1).collect()
    odd = [(ids[0].id, [1.0, 2.0, 3.0, 4.0], "")]
    got = [nn.nearest(table(spark, rows), F.col("vec_id") % 100 == 0).collect() for rows in (fine, fine + odd)]
    assert len(got[0]) == 3 and sorted(map(tuple, got[0])) == sorted(map(tuple, got[1]))


def test_many_split_leaves_and_mixed_dimensions(spark, monkeypatch):
    rng = np.random.default_rng(12)
    x = np.repeat(rng.normal(size=(2100, 4)), 3, axis=0)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(10_000, [1.0, 2.0])]
    monkeypatch.setattr(nn, "CELL_ROWS", 2)
    monkeypatch.setattr(nn, "LEAF_ROWS", 3)
    got = nn.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 700 == 0, k=2).collect()
    assert len(got) == 2 * 9 and all(r.score == 0 and r.vec_id // 3 == r.query_id // 3 for r in got)


def test_visits_are_listed_in_bounded_batches(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(600)], "vec_id long, embedding array<double>")
    want = sorted(map(tuple, nn.nearest(rows, F.col("vec_id") % 10 == 0).collect()))
    monkeypatch.setattr(nn, "VISITS", 7)
    monkeypatch.setattr(nn, "ASKING", 16)
    assert sorted(map(tuple, nn.nearest(rows, F.col("vec_id") % 10 == 0).collect())) == want
