from folio.operators.components import connected_components


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (9, 9), (3, 2), (7, 8), (8, 6), (None, 1)] + [(100 + k, 101 + k) for k in range(40)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 9: 9, 6: 6, 7: 6, 8: 6} | {100 + k: 100 for k in range(41)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
