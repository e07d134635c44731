import numpy as np
import pytest

from folio.llm import vector_duplicates as vd


def plain(rows, cosine=0.9):
    """All pairs."""
    fine = [k for k, (i, v, *_) in enumerate(rows) if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    low, links = {k: rows[k][0] for k in range(len(rows))}, {k: set() for k in range(len(rows))}
    for wide in {len(rows[k][1]) for k in fine}:
        some = [k for k in fine if len(rows[k][1]) == wide]
        x = np.array([rows[k][1] for k in some], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(x @ x.T >= cosine)):
            if a != b:
                links[some[a]].add(some[b])
    changed = True
    while changed:
        changed = False
        for k, others in links.items():
            least = min([low[k], *(low[o] for o in others)]) if others else low[k]
            if least != low[k]:
                low[k], changed = least, True
    return sorted(str((rows[k][0], len(links[k]), low[k], low[k] is None or low[k] == rows[k][0])) for k in low)


def found(spark, rows):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component_id string")
    return sorted(str(tuple(r)) for r in vd.classes(table).collect())


def near(rng, v, cosine):
    aside = rng.normal(size=len(v))
    own = v / np.linalg.norm(v)
    aside -= (aside @ own) * own
    return cosine * own + np.sqrt(1 - cosine**2) * aside / np.linalg.norm(aside)


def test_all_links_of_copies_near_copies_and_chains(spark):
    rng = np.random.default_rng(7)
    x = list(rng.normal(size=(1500, 24)))
    x += [near(rng, x[k], c) for k in range(120) for c in (0.905, 0.95, 0.99)]
    x += [x[0]] * 150 + [3.0 * x[1]] * 5  # exact copies, scaled copies
    x += [near(rng, x[2], 0.97) for _ in range(250)]  # one large group, all alike
    chain = [x[3]]
    for _ in range(12):
        chain.append(near(rng, chain[-1], 0.92))
    rows = [(int(i), v.tolist(), "x") for i, v in zip(rng.permutation(len(x) + 12), x + chain[1:])]
    assert found(spark, rows) == plain(rows)


def test_odd_vectors_lengths_repeats_and_empty_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, ""), (2, [0.0, 0.0], ""), (3, [1.0, None], ""), (4, [nan, 1.0], ""), (5, [inf, 1.0], ""), (None, [1.0, 1.0], ""), (6, [], "")]
    rows += [(8, [1.0, 2.0], None), (7, [1.0, 2.0], None), (7, [1.0, 2.0], None), (9, [2.0, 1.0], ""), (10, [1.0, 2.0, 0.0], ""), (11, [2.0, 1.0], ""), (12, [1e-200, 2e-200], ""), (13, [5.0], ""), (14, [-5.0], ""), (7, [0.0, 1.0], "")]
    scaled = [(i, [1.0, 2.0] if i == 12 else v, s) for i, v, s in rows]  # plain() doesn't guard against underflow
    assert found(spark, rows) == plain(scaled)
    assert found(spark, rows[:2]) == plain(rows[:2]) and found(spark, []) == []


@pytest.mark.parametrize("n", [1, 2, 70, 3000])
def test_graphs_find_what_is_turned_by_the_threshold(n):
    rng = np.random.default_rng(n)
    x = vd._unit(rng.normal(size=(n, 64))).astype(np.float32)
    graph = vd.build_graph(x)
    beam = vd.audited_beam(graph, 0.9)
    q = np.array([near(rng, v, 0.905) for v in x[:500].astype(float)], np.float32)
    a, b = vd.find_links(graph, q, beam, 0.9)
    assert (a == b).sum() >= 0.99 * min(n, 500)
    for k, links in enumerate(graph.links):
        assert links.max(initial=-1) < len(links) and not (links == np.arange(len(links))[:, None]).any(), k
