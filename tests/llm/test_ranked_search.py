import math
import random
import re

import numpy as np
import pytest

from folio.llm import ranked_search as rs

DOCS, ITEMS = "doc_id long, text string, score long", "item_id long, text string, rank int"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    """Every document scored for every item."""
    held = [(d, words(t)) for d, t, *_ in docs if d is not None]
    n_docs, n_terms = sum(bool(w) for _, w in held), sum(len(w) for _, w in held)
    out = []
    for item, text in {(i, t or "") for i, t, *_ in items if i is not None}:
        asked = words(text)
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in w for _, w in held) + 1))) for t in set(asked)}
        scored = []
        for d, w in held:
            m = 25 + (75 * len(w) * n_docs) // max(n_terms, 1)
            score = sum(weight[t] * (10**9 * w.count(t) // (1000 * w.count(t) + 8 * m)) for t in asked)
            scored += [(-score, d)] if score > 0 else []
        out += [(item, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def ranked(spark, docs, items):
    return sorted(map(tuple, rs.rank_documents(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()))


@pytest.mark.parametrize("small", [False, True])
def test_equals_scoring_every_document(spark, monkeypatch, small):
    if small:  # many shards, blocks and blocks of items
        for name, value in (("SHARD_POSTINGS", 150), ("SHARD_DOCS", 40), ("CELL", 2), ("WIDEST", 4), ("ITEM_TERMS", 30), ("BLOCK_COST", 1e5)):
            monkeypatch.setattr(rs, name, value)
    rng = random.Random(5)
    names = [f"w{i}" for i in range(60)] + ["żółć", "Ärger", "ABC", "x1"]
    some = lambda n: " ".join(rng.choices(names, weights=[1 / (i + 1) for i in range(len(names))], k=n))
    docs = [(i, some(rng.randrange(1, 80)), 1) for i in range(260)]
    docs += [(i, "w1 w2 w50 the same", 1) for i in range(300, 340)] + [(345, "w1 w2 w50 the same", 1)] * 12  # ties and repeats
    docs += [(400, None, 1), (401, "", 1), (402, "... --", 1), (None, "w1 w50", 1), (403, "w3 " * 20_000 + "w59", 1)]
    items = [(i, some(rng.randrange(1, 12)), 0) for i in range(15)] + [(20, "w50, W50; w1!", 0), (21, None, 0), (22, "nowhere", 0), (None, "w1", 0), (23, "w59 w59 Żółć", 0), (23, "w59 w59 Żółć", 0)]
    assert ranked(spark, docs, items) == plain(docs, items)


def test_empty_tables(spark):
    assert ranked(spark, [], [(1, "a", 0)]) == [] and ranked(spark, [(1, "a", 0)], []) == []
    assert ranked(spark, [(1, "a", 0)], [(1, "a", 0)]) == plain([(1, "a")], [(1, "a")])


def test_blocks_cost_least():
    """Against all ways to cut a list into blocks."""
    rng = np.random.default_rng(3)
    lists = [rng.integers(1, 1000, size=n).astype(float) for n in (9, 7, 4, 1)]
    weights, widest = np.array([20_000, 9_000, 50_000, 1_000]), rs.WIDEST
    maxima, sizes = np.zeros((4, 9)), np.zeros((4, 9))
    for i, x in enumerate(lists):
        maxima[i, : len(x)], sizes[i, : len(x)] = x, rs.CELL
    sizes[0, 8] = 3

    def cost(i, ends):
        return sum(sizes[i, a:b].sum() * maxima[i, a:b].max() * weights[i] + rs.BLOCK_COST for a, b in zip([0, *ends], ends))

    for i, ends in enumerate(rs.block_ends(maxima, sizes, np.array([len(x) for x in lists]), weights)):
        n = len(lists[i])
        ways = [[j for j in range(1, n) if cut >> (j - 1) & 1] + [n] for cut in range(1 << (n - 1))]
        assert ends[-1] == n <= widest and abs(cost(i, ends.tolist()) - min(cost(i, w) for w in ways)) < 1e-3
