import hashlib
import random
import zlib

import pytest

from folio.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, text=None):
    values = [r[0], r[3], r[2], r[4], r[1] if text is None else text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes):
    """The levels from the nodes to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def path(levels, i):
    for level in levels[:-1]:
        start = i - i % 3
        yield level[start:i], level[i + 1 : start + 3]
        i //= 3


def plain(rows):
    """The same manifest over lists."""
    of = {}
    for r in rows:
        of.setdefault(r[3], []).append(r)
    names = sorted(of, key=lambda s: (s is not None, (s or "").encode()))
    order = {s: sorted(of[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in names}
    trees = {s: tree([leaf(r) for r in order[s]]) for s in names}
    top, out = tree([trees[s][-1][0] for s in names]), []
    for k, s in enumerate(names):
        for i, r in enumerate(order[s]):
            steps = [*path(trees[s], i), *path(top, k)]
            bad = r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            own = leaf(r, r[1].replace("\n", "")) if bad else leaf(r)
            for left, right in steps:
                own = h(*left, own, *right)
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], h(*[x for a, b in steps for x in a + b]), own, own == top[-1][0]))
    return out


@pytest.mark.parametrize("block", [729, 9])
def test_equals_the_manifest_over_lists(spark, monkeypatch, block):
    if block == 9:  # several rounds
        monkeypatch.setattr(merkle, "LEVELS", 2)
        monkeypatch.setattr(merkle, "BLOCK", 9)
    rng = random.Random(4)
    sources = ["hot"] * 60 + ["b", "ä", "Z", None, ""] + [f"s{i}" for i in range(12)]
    rows = [(rng.randrange(200), rng.choice(["a\nb", "plain", "", "ż\n\n", None]), rng.choice(["en", None]), rng.choice(sources), rng.choice([3, None])) for _ in range(400)]
    rows += [(7, "same\nrow", "en", "hot", 8)] * 20 + [(None, "x\ny", None, "hot", 1), (None, None, None, None, None)]
    got = merkle.audit(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain(rows)))
    assert {r.verified for r in got} == {True, False}


def test_long_texts_few_rows_empty_tables_and_other_columns(spark):
    one = [(2, "long\n" * 300_000, "en", "s", 5)]
    for rows in (one, one + [(3, "x", "en", "t", 1)], []):
        docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS place", "1 AS total", "'y' AS node", "2 AS tree", "text AS row", "1 AS block")
        got = merkle.audit(docs)
        assert sorted(map(tuple, got.collect())) == sorted(plain(rows))
        assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
