import random
import re

import numpy as np

from folio.llm import near_duplicates as nd


def shingles(text, words):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(found) < words:
        return {tuple(found)} - {()}
    return {tuple(found[i : i + words]) for i in range(len(found) - words + 1)}


def brute(rows, words, percent=80):
    sets = [(i, shingles(t, words)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets}


def texts(rng):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    out = [None, "", "  ", "one", "One", "one two", "ONE\ttwo", "é É", "x " * 3000]
    for size, copies, edits in ((120, 60, 4), (80, 40, 9), (400, 12, 12), (30, 20, 1)):
        base = [word() for _ in range(size)]
        for _ in range(copies):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(size)] = word()
            out.append(" ".join(copy))
        out += [" ".join(base)] * 5
    shared = [word() for _ in range(60)]
    out += [" ".join(shared + [word() for _ in range(30)]) for _ in range(40)]
    rng.shuffle(out)
    return out


def test_classes_match_brute_force(spark):
    rows = list(enumerate(texts(random.Random(11))))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component string").repartition(5)
    want = brute(rows, 2)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in nd.classes(docs, words=2).collect()} == want
    kept = {r.doc_id for r in nd.keep_one_of_each(docs, words=5).select("doc_id").collect()}
    assert kept == {i for i, (_, c) in brute(rows, 5).items() if i == c}


def drifted(rng, size, copies, families=0):
    """Copies of one text with more and more words of their own; families share some of these."""
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    base, out = [word() for _ in range(size)], []
    shared = [{k: word() for k in rng.sample(range(size), size // 6)} for _ in range(families)]
    for c in range(copies):
        text = list(base)
        for k, w in (shared[c % families] if families else {}).items():
            text[k] = w
        for k in rng.sample(range(size), rng.randrange(size // 5)):
            text[k] = word()
        out.append(" ".join(text))
    return out


def test_a_hot_group_of_unlike_copies_matches_brute_force(spark):
    rng = random.Random(23)
    rows = list(enumerate(drifted(rng, 90, 260) + drifted(rng, 70, 160, families=8) + [" ".join(f"u{k}-{j}" for j in range(60)) for k in range(30)]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for words in (2, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.classes(docs, words=words).collect()}
        assert got == brute(rows, words)


def test_prefixes_miss_no_alike_pair(spark):
    rng = random.Random(31)
    rows = list(enumerate(drifted(rng, 60, 120) + drifted(rng, 40, 60, families=4)))
    sets = nd.shingle_sets(spark.createDataFrame(rows, "doc_id long, text string"), 2)
    keys = nd.prefixes(sets, 80).selectExpr("*", "true AS probes", "id AS component")
    met = {(r.a, r.b) for r in nd.meeting(keys, 80).collect()}
    full = [shingles(t, 2) for _, t in rows]
    alike = {(a, b) for b in range(len(full)) for a in range(b) if 100 * len(full[a] & full[b]) >= 80 * len(full[a] | full[b])}
    assert alike <= met and len(alike) > 100


def test_chains_nulls_repeats_and_empty(spark):
    rng = random.Random(5)
    words = [f"w{rng.random()}" for _ in range(130)]
    rows = [(10 + k, " ".join(words[3 * k : 3 * k + 70])) for k in range(20)]  # neighbours are alike, the ends are not
    rows += [(None, rows[0][1]), (None, None), (7, "same"), (7, "same"), (8, "other text"), (8, rows[3][1])]
    got = nd.classes(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()
    assert len(got) == len(rows)
    assert {r.component_id for r in got if r.doc_id is not None and (r.doc_id >= 10 or r.doc_id == 8)} == {8}
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    assert [(r.component_id, r.kept) for r in got if r.doc_id == 7] == [(7, True)] * 2
    assert nd.classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_bayesian_bounds():
    least = nd.least_matches(0.8)
    assert len(least) == nd.BANDS * nd.ROWS // nd.BATCH and all(0 < m < (k + 1) * nd.BATCH * 0.8 for k, m in enumerate(least))
    rng = np.random.default_rng(2)
    t, lost, tries = 0.8 + 0.2 / 256, 0, 20_000
    hits = rng.random((tries, nd.BANDS * nd.ROWS)) < t
    for k, m in enumerate(least):
        lost += (hits[:, : (k + 1) * nd.BATCH].sum(1) < m).sum()
    assert lost == 0
