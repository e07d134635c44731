"""Operators on small tables, readers on small files, and the entry module without its subpackage."""

import os
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folio.functions import postings, term_lists
from folio.operators import keyed_kmeans, ngrams, quotes, retrieval, spelling, stored_index, titles, vectors
from folio.plans import catalog
from folio.sources import readers

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def library(spark):
    articles = frame(spark, [(1, "Cats run", "the cat ran to a dog"), (2, "Dogs", "dog runs\nand cat"), (3, "", ""), (4, "Run run", "running cats run")], "id long, title string, content string")
    forms = frame(spark, [("cats", "cat", 0), ("cat", "cat", 1), ("ran", "run", 2), ("run", "run", 3), ("runs", "run", 4), ("dogs", "dog", 5), ("dog", "dog", 6)], "word string, base_form string, pos int")
    return articles, forms


def test_search_modes(spark, tmp_path):
    articles, forms = library(spark)
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(retrieval.search(spark, "cat run", "traditional", articles, forms)) == [1, 4]
    assert ids(retrieval.search(spark, "cat run", "positional", articles, forms)) == [1, 4]
    assert ids(retrieval.search(spark, 'dog "cat ran"', "mixed", articles, forms)) == [1]
    assert ids(retrieval.search(spark, "", "mixed", articles, forms)) == []
    assert ids(retrieval.search(spark, "cat cat", "positional", articles, forms)) == [1, 2, 4]
    index = stored_index.TextIndex.build(readers.IndexStore(spark, str(tmp_path)), articles, forms)
    assert [r.id for r in index.search("run").collect()] == [4, 1] and index.search("").collect() == []
    assert index.store.lookup("wiki_articles", "wiki_article_id", [2]).count() == 1
    clusters = frame(spark, [("cat", "7"), ("dog", "7")], "term string, cluster string")
    assert ids(retrieval.search(spark, "dog", "traditional", articles, forms, clusters)) == [1, 2, 4]
    marked = retrieval.snippets(articles, spark, "cat", forms, radius=1).collect()
    assert {(r.id, r.snippet) for r in marked} == {(1, "the [cat] ran"), (2, "runs\nand [cat]"), (4, "running [cats] run")}


def test_positions(spark):
    articles, forms = library(spark)
    starts = retrieval.document_positions(articles)
    assert [(r.start, r.n_tokens) for r in starts.orderBy("id").collect()] == [(1, 8), (10, 4), (15, 2), (18, 5)]
    asked = frame(spark, [(1,), (9,), (10,), (17,), (400_000,)], "position long")
    got = {r.position: r.id for r in retrieval.article_at(asked, starts).collect()}
    assert got == {1: 1, 9: 1, 10: 2, 17: 3, 400_000: 4}


def test_quotes_and_answers(spark):
    rows = frame(spark, [(0, "cats run fast"), (1, "a dog"), (2, "dogs run"), (3, "dogs run")], "quote_id long, text string")
    _, forms = library(spark)
    index = quotes.quote_index(rows, forms)
    said = rows.selectExpr("quote_id", "0 AS part", "text")
    scores = quotes.quote_scores("dog run", said, quotes.answer_index(said, forms), forms, spark)
    assert {r.text for r in scores.collect()} == {"cats run fast", "a dog", "dogs run"}
    assert abs(quotes.answer_probabilities(scores).groupBy().sum("probability").first()[0] - 1) < 1e-9
    past = frame(spark, [("cats run fast",), ("a dog",)], "text string")
    assert quotes.answer(scores, past) == "dogs run" and quotes.answer(scores.limit(0), default="none") == "none"
    phrases = frame(spark, [("dog",), ("dogs",), ("zzz",), ("yyy",)], "phrase string")
    assert {tuple(r) for r in quotes.phrase_members(phrases, index, forms).collect()} == {("dog", "dog", 3), ("dog", "dogs", 3), ("yyy", "yyy", 0), ("yyy", "zzz", 0)}
    classes = quotes.phrase_classes(phrases.filter("phrase <> 'yyy'"), index, forms)
    assert {(tuple(r.quote_ids), tuple(r.phrases)) for r in classes.collect()} == {((1, 2, 3), ("dog", "dogs")), ((), ("zzz",))}


def test_scores_clean_the_words_of_quotes_and_query(spark):
    """Worked by hand: 'Dogs,' is dog and '«Run!»' is run; dog stands in 2 quotes, run in 1, and 2 is the most."""
    _, forms = library(spark)
    said = frame(spark, [(0, 0, "Dogs, «Run!»"), (1, 0, "THE DOG.")], "quote_id long, part int, text string")
    got = {r.text: r.score for r in quotes.quote_scores("(Dog run?", said, quotes.answer_index(said, forms), forms, spark).collect()}
    assert abs(got["Dogs, «Run!»"] - (np.exp(-5) + np.exp(-2.5))) < 1e-12 and abs(got["THE DOG."] - np.exp(-5)) < 1e-12


def test_titles_do_not_count_for_tfidf(spark):
    articles = frame(spark, [(1, "zebra", "cat dog"), (2, "", "cat cat")], "id long, title string, content string")
    forms = frame(spark, [("cat", "cat", 0)], "word string, base_form string, pos int")
    got = {(r.id, r.term): r.weight for r in vectors.tfidf(articles, forms).collect()}
    assert got == {(1, "cat"): 0.0, (1, "dog"): 1.0, (2, "cat"): 0.0}


def test_unknown_tokens_are_in_cluster_0(spark):
    articles = frame(spark, [(1, "odd", "cat odd stranger"), (2, "cats", "dog")], "id long, title string, content string")
    forms = frame(spark, [("cat", "cat", 0), ("cats", "cat", 1), ("dog", "dog", 2)], "word string, base_form string, pos int")
    clusters = frame(spark, [("cat", "7"), ("odd", "7")], "term string, cluster string")
    rate = lambda q: {r.id: round(r.rating) for r in retrieval.rate(articles, spark, q, forms, clusters).collect()}
    # odd is unknown to the dictionary but has a cluster; stranger and dog have none, dog is known
    assert rate("cat") == {1: 30 + 5 + 1, 2: 30 + 1} and rate("unheard") == {1: 5 + 1, 2: 5 + 1}
    marked = retrieval.snippets(articles, spark, "unheard", forms, clusters, radius=0).collect()
    assert {(r.id, r.snippet) for r in marked} == {(1, "[stranger]"), (2, "[dog]")}


def test_exact_phrase(spark, tmp_path):
    articles = frame(spark, [(1, "x", "run run fast"), (2, "x", "run fast run")], "id long, title string, content string")
    forms = frame(spark, [("run", "run", 0)], "word string, base_form string, pos int")
    index = stored_index.TextIndex.build(readers.IndexStore(spark, str(tmp_path)), articles, forms)
    for exact, want in ((True, [1]), (False, [1, 2])):
        assert sorted(r.id for r in retrieval.search(spark, "run run", "positional", articles, forms, exact_phrase=exact).collect()) == want
        assert [r.id for r in index.search('"run run"', exact_phrase=exact).collect()] == want
    assert [tuple(r) for r in index.show(index.search("fast", k=1)).collect()] == [(1, "x", "run run fast")]


def test_small_accessors(spark, tmp_path):
    articles, forms = library(spark)
    store = readers.IndexStore(spark, str(tmp_path))
    assert not store.has("embeddings")
    saved = {tuple(r) for r in vectors.stored_tfidf(store, articles, forms).collect()}
    assert store.has("embeddings") and {tuple(r) for r in vectors.stored_tfidf(store, articles.limit(0), forms).collect()} == saved
    assert store.one("embeddings", "term", "dog").term == "dog"
    with pytest.raises(KeyError):
        store.one("embeddings", "term", "none")
    assert retrieval.build_index("traditional", articles, forms).columns == ["ident", "id"]
    with pytest.raises(ValueError):
        retrieval.build_index("mixed", articles, forms)
    pairs = frame(spark, [("a", "b"), ("c", "d")], "w1 string, w2 string")
    assert {tuple(r) for r in ngrams.membership(pairs, pairs.limit(1)).collect()} == {("a", "b", True), ("c", "d", False)}
    assert ngrams.sample_of_results(pairs, 1).count() == 1 and ngrams.sample_of_results(pairs, 9).count() == 2
    coded = frame(spark, [([2, 5, 1000],), ([],)], "ids array<bigint>").select(postings.last_element(postings.encode(F.col("ids"))).alias("last"))
    assert [r["last"] for r in coded.collect()] == [1000, None]


def test_posting_gaps_cross_blocks(spark):
    ids = {"a": [1, 5, 6, 17, 18, 40], "b": [33], "c": [8, 9]}
    pairs = frame(spark, [(f, i) for f, x in ids.items() for i in x], "form string, id long")
    got = retrieval.posting_gaps(pairs, wide=8).collect()
    assert sorted((r.form, r.gap) for r in got) == sorted((f, b - a) for f, x in ids.items() for a, b in zip([0, *x], x))


def test_titles(spark):
    rows = frame(spark, [(1, "Rock (band)"), (2, "Rock"), (3, "Rook"), (4, "Jazz")], "id long, title string")
    got = titles.find_title("rock", rows, spark).collect()
    assert {(r.id, r.best) for r in got} == {(1, False), (2, True)} and titles.find_title("qqq", rows, spark).collect() == []


def test_vectors(spark):
    articles, forms = library(spark)
    weights = vectors.tfidf(articles, forms)
    assert [r.id for r in vectors.similar(weights, articles, 1).collect()][-1] == 3 and weights.filter("id = 3").count() == 0
    points = frame(spark, [(f"t{i}", [float(i // 5 * 10 + i % 5), 1.0]) for i in range(20)], "term string, vec array<double>")
    clusters = vectors.kmeans(points, k=4, starts=2)
    assert clusters.select("cluster").distinct().count() == 4
    assert keyed_kmeans.hierarchical_kmeans(points, clusters, k=2).count() == 20


def test_similar_articles_from_stored_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectors, "WIDE", 4)
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, "t", " ".join(rng.choice(words[i % 3 * 12 :][:16], size=rng.integers(1, 9)))) for i in range(1, 61)] + [(61, "", ""), (62, "t", "only here")]
    articles = frame(spark, [(i, t, c) for i, t, c in rows], "id long, title string, content string")
    forms = frame(spark, [("w1", "w2", 0)], "word string, base_form string, pos int")
    store = readers.IndexStore(spark, str(tmp_path))
    vectors.store_weights(store, articles, forms)
    weights = vectors.tfidf(articles, forms)
    shape = lambda df: [(r.id, round(r.similarity, 6)) for r in df.collect()]
    for article in (1, 30, 61, 62):
        assert shape(vectors.similar_stored(store, article, articles, k=5, first=3)) == shape(vectors.similar(weights, articles, article, k=5))
    asked, lookup = [], readers.IndexStore.lookup
    monkeypatch.setattr(readers.IndexStore, "lookup", lambda self, table, key, keys: asked.append((table, sorted(keys))) or lookup(self, table, key, keys))
    vectors.similar_stored(store, 62, articles)
    assert asked == [("article_weights", [62]), ("weight_blocks", ["here", "only"])]


def test_answers_of_a_table_of_queries(spark):
    """Drawn in proportion to score ** power, never a past one; the default query's where there is none, else itself."""
    said = frame(spark, [(i, 0, t) for i, t in enumerate(["a dog runs here", "the dog ran off", "one cat sat down", "no cat at all"])], "quote_id long, part int, text string")
    _, forms = library(spark)
    index = quotes.answer_index(said, forms)
    past = frame(spark, [("no cat at all",)], "text string")
    asked = frame(spark, [(f"dog {i}",) for i in range(60)] + [("cat",), ("cat",), ("zebra",), (None,)], "query string")
    got = {r.query: r.answer for r in quotes.answers(asked, said, index, forms, past, "cat").collect()}
    assert len(got) == 62 and got["cat"] == got["zebra"] == "one cat sat down"
    assert {got[f"dog {i}"] for i in range(60)} == {"a dog runs here", "the dog ran off"}
    none = quotes.answers(frame(spark, [("zebra",)], "query string"), said, index, forms, said.select("text"), "nothing else")
    assert [tuple(r) for r in none.collect()] == [("zebra", "nothing else")]
    scores = quotes.scores_of_queries(asked, said, index, forms).filter("query = 'dog 1'").select("text", "score")
    single = quotes.quote_scores("dog 1", said, index, forms, spark)
    assert {(r.text, round(r.score, 9)) for r in scores.collect()} == {(r.text, round(r.score, 9)) for r in single.collect()}
    many = frame(spark, [(k, t, s) for k in range(2000) for t, s in (("x", 1.0), ("y", 1.1))], "draw int, text string, score double")
    share = quotes._drawn(many, "draw", 3, 10.0).filter("answer = 'y'").count() / 2000
    assert abs(share - 1.1**10 / (1 + 1.1**10)) < 0.04


def test_hierarchical_kmeans_takes_the_best_start(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.1, size=(12, 2)) for c in [(0, 0), (0, 9), (9, 0), (9, 9), (4, 4), (20, 20)]])
    points = frame(spark, [(f"t{i:02}", v.tolist()) for i, v in enumerate(x)], "term string, vec array<double>")
    parents = points.selectExpr("term", "0 as cluster")

    def cost(starts):
        got = [r.cluster for r in keyed_kmeans.hierarchical_kmeans(points, parents, k=6, starts=starts).orderBy("term").collect()]
        return sum(((x[np.array(got) == c] - x[np.array(got) == c].mean(0)) ** 2).sum() for c in set(got))

    assert cost(10) == min(cost(1), cost(10)) and cost(10) < 3


def test_keyed_kmeans_equals_lloyd_and_runs_of_one_parent(spark, monkeypatch):
    monkeypatch.setattr(keyed_kmeans, "CHUNK_BYTES", 600)  # a parent is many rows
    rng = np.random.default_rng(8)
    x, parent = rng.normal(size=(90, 3)), [k % 7 // 3 for k in range(90)]  # the first parent has most points
    points = frame(spark, [(f"t{i:02}", v.tolist()) for i, v in enumerate(x)], "term string, vec array<double>")
    parents = frame(spark, [(f"t{i:02}", p) for i, p in enumerate(parent)], "term string, cluster long")
    both = {r.term: r.cluster for r in keyed_kmeans.hierarchical_kmeans(points, parents, k=4, rounds=6, starts=3).collect()}
    alone = {r.term: r.cluster for r in keyed_kmeans.hierarchical_kmeans(points, parents.filter("cluster = 1"), k=4, rounds=6, starts=3).collect()}
    assert len(both) == 90 and alone == {t: c for t, c in both.items() if c // 4 == 1}
    chunks = keyed_kmeans.chunked(points, parents)
    assert chunks.filter("parent = 0").count() > 1
    starts = {(r.parent, r.start): np.array(r.centres).reshape(-1, 3) for r in keyed_kmeans.first_centres(chunks, 4, 3, 1).collect()}
    for p in set(parent):
        own, runs = x[[k for k in range(90) if parent[k] == p]], []
        for start in range(3):  # Lloyd over arrays
            c = starts[p, start]
            for _ in range(6):
                near = ((own[:, None] - c) ** 2).sum(2).argmin(1)
                c = np.array([own[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
            gaps = ((own[:, None] - c) ** 2).sum(2)
            runs.append((gaps.min(1).sum(), start, gaps.argmin(1).tolist()))
        assert min(runs)[2] == [both[f"t{k:02}"] % 4 for k in range(90) if parent[k] == p]


def test_kmeans_queries_have_the_survey_sizes(spark, monkeypatch):
    asked = []
    words = frame(spark, [("a", [1.0, 0.0], "0")], "term string, vec array<double>, cluster string")
    monkeypatch.setattr(catalog, "_word_vectors", lambda spark, sf: words)
    monkeypatch.setattr(vectors, "kmeans", lambda points, k, rounds, starts: asked.append((k, rounds, starts)))
    monkeypatch.setattr(keyed_kmeans, "hierarchical_kmeans", lambda points, parents, k, rounds, starts: asked.append((k, rounds, starts)))
    for name in ("kmeans_terms", "kmeans_terms_1000", "kmeans_hierarchical"):
        catalog.QUERIES[name](spark, "")
    assert asked == [(100, 10, 5), (1000, 10, 5), (100, 10, 5), (100, 50, 10)]


def test_ngrams_and_lemmas(spark):
    pairs = frame(spark, [("glass", "house")] * 3 + [("a.bcd", "x")], "w1 string, w2 string")
    ones = frame(spark, [("glasshouse", 2), ("glass", 50), ("house", 40)], "w string, n long")
    known = frame(spark, [("glass",), ("house",)], "word string")
    twos = ngrams.two_grams(pairs)
    cut = ngrams.merge_candidates(ones, ngrams.correction_words(pairs), known)
    assert [tuple(r) for r in ngrams.merged_words(ones, twos, cut).collect()] == [("glass", "house")]
    texts = frame(spark, [("glass, House! x 9 glass glass house",), ("a.bcd x y.z 7 .q 8",), (None,), ("",)], "text string")
    got = sorted(map(tuple, ngrams.cleaned_pairs(texts, 3).collect()))
    assert got == [("glass", "House"), ("glass", "glass"), ("glass", "house")] and sorted(map(tuple, ngrams.pair_counts(ngrams.only_pairs(ngrams.cleaned_pairs(texts), twos)).collect())) == [("a", "x", 1), ("glass", "house", 1)]
    assert {r.w for r in ngrams.dotted_tokens(texts).collect()} == {r.w for r in ngrams.correction_words(ngrams.word_pairs(texts)).collect()} == {"a", "bcd", "y", "z"}
    assert ngrams.split_words(frame(spark, [("glasshouse", 9)], "w string, n long"), twos).first().merged == "glasshouse"
    forms = frame(spark, [("x", "a", 0), ("x", "b", 1), ("y", "b", 2), ("y", "c", 3), ("z", "d", 4)], "word string, base_form string, pos int")
    superbase = ngrams.superbase_forms(forms)
    assert {tuple(r) for r in superbase.collect()} == {("a", "a|b|c"), ("b", "a|b|c"), ("c", "a|b|c"), ("d", "d")}
    forms = forms.union(frame(spark, [("w", "c", 5)], "word string, base_form string, pos int"))
    grams = frame(spark, [(["x", "z"],), (["w", "z"],), (["y", "z"],), (["q", "z"],)], "ngram array<string>")
    classes = ngrams.form_classes(grams, forms, ngrams.superbase_members(forms))
    assert {tuple(r) for r in ngrams.ambiguous_pairs(classes).collect()} == {("w z", "x z", 0)}
    assert {tuple(r) for r in ngrams.ambiguous_links(classes).collect()} == {("w z", 0, 1), ("x z", 0, 1)}
    assert {tuple(r) for r in ngrams.superbase_names(ngrams.superbase_members(forms), size=2).collect()} == {("a", 0, "a|b"), ("a", 1, "c"), ("d", 0, "d")}


def test_pairs_that_no_word_can_part_are_in_no_class(spark):
    forms = frame(spark, [("x", "a", 0), ("y", "a", 0), ("y", "b", 1), ("w", "b", 0), ("z", "d", 0), ("zs", "d", 0)], "word string, base_form string, pos int")
    pairs = frame(spark, [("X", "z"), ("w", "z"), ("w", "zs"), ("z", "zs"), ("z", "w"), ("q", "w"), ("w", "z")], "w1 string, w2 string")
    members = ngrams.superbase_members(forms)
    opened = ngrams.open_pairs(pairs, ngrams.known_words(forms, members))  # d is shared by z and zs
    assert sorted(tuple(r.ngram) for r in opened.collect()) == [("q", "w"), ("w", "z"), ("w", "zs"), ("x", "z"), ("z", "w")]
    classes = ngrams.pair_classes(pairs, forms, members).collect()
    assert sorted((*r.ngram, r.at, *r.forms) for r in classes) == [("w", "z", 0, "b"), ("w", "zs", 0, "b"), ("x", "z", 0, "a"), ("z", "w", 1, "b")]
    assert {tuple(r) for r in ngrams.ambiguous_links(ngrams.pair_classes(pairs, forms, members)).collect()} == {("w z", 0, 1), ("w zs", 0, 1), ("x z", 0, 2)}


def test_words_are_counted_once_for_both_levels_of_clusters(spark, monkeypatch):
    made = []
    rows = frame(spark, [("a", [3.0, 4.0])], "term string, vec array<double>")
    monkeypatch.setattr(catalog, "_word_vectors", lambda *_: made.append(1) or rows)
    monkeypatch.setattr(vectors, "kmeans", lambda points, **_: points)
    monkeypatch.setattr(keyed_kmeans, "hierarchical_kmeans", lambda points, parents, **_: (points.first().vec, parents.first().vec))
    assert catalog.kmeans_hierarchical(spark, "") == ([3.0, 4.0], [0.6, 0.8]) and len(made) == 1


def test_only_pairs_of_two_words_meet_their_joined_word(spark, monkeypatch):
    ones = frame(spark, [("glasshouse", 9), ("glass", 2), ("house", 3), ("hous", 1), ("easel", 1)], "w string, n long")
    pairs = frame(spark, [("glass", "house"), ("glas", "shouse"), ("hous", "easel"), ("glass", "house")], "w1 string, w2 string")
    for hashes in (0, ngrams.SMALL_HASHES):
        monkeypatch.setattr(ngrams, "SMALL_HASHES", hashes)
        assert [tuple(r) for r in ngrams.mergeable(pairs, ones).collect()] == [("glass", "house")] * 2


def test_links_of_classes_are_counted_without_pairs(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "SUBSETS", 3)  # larger sets of forms meet those they share a form with
    monkeypatch.setattr(ngrams, "BLOCK", 2)
    rng = np.random.default_rng(5)
    rows = [(["w%d" % i, "x"], ["k%d" % (i % 2)], 0, sorted({f"f{j}" for j in rng.integers(0, 9, size=rng.integers(1, 6))})) for i in range(60)]
    classes = frame(spark, rows, "ngram array<string>, key array<string>, at int, forms array<string>")
    pairs = {(min(a, b), max(a, b)) for a, b in ((" ".join(x[0]), " ".join(y[0])) for x in rows for y in rows if x[1] == y[1] and not set(x[3]) & set(y[3]))}
    counts = {}
    for pair in pairs:
        for name in pair:
            counts[name] = counts.get(name, 0) + 1
    assert {(r.first, r.second) for r in ngrams.ambiguous_pairs(classes).collect()} == pairs
    assert {r.ngram: r.n_links for r in ngrams.ambiguous_links(classes).collect()} == counts


def test_spelling(spark):
    words = frame(spark, [("kot",), ("żaba",), ("zaba",), ("pies",)], "word string")
    deletions = spelling.deletion_dictionary(spelling.folded_dictionary(words))
    typos = frame(spark, [("kto",), ("pis",), ("zaba",), ("pjes",), ("żabba",), ("q9",)], "word string")
    want = {"kto": "kot", "pis": "pies", "zaba": "zaba", "pjes": "pies", "żabba": "zaba"}
    full = {r.word: r.corrected for r in spelling.correct(typos, deletions, most_states=20_000).collect()}
    step = {r.word: r.corrected for r in spelling.correct_one_step(typos, deletions).collect()}
    assert want.items() <= full.items() and want.items() <= step.items() and step["q9"] is None


def queued(word, entries, most):
    """The search with a queue, straight from its definition."""
    queue, seen, best, found = [(word, 0.0)], set(), float("inf"), None
    for v, steps in queue:
        if v in entries and steps + entries[v][1] < best:
            best, found = steps + entries[v][1], entries[v][0]
        if steps >= 5 or steps >= best or len(seen) >= most:
            break
        made = [(v[:i] + v[i + 1] + v[i] + v[i + 2 :], 1) for i in range(len(v) - 1)] + [(v[:i] + v[i + 2] + v[i + 1] + v[i] + v[i + 3 :], 1) for i in range(len(v) - 2)]
        made += [(v[:i] + k + v[i + 1 :], 1.5) for i in range(len(v)) for k in spelling.NEIGHBOURS.get(v[i], "")] + [(v[:i] + v[i + 1 :], 1) for i in range(len(v))]
        for x, more in made:
            if x not in seen:
                seen.add(x)
                queue.append((x, steps + more))
    return found


def test_full_correction(spark):
    few = {"kot": ("kot", 0), "ot": ("kot", 1), "pies": ("pies", 0), "pie": ("pies", 1), "kop": ("kopa", 1), "samolot": ("samolot", 0), "smolot": ("samolot", 1), "ab": ("abc", 1), "ba": ("ba", 0)}
    deletions = frame(spark, [(v, w, c) for v, (w, c) in few.items()], "variant string, word string, cost int")
    typos = ["kto", "pjes", "pjse", "smaloto", "tpko", "q!", "kot", "", "ksot", "ksot", "eip", "peis", "aab", "zzz", None]
    for most in (60, 3_000):
        got = spelling.correct(frame(spark, [(t,) for t in typos], "word string"), deletions, most_states=most, deep=4).collect()
        want = [(t, None if t is None else queued(t, few, most)) for t in typos]
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert dict(want)["pjse"] == "pies"


def test_near_corrections_stage_no_level_of_strings(spark, monkeypatch):
    words = frame(spark, [(w,) for w in ("kot", "kto", "pies", "piesek", "żaba", "rower", "a", "torba")], "word string")
    deletions = spelling.deletion_dictionary(spelling.folded_dictionary(words))
    typos = frame(spark, [(t,) for t in ("kot", "okt", "pis", "peis", "żaab", "roewr", "", "b", "pisek", "tobra", "toraba")], "word string")
    far = frame(spark, [("rpwet",)], "word string")
    with monkeypatch.context() as m:
        m.setattr(spelling, "MOST_WAYS", 1 << 20)  # every search by levels
        want = {r.word: r.corrected for r in spelling.correct(typos, deletions, most_states=20_000).collect()}
        want_far = {r.word: r.corrected for r in spelling.correct(far, deletions, most_states=20_000).collect()}
    assert {r.word: r.corrected for r in spelling.correct(typos.union(far), deletions, most_states=20_000).collect()} == want | want_far
    for hashes in (0, spelling.SMALL_HASHES):
        with monkeypatch.context() as m:
            m.setattr(spelling, "SMALL_HASHES", hashes)
            m.setattr(spelling, "_search", None)
            near = typos.filter("word <> 'b'")  # whose only entry costs more than its modifications
            assert {r.word: r.corrected for r in spelling.correct(near, deletions).collect()} == {w: c for w, c in want.items() if w != "b"}


def test_typos_keep_the_tail_of_long_words(spark, monkeypatch):
    word = "abcd" * 40
    monkeypatch.setattr(catalog.V, "base_forms", lambda spark, sf: frame(spark, [(word,), ("kot",)], "word string"))
    assert {r.correction: r.word for r in catalog._typos(spark, "").collect()} == {word: "acbd" + word[4:], "kot": "kto"}


def test_readers(spark, tmp_path):
    def file(text):
        path = tmp_path / f"f{len(list(tmp_path.iterdir()))}.txt"
        path.write_text(text, encoding="utf-8")
        return str(path)

    got = readers.read_articles(spark, file("TITLE: A b\nline\nmore\n\nno title\n\nTITLE: C\n")).orderBy("id").collect()
    assert [(r.id, r.title, r.content) for r in got] == [(1, "A b", "line\nmore"), (2, "C", "")]
    text = "TITLE: a\nx\n\n\nTITLE: b\ny\n\nTITLE: c"
    assert [(r.id, r.title, r.content) for r in readers.read_articles(spark, file(text)).orderBy("id").collect()] == [(1, "a", "x"), (2, "b", "y"), (3, "c", "")]
    (tmp_path / "many").mkdir()
    for name in ("a.txt", "b.txt"):
        (tmp_path / "many" / name).write_text(f"TITLE: {name}\n" + "word " * 50 + "\n\nTITLE: last", encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")  # blocks lie in several splits
    try:
        got = readers.read_articles(spark, str(tmp_path / "many")).orderBy("id").collect()
        assert [(r.id, r.title, r.content) for r in got] == [(1, "a.txt", "word " * 50), (2, "last", ""), (3, "b.txt", "word " * 50), (4, "last", "")]
        assert [r.quote_id for r in readers.read_quotes(spark, file("\n".join(f"quote {k}" for k in range(60)))).orderBy("text").limit(3).collect()] == [0, 1, 10]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    long = "x" * 1_200_000
    assert readers.read_paragraphs(spark, file(f"### {long}\ny\n\n")).first().entity == long
    assert [tuple(r) for r in readers.read_base_forms(spark, file("b;w;x\nb2;w\nbad\n")).collect()] == [("w", "b", 0), ("w", "b2", 1)]
    assert [tuple(r) for r in readers.read_quotes(spark, file(" a \nb\n")).collect()] == [(0, "a"), (1, "b")]
    assert [tuple(r) for r in readers.read_ngrams(spark, file("3 a b\n1 c d\n"), 2).orderBy("w1").collect()] == [("a", "b"), ("c", "d")]
    assert [tuple(r) for r in readers.read_word_vectors(spark, file("2 2\nA 1 2\na 3 4\n")).collect()] == [("a", [3.0, 4.0])]
    assert sorted(tuple(r) for r in readers.read_paragraphs(spark, file("### One\nab\ncd\n\n### Two\nx\n\n### Cut\nlost")).collect()) == [("One", "abcd"), ("Two", "x")]
    assert [tuple(r) for r in readers.read_typos(spark, file("good godo\n")).collect()] == [("good", "godo")]
    readers.write_term_clusters(frame(spark, [("a", 3)], "term string, cluster int"), str(tmp_path / "clusters"))
    assert [tuple(r) for r in readers.read_term_clusters(spark, str(tmp_path / "clusters")).collect()] == [("a", "3")]


def test_entry_without_the_subpackage(tmp_path):
    code = "import sys; sys.modules['folio.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'search_phrase' in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_long_posting_lists_are_coded_and_read_in_arrow(spark):
    from folio.functions import posting_blocks

    lists = spark.range(1).select(F.lit("hot").alias("ident"), F.sequence(F.lit(3).cast("long"), F.lit(900_000).cast("long"), F.lit(3).cast("long")).alias("ids"))
    lists = lists.union(spark.createDataFrame([("cold", [1, 300, 70_000]), ("one", [5])], "ident string, ids array<long>"))
    coded = posting_blocks.coded_lists(lists)
    back = posting_blocks.decoded_lists(coded)
    got = {r.ident: (r.same, r.n) for r in back.select("ident", (F.col("decoded") == F.col("ids")).alias("same"), F.size("decoded").alias("n")).collect()}
    assert got == {"hot": (True, 300_000), "cold": (True, 3), "one": (True, 1)}
    assert back.filter("ident = 'cold'").select(F.hex("coded")).first()[0] == lists.filter("ident = 'cold'").select(F.hex(postings.encode(F.col("ids")))).first()[0]


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]


def test_tokens_are_made_distinct_where_their_article_is(spark):
    articles = frame(spark, [(1, "a cat", "cats ran cat"), (2, "b", "ran"), (3, None, None)], "id long, title string, content string")
    forms = frame(spark, [("cats", "cat", 0), ("cats", "cat", 1), ("ran", "run", 0)], "word string, base_form string, pos int")
    clusters = frame(spark, [("cat", "7"), ("b", "8"), ("b", "8")], "term string, cluster string")
    index = retrieval.traditional_index(articles, forms)
    assert sorted(map(tuple, index.collect())) == [("", 3), ("a", 1), ("b", 2), ("cat", 1), ("run", 1), ("run", 2)]
    assert not any("ident#" in line and " id#" in line for line in exchanges(index))  # the dictionary's own identifiers may move
    places = retrieval.positional_index(articles, forms, clusters)
    assert sorted(map(tuple, places.select("id", "position", "ident").collect())) == [(1, 1, "0"), (1, 2, "7"), (1, 3, "7"), (1, 4, "0"), (1, 5, "7"), (2, 7, "8"), (2, 8, "0"), (3, 10, "0")]
    assert not any("ident#" in line and " id#" in line for line in exchanges(places))


def test_weights_move_texts_once(spark):
    articles = frame(spark, [(1, "t", "cats ran cat"), (2, "t", "ran dog")], "id long, title string, content string")
    forms = frame(spark, [("cats", "cat", 0), ("ran", "run", 0)], "word string, base_form string, pos int")
    assert len(exchanges(vectors.tfidf(articles, forms))) == 1
    words = frame(spark, [("cat", [3.0, 4.0]), ("run", [1.0, 0.0])], "term string, vec array<double>")
    prefix = vectors.prefix_terms(articles, forms, words, frame(spark, [("dog",)], "term string"))
    assert len(exchanges(prefix)) == 1
    assert sorted(map(tuple, prefix.collect())) == [(1, 0, "cat"), (1, 1, "run"), (2, 0, "run")]
    found = {r.id: r.vec for r in vectors.article_vectors(articles, prefix, words, n=2).collect()}
    assert found[2] == [0.0, 0.0] and abs(found[1][0] - (0.6 + 2.718281828459045**-0.1) / 2) < 1e-12 and abs(found[1][1] - 0.4) < 1e-12


def test_weights_are_made_where_the_articles_are(spark, tmp_path, monkeypatch):
    """Neither tokens nor weights are shuffled, however large the dictionary; rows of one id are one article."""
    rng = np.random.default_rng(9)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["Cats", "cats", "ran", "", "odd1", "odd", "nul"]
    rows = [(None if i > 117 else 7 if i > 112 else i, "t", None if i == 5 else " ".join(rng.choice(words, size=rng.integers(1, 30)))) for i in range(120)]
    articles = frame(spark, rows, "id long, title string, content string").repartition(3)
    known = [("cats", "cat", 0), ("cats", "cats", 1), ("ran", "run", 0), ("wab", "wab", 0), ("wbb", "wba", 0), ("odd1", "odd1", 0), ("nul", None, 0), (None, "x", 0)]
    forms = frame(spark, known, "word string, base_form string, pos int")
    shape = lambda df: sorted(((-1 if r.id is None else r.id, r.term), round(r.weight, 9)) for r in df.collect())
    whole = vectors.joined_tfidf(articles, forms)
    want = shape(whole)
    monkeypatch.setattr(retrieval, "SMALL", 3)  # the dictionary is too large to be joined by a broadcast
    monkeypatch.setattr(term_lists, "BYTES", 300)
    assert shape(vectors.tfidf(articles, forms)) == want and len(exchanges(vectors.tfidf(articles, forms))) == 1
    assert {r.word for r in vectors.telling_forms(forms).collect()} == {"cats", "ran", "wbb", "odd1"}
    single = frame(spark, rows[:113], "id long, title string, content string").repartition(3)
    for k, rows in enumerate((articles, single)):
        store = readers.IndexStore(spark, f"{tmp_path}/{k}")
        monkeypatch.setattr(vectors, "WIDE", 8)
        vectors.store_weights(store, rows, forms)
        near = lambda df: [(r.id, round(r.similarity, 6)) for r in df.collect()]
        ids = rows.select("id").distinct().filter("id is not null")
        assert near(vectors.similar_stored(store, 7, ids, first=2)) == near(vectors.similar(vectors.joined_tfidf(rows, forms), ids, 7))
    assert not exchanges(store.read("weight_blocks")) and store.read("weight_blocks").select("block").distinct().count() > 5
    monkeypatch.setattr(vectors, "TERMS", 1)  # the way for vocabularies of any size
    assert shape(vectors.tfidf(articles, forms)) == want
    store = readers.IndexStore(spark, f"{tmp_path}/any")
    vectors.store_weights(store, single, forms)
    assert near(vectors.similar_stored(store, 7, single, first=2)) == near(vectors.similar(vectors.joined_tfidf(single, forms), single, 7))


def test_places_of_strings_with_one_hash(monkeypatch):
    monkeypatch.setattr(term_lists, "_hashes", lambda strings: np.array([len(s) for s in strings.to_pylist()], np.uint64))
    places = term_lists.Places(pa.array(["aa", "b", "cc", "dd"]))
    assert places.of(pa.array(["dd", "b", "c", "aa", "eeee"])).tolist() == [3, 1, -1, 0, -1]
    assert term_lists.Places(pa.array([], pa.string())).of(pa.array(["x"])).tolist() == [-1]
