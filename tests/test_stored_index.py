"""The stored index against the searches over articles."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folio.functions import posting_blocks, postings
from folio.operators import retrieval, stored_index
from folio.sources.readers import IndexStore

FORMS = [("cats", "cat", 0), ("cat", "cat", 1), ("ran", "run", 2), ("run", "run", 3), ("runs", "run", 4), ("dogs", "dog", 5), ("dog", "dog", 6), ("runs", "runner", 7), ("saw", "see", 8), ("saw", "saw", 9)]


def library(spark, n=90, seed=3):
    rng = random.Random(seed)
    words = ["cat", "cats", "ran", "run", "runs", "dog", "dogs", "saw", "odd", "the", "", "\ncat", "dog\n", "see"]
    text = lambda k: " ".join(rng.choices(words, k=k))
    rows = [(i, text(rng.randrange(0, 4)), text(rng.randrange(0, 14))) for i in range(1, n + 1)]
    rows += [(n + 60, "rare cat", "dog run run runs"), (n + 90, None, "cat run"), (n + 91, "cat run", None), (n + 92, "", "")]
    return spark.createDataFrame(rows, "id long, title string, content string"), spark.createDataFrame(FORMS, "word string, base_form string, pos int")


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    stored_index.WIDE, wide = 16, stored_index.WIDE  # many blocks, of lists from many pieces
    stored_index.AT_ONCE, at_once, stored_index.INVERTED, inverted = 50, stored_index.AT_ONCE, 70, stored_index.INVERTED
    articles, forms = library(spark)
    clusters = spark.createDataFrame([("cat", "7"), ("dog", "7"), ("odd", "3")], "term string, cluster string")
    found = {c: stored_index.TextIndex.build(IndexStore(spark, str(tmp_path_factory.mktemp("index"))), articles, forms, clusters if c else None) for c in (False, True)}
    yield articles, forms, clusters, found
    stored_index.WIDE, stored_index.AT_ONCE, stored_index.INVERTED = wide, at_once, inverted


def test_lists_are_coded_as_single_ones(spark):
    rng = np.random.default_rng(1)
    lists = [sorted({int(x) for x in rng.integers(1, 1 << int(b), size=n)}) for b, n in ((5, 9), (20, 300), (50, 40), (1, 1), (14, 1))] + [[127, 128, 255, 256 + 16384]]
    counts = np.array([len(x) for x in lists])
    coded = posting_blocks.write_lists(np.array([v for x in lists for v in x]), counts)
    want = spark.createDataFrame([(x,) for x in lists], "ids array<bigint>").select(postings.encode(F.col("ids")).alias("c")).collect()
    assert [bytes(r.c) for r in want] == coded.to_pylist()
    values, found = posting_blocks.read_lists(coded)
    assert values.tolist() == [v for x in lists for v in x] and found.tolist() == counts.tolist()
    values, found = posting_blocks.read_lists(pa.concat_arrays([pa.array([b"\x82\x83\x07\xe3\x01", b""], pa.binary()), coded]).slice(0, 2))
    assert values.tolist() == [2, 5, 1000] and found.tolist() == [3, 0]
    with pytest.raises(ValueError):
        posting_blocks.write_lists(np.array([3, 3]), np.array([2]))


@pytest.mark.parametrize("query, clustered", [("saw saw odd", False), ('dog "run cat"', False), ("cat unheard", True)])
def test_searches_and_ratings_equal_those_over_articles(spark, built, query, clustered):
    articles, forms, clusters, found = built
    clusters = clusters if clustered else None
    want = retrieval.ranked_search(spark, query, "mixed", articles, forms, clusters).collect()
    got = found[clustered].search(query).collect()
    assert [(r.id, r.title, round(r.rating, 9)) for r in got] == [(r.id, r.title, round(r.rating, 9)) for r in want]
    ids = found[clustered].matches(query)
    assert sorted(r.id for r in ids.collect()) == sorted(r.id for r in retrieval.search(spark, query, "mixed", articles, forms, clusters).collect())
    ratings = {r.id: r.rating for r in retrieval.rate(articles, spark, query, forms, clusters).collect()}
    for r in found[clustered].bounds(ids, query).collect():
        assert r.low <= ratings[r.id] + 1e-9 and ratings[r.id] <= r.high + 1e-9


def test_phrase_positions(spark, built):
    articles, forms, _, found = built
    for words in (["cat"], ["cat", "run"], ["run", "run"]):
        exact = len(set(words)) < len(words)
        want = retrieval.phrase_matches(spark, words, articles, forms).collect()
        assert sorted(map(tuple, found[False].phrase(words).collect())) == sorted(map(tuple, want)), exact


def test_lists_that_cannot_meet_are_not_decoded(spark, built, monkeypatch):
    _, _, _, found = built
    index, read = found[False], []
    decode = stored_index.decoded
    monkeypatch.setattr(stored_index, "decoded", lambda blocks, hits=False: read.append(blocks.agg(F.sum("bytes").alias("b")).first().b or 0) or decode(blocks, hits))
    sizes = {r.ident: r.b for r in index.store.read("indexed_terms").groupBy("ident").agg(F.sum("bytes").alias("b")).collect()}
    assert [r.id for r in index.boolean(["rare", "cat"]).collect()] == [150]
    assert read == [read[0]] and sizes["rare"] < read[0] < sizes["rare"] + sizes["cat"] / 3  # one block of each
    read.clear()
    assert index.boolean(["rare", "nowhere"]).collect() == [] and read == [0]
    positions = []
    places = stored_index.decoded_positions
    monkeypatch.setattr(stored_index, "decoded_positions", lambda blocks: positions.append(blocks.agg(F.sum("n_positions")).first()[0]) or places(blocks))
    index.phrase(["rare", "cat"]).collect()
    whole = index.store.read("indexed_terms").filter("ident in ('rare', 'cat')").agg(F.sum("n_positions")).first()[0]
    assert positions[-1] < whole / 3


def test_only_the_best_articles_are_read_and_bounds_rule_out_others(spark, built, monkeypatch):
    _, _, _, found = built
    asked = []
    lookup = IndexStore.lookup
    monkeypatch.setattr(IndexStore, "lookup", lambda self, table, key, keys: asked.append((table, len(keys))) or lookup(self, table, key, keys))
    index = found[False]
    got = index.search("cat run", k=3).collect()
    assert [n for table, n in asked if table == "wiki_articles"] == [3] and len(got) == 3
    assert not any(table == "word_base_forms" for table, _ in asked[1:])  # words are looked up once
    ids = index.matches("cat run")
    assert 3 <= index.rated(ids, "cat run", 3).count() < ids.count()


def test_lists_are_merged_in_runs_of_bounded_bytes(monkeypatch):
    monkeypatch.setattr(stored_index, "AT_ONCE", 100)
    parts = [[{"coded": b"x" * n, "known": True} for n in row] for row in ([30, 30], [], [20], [90], [300], [1], [1])]
    batch = pa.RecordBatch.from_arrays([pa.array([str(k) for k in range(7)]), pa.array(parts, pa.list_(pa.struct([("coded", pa.binary()), ("known", pa.bool_())])))], ["ident", "parts"])
    runs = [run.column(0).to_pylist() for run in stored_index.merged_at_once(batch.slice(1))]
    assert runs == [["1", "2"], ["3"], ["4", "5", "6"]]


def test_rows_over_the_edges_of_batches_are_grouped_once():
    rng = random.Random(4)
    rows = sorted((rng.choice("abcdefg"), rng.randrange(3)) for _ in range(90)) + [("z", 1)] * 40
    rows = [(*key, bytes([k]), k % 3 == 0) for k, key in enumerate(rows)]
    want = {}
    for ident, block, coded, known in rows:
        want.setdefault((ident, block), []).append({"coded": coded, "known": known})
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.binary(), pa.bool_()))]
    whole = pa.RecordBatch.from_arrays(columns, ["ident", "block", "coded", "known"])
    for wide in (1, 7, 1000):
        batches = [whole.slice(a, wide) for a in range(0, len(rows), wide)]
        got = [r for batch in stored_index.grouped(iter([whole.slice(0, 0), *batches])) for r in batch.to_pylist()]
        assert [(r["ident"], r["block"]) for r in got] == list(want) and [r["parts"] for r in got] == list(want.values())
    assert list(stored_index.grouped(iter([]))) == []


def test_lists_are_not_collected_before_they_are_merged(spark):
    plan = stored_index.indexed_terms(*library(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_inverted_lists_hold_each_token_as_it_is_and_stripped(spark, monkeypatch):
    rng = random.Random(9)
    words = ["cat", "cat\n", "\u3000cat", "", "\n", "dog", "\x85dog\t", "été", "\u200bcat"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(3))), " ".join(rng.choices(words, k=rng.randrange(12)))) for i in rng.sample(range(1, 300), 120)]
    S = stored_index
    want = {}
    for i, title, content in rows:
        for place, tok in enumerate(f"{title} {content}".split(" ")):
            flags = S.TITLE * (place < len(title.split(" ")))
            cut = tok.strip(S.SPACE)
            for t, f in [(tok, S.SEARCHED | S.RATED)] if cut == tok else [(tok, S.RATED), (cut, S.SEARCHED)]:
                want.setdefault((t, i // 64), []).append((i % 64 + 1 << S.ORD | place) << 4 | f | flags)
    articles = spark.createDataFrame(rows, "id long, title string, content string")
    for inverted in (20, 1 << 21):
        monkeypatch.setattr(S, "WIDE", 64)
        monkeypatch.setattr(S, "INVERTED", inverted)
        got = {}
        for r in S._inverted(articles).collect():
            got.setdefault((r.tok, r.block), []).extend(posting_blocks.read_lists(pa.array([bytes(r.coded)]))[0].tolist())
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_articles_part_at_their_first_line_feed(spark, tmp_path):
    from folio.sources import views

    texts = ["Tïtle\ncöntent\nmore", "no line", "", None, "\n", "\nx", "a\n", "日本\n語 é\n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.id: (r.title, r.content) for r in views.articles(spark, str(tmp_path)).collect()}
    assert got == {i + 1: ((t or "").partition("\n")[0], (t or "").partition("\n")[2]) for i, t in enumerate(texts)}
