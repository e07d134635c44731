import os
import random
import subprocess
import sys

import corpus_pipeline as cp
from folio.llm import quality_classifier


def test_stages_on_a_small_corpus(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    plain = lambda n: " ".join(word() for _ in range(n))
    texts = [plain(80) for _ in range(60)]
    texts[10] = "too short"
    texts[11] = "again and again " * 40
    texts[12] = texts[3]
    texts[13] = texts[4] + " one more"
    texts[14] += " password: hunter2345"
    texts[15] = None
    texts[16] = " ".join(f"{word()}%%#$" for _ in range(60))
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i not in (10, 11, 16)), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = docs
    for name, step in cp.STAGES[:-1]:
        before, kept = {r.doc_id: r for r in kept.collect()}, step(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
        kept = spark.createDataFrame(kept.collect(), docs.schema)
        now = {r.doc_id: r for r in kept.collect()}
        gone = set(before) - set(now)
        if name == "quality rules":
            assert gone == {10, 11, 15}
        elif name == "MinHash near-dedup":
            assert gone == {12, 13}
        elif name == "secret scans":
            assert not gone and [i for i in now if now[i].text != before[i].text] == [14]
            assert now[14].text.endswith("[secret]") and now[14].n_chars == len(now[14].text)
        else:
            assert gone <= {16}
    got = cp.pack(spark, kept, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in kept.collect()}
    assert [s for s, _ in cp.STAGES] == ["quality rules", "quality classifier", "MinHash near-dedup", "secret scans", "best-fit packing"]
    assert quality_classifier.MAX_ROWS == 20_000


def test_nulls_repeats_clashing_columns_and_empty_tables(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    texts = [" ".join(word() for _ in range(90)) for _ in range(40)]
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", None if i % 3 == 0 else len(t), "k", "x") for i, t in enumerate(texts)]
    rows += [rows[7]] * 3 + [(None, texts[8], "en", "s1", 4, "k", "x"), (None, None, None, None, None, None, None), (50, "", "en", "s2", 0, "k", "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, _set string"
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    for name, some in (("full", rows), ("empty", [])):
        spark.createDataFrame(some, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    docs = cp.documents(spark, f"{tmp_path}/full")
    assert cp.keep_by_rules(spark, docs, "").count() == len(rows) - 2  # the null and the empty text go
    assert cp.keep_by_rules(spark, docs, "").columns == docs.columns
    once = cp.keep_one_of_each(spark, docs, "")
    assert once.columns == docs.columns and once.filter("doc_id = 7").count() == 4 and once.filter("doc_id is null").count() == 2  # repeated rows stay together, null ids are nobody's copies
    assert cp.redact_secrets(spark, docs, "").columns == docs.columns
    packed = cp.run(spark, f"{tmp_path}/full")
    assert {"doc_id", "piece", "start", "length", "sequence_id", "offset"} <= set(packed.columns) and packed.count() > 0
    assert cp.run(spark, f"{tmp_path}/empty").collect() == []


def test_a_stage_by_itself_takes_the_package_along(tmp_path):
    """Python workers that don't share the driver's path: the second stage is the first that needs them."""
    code = f"""
import sys
sys.path.insert(0, {os.path.dirname(cp.__file__)!r})
from pyspark.sql import SparkSession
import corpus_pipeline
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").getOrCreate()
docs = spark.createDataFrame([(i, "word " * 60 + str(i), "en", "s", 1) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
docs.write.parquet("documents.parquet")
spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int").write.parquet("labels.parquet")
assert dict(corpus_pipeline.STAGES)["quality classifier"](spark, docs, ".").count() == 20
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=env | {"PYSPARK_PYTHON": sys.executable}, check=True)
