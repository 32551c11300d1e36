"""The pipeline on a small folder of tables, stage by stage."""

import random

import pytest

import corpus_pipeline
from weftgraph.llm.queries import piece_digests


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(1)
    words = lambda n, k: " ".join(f"{k}{rng.choice('abcdefgh')}{rng.choice('klmnop')}{rng.randrange(99)}" for _ in range(n))
    plain = "".join
    text = lambda n, k: " ".join(plain(rng.choices({"en": ["th", "on", "er"], "de": ["ung", "sch", "ei"]}[k], k=rng.randint(2, 5))) for _ in range(n))
    base = text(80, "en")
    item = words(40, "q")
    rows = [(i, text(70, k), k, "s", 1) for i, k in enumerate(["en", "de"] * 20)]
    rows += [(100, base, "en", "s", 1), (101, base + " x", "en", "s", 1), (102, "12345 !!!", "en", "s", 1), (103, None, None, None, None), (104, text(20, "en") + " " + item, "en", "s", 1), (105, text(60, "en") + " " + rows[0][1], "en", "s", 1), (None, text(50, "de"), "de", "s", 1)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, n = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder).cache()
        n[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "suffix-array deduplication":
            short = {r.doc_id: r for r in docs.collect()}
            assert short[105].n_chars < 600 and short[0].n_chars == 1
    sets = list(n.values())
    assert {102, 103} & sets[0] == set() and {100, 101} <= sets[0] and None in sets[0]
    assert sets[0] - sets[1] == {101} and sets[1] == sets[2] and sets[2] - sets[3] == {104} and sets[3] == sets[4]
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == sets[4]


def test_empty_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0
    assert piece_digests(docs).count() == 0


def test_run_on_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() == 0 and got.columns == corpus_pipeline.run(spark, folder).columns
