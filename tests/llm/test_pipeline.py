from collections import Counter

import pytest

import corpus_pipeline
from loreloom.llm import decontamination, language_id, mixing, ngram_join
from loreloom.llm.oracles import ORACLES
from loreloom.llm.queries import QUERIES
from tests.oracle_compare import compare, connect

FOLDER = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").cache()
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    columns = docs.columns
    after = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, FOLDER).cache()
        assert now.columns == columns
        after[name] = now
    spoken, single, clean, mixed = (after[n] for n, _ in corpus_pipeline.STAGES[:-1])
    scores = {r.doc_id: r.score for r in language_id.identify(docs).collect()}
    assert {r.doc_id for r in spoken.collect()} == {i for i, s in scores.items() if s >= 0.3}
    parts = ngram_join.join_classes(spoken).collect()
    assert {r.doc_id for r in single.collect()} == {r.doc_id for r in parts if r.component_id == r.doc_id or not r.n_shingles}
    leaks = {r.doc_id for r in decontamination.contaminated(single, bench).collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect()} - leaks
    wanted = {r.doc_id: r.copies for r in mixing.mix(clean).collect() if r.copies}
    assert Counter(r.doc_id for r in mixed.collect()) == wanted
    result = corpus_pipeline.run(spark, FOLDER).collect()
    assert Counter(r.doc_id for r in result) == wanted
    assert {r.shard for r in result} <= set(range(40))


def test_pipeline_of_nothing(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, name):
    outcome = compare(spark, connect(FOLDER), FOLDER, name, QUERIES[name], ORACLES[name])
    assert outcome.startswith("ok"), outcome


def test_only_linked_texts_are_folded(spark):
    from tests.llm.helpers import documents

    a, b, c = (" ".join(f"{t}{i}" for i in range(40)) for t in "abc")
    rows = [(7, a), (7, b), (7, None), (7, ""), (7, a), (8, b + " end"), (3, c), (None, c), (None, "d e f g h i"), (None, "d e f g h i"), (None, None)]
    kept = corpus_pipeline.no_near_copies(spark, documents(spark, rows).repartition(3), FOLDER)
    found = Counter((r.doc_id, r.text) for r in kept.collect())
    assert found == Counter([(7, a), (7, b), (7, None), (7, ""), (3, c), (None, "d e f g h i"), (None, None)])
    assert kept.columns == documents(spark, rows).columns
