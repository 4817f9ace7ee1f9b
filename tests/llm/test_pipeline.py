from test_dedup_and_mix import brute_groups
from test_jaccard import brute

from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from playloom.llm import quality
from playloom.shared import materialize


def test_stages_against_brute_force(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    steps, docs = [], documents
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = materialize(stage(spark, docs, sf), f"test-{name}")
        assert docs.columns == documents.columns
        steps.append([r["doc_id"] for r in docs.select("doc_id").collect()])
    coded = corpus_pipeline.STAGES[4][1](spark, docs, sf)
    assert coded.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and coded.count() == len(steps[3])
    good = {r["doc_id"] for r in quality.annotate(documents, spark.read.parquet(f"{sf}/labels.parquet")).filter("predicted = 1").collect()}
    assert sorted(steps[0]) == sorted(good)
    texts = {i: texts[i] for i in good}
    unique = {i for i, x in brute_groups(texts).items() if x[2]}
    assert sorted(steps[1]) == sorted(unique)
    assert sorted(steps[2]) == sorted({c for _, c in brute({i: texts[i] for i in unique}).values()})
    assert set(steps[3]) <= set(steps[2]) and max(map(steps[3].count, set(steps[3]))) <= 3


def test_registered_queries():
    names = __spark_entry__.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{k}" for k in range(1, 11)}


def through(spark, docs, sf):
    steps = []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf), f"odd-{name}")
        steps.append((before, docs))
    return steps


def test_odd_rows_go_through_all_stages(spark, sf, docs, repeated):
    """Nulls, empty and long texts, repeated rows, a missing doc_id, one doc_id with two texts, columns with the names that operators use."""
    rows = docs.unionByName(repeated).unionByName(docs.filter("doc_id between 10 and 12").withColumn("text", F.reverse("text")))
    steps = through(spark, rows, sf)
    for before, after in steps[:4]:
        assert after.columns == docs.columns and after.count() <= 3 * before.count()
    texts = [r["text"] or "" for r in steps[1][1].select("text").collect()]
    assert len(texts) == len({"".join(t.split()) for t in texts})
    assert steps[4][1].count() == steps[3][1].count() > 0


def test_an_empty_table_gives_an_empty_corpus(spark, sf, no_docs):
    assert [after.count() for _, after in through(spark, no_docs, sf)] == [0] * 5
