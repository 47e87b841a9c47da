import math

import pytest
from pyspark.sql import functions as F

from sightline.llm import mixing


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "w " * (1 + i % 7), "big" if i % 10 < 7 else "mid" if i % 10 < 9 else "small") for i in range(2_000)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def handed_out(docs, target):
    return mixing.mix(docs.withColumn("n", mixing.word_count(F.col("text"))), target)


def test_repetition_limit_with_every_document(docs):
    target = mixing.Target(repetition=3.0, block_tokens=100)
    plan = {r["mix_source"]: r for r in mixing.plan(docs, target).collect()}
    passes = {s: r["quota"] / r["tokens"] for s, r in plan.items()}
    assert passes["big"] == pytest.approx(1, abs=1e-3) and passes["small"] == pytest.approx(3, rel=1e-2)
    out = handed_out(docs, target)
    assert out.select("doc_id").distinct().count() == docs.count()
    for r in out.groupBy("source").agg(F.sum("n").alias("n")).collect():
        assert plan[r["source"]]["quota"] <= r["n"] < plan[r["source"]]["quota"] + 7
    assert out.groupBy("doc_id", "epoch").count().where("count > 1").count() == 0


def test_target_entropy_and_budget(docs):
    for entropy in (0.9, 1.0, math.log(3)):
        target = mixing.Target(entropy=entropy, budget=5_000, block_tokens=100)
        weights = [r["weight"] for r in mixing.plan(docs, target).collect()]
        assert sum(weights) == pytest.approx(1)
        assert -sum(w * math.log(w) for w in weights) == pytest.approx(entropy, abs=1e-4)
        total = handed_out(docs, target).agg(F.sum("n")).first()[0]
        assert 5_000 - 3 <= total <= 5_000 + 3 * 7


def test_passes_are_different_permutations_of_blocks(docs):
    out = handed_out(docs, mixing.Target(repetition=4.0, block_tokens=50)).where("source = 'small'")
    order = lambda e: [r["block"] for r in out.where(F.col("epoch") == e).select("block", "block_key").distinct().orderBy("block_key").collect()]
    first, second = order(0), order(1)
    assert sorted(first) == sorted(second) and first != second


def test_many_sources_are_weighed_by_jobs(docs, monkeypatch):
    target = mixing.Target(entropy=1.0, budget=4_000)
    want = mixing.plan(docs, target).select("mix_source", "quota").collect()
    monkeypatch.setattr(mixing, "DRIVER_SOURCES", 1)
    monkeypatch.setattr(mixing, "BISECTIONS", 12)
    got = {r["mix_source"]: r["quota"] for r in mixing.plan(docs, target).select("mix_source", "quota").collect()}
    assert all(abs(got[r["mix_source"]] - r["quota"]) <= 5 for r in want)


def test_odd_documents(odd_documents, no_documents, spark):
    target = mixing.Target(repetition=2.0)
    out = mixing.mix(odd_documents, target)
    assert set(odd_documents.columns) <= set(out.columns)
    assert out.select("doc_id").distinct().count() == odd_documents.select("doc_id").distinct().count()
    assert out.where("epoch = 0").count() == odd_documents.count()
    assert mixing.mix(no_documents, target).count() == 0
    empty = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert mixing.mix(empty, target).count() == 2
    with pytest.raises(ValueError):
        mixing.Target()


def test_clashing_columns_stay(spark, odd_documents):
    names = ("n_blocks", "full_epochs", "cut_key", "cut_doc", "epoch", "block", "mix_source", "doc_key", "row", "a.b")
    docs = odd_documents
    for name in names:
        docs = docs.withColumn(name, F.lit("own"))
    out = mixing.repeat(docs, mixing.Target(repetition=2.0))
    assert out.columns == docs.columns and out.count() >= docs.count()
    assert all(r[name] == "own" for r in out.collect() for name in names)
