from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sightline.llm.mixing import document_sizes, mix, mixed_documents, source_targets, word_count


def water(sizes, weights, times=3):
    """Resharing round by round, as told."""
    total, caps = sum(sizes), [times * s for s in sizes]
    full, left = set(), float(total)
    while True:
        w = sum(x for i, x in enumerate(weights) if i not in full)
        share = [caps[i] if i in full else left * x / w for i, x in enumerate(weights)]
        over = {i for i in range(len(sizes)) if i not in full and share[i] > caps[i]}
        if not over:
            return share
        full |= over
        left = total - sum(caps[i] for i in full)


@pytest.fixture
def docs(spark):
    rows = [(i, ("w " * (i % 37 + 1)) if i % 11 else None, [None, "b", "a", "Z", "é"][0 if i % 50 == 0 else 1 if i % 3 else 2 + i % 3 % 2 + (i % 7 == 0)]) for i in range(900)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").union(spark.createDataFrame([(5000, "one two", "tiny"), (5001, None, "zero"), (5000, "one two", "tiny")], "doc_id long, text string, source string"))


def test_targets_and_cut(spark, docs):
    sizes = document_sizes(docs).cache()
    got = mix(sizes, per_range=50).collect()
    assert len(got) == docs.count()
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    order = sorted((s for s in by if s is not None)) + [None]
    want = water([sum(r.size for r in by[s]) for s in order], [1 + i % 3 for i in range(len(order))])
    for s, t in zip(order, want):
        assert abs(by[s][0].target - t) < 1e-6 * max(1, t)
        assert abs(sum(r.taken for r in by[s]) - t) < 1 + 1e-6 * t
        assert all(0 <= r.taken <= 3 * r.size for r in by[s])
    again = {(r.doc_id, r.taken) for r in mix(sizes.repartition(7), per_range=7).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}
    salted = {(r.doc_id, r.taken) for r in mix(sizes, per_range=50, max_sources_shipped=1).collect()}
    assert salted == again


def test_whole_documents(spark, docs):
    out = mixed_documents(docs.withColumn("size", F.lit("clash")).withColumn("taken", F.lit(1)))
    per = {r.source: (r.n, r.m) for r in out.groupBy("source").agg(F.sum(word_count("text")).alias("n"), F.max(word_count("text")).alias("m")).collect()}
    goals = {r.source: r.target for r in source_targets(document_sizes(docs)).collect()}
    for s, t in goals.items():
        assert abs(per.get(s, (0, 0))[0] - t) <= 3 * 37
    assert out.groupBy("doc_id").count().where("count > 6").count() == 0


def test_empty_and_zero(spark, docs):
    assert mix(document_sizes(docs.limit(0))).count() == 0
    zero = mix(document_sizes(docs.where("text is null")))
    assert {(r.target, r.taken) for r in zero.collect()} == {(0.0, 0)}
    assert mixed_documents(docs.limit(0)).count() == 0


def test_very_long_texts_and_a_hot_source(spark):
    """One source holds nearly all rows, one document nearly all words of another; ranges don't change the result."""
    rows = [(i, "w " * (i % 5 + 1), "hot") for i in range(3000)] + [(9000, "word " * 300_000, "long"), (9001, "a b", "long"), (9002, "x", None)]
    sizes = document_sizes(spark.createDataFrame(rows, "doc_id long, text string, source string")).cache()
    got = {r.doc_id: (r.size, r.taken, r.target) for r in mix(sizes).collect()}
    assert got == {r.doc_id: (r.size, r.taken, r.target) for r in mix(sizes, per_range=37).collect()}
    assert got[9000][0] == 300_000 and all(0 <= t <= 3 * n for n, t, _ in got.values())


def test_columns_of_any_name(spark, docs):
    names = ("_n", "_copy", "_id", "_source", "_size", "_key", "_range", "_c0", "_doc", "_taken")
    own = docs.select("doc_id", "source", "text", *(F.lit(99).alias(c) for c in names))
    out = mixed_documents(own)
    assert out.columns == own.columns and all({r[c] for r in out.collect()} == {99} for c in names)
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in mixed_documents(docs.select("doc_id", "source", "text")).collect())
    sizes = document_sizes(docs).select("doc_id", *(F.lit(99).alias(c) for c in names), "source", "size")
    got = mix(sizes)
    assert got.columns == [*sizes.columns, "source_size", "target", "taken"] and all({r[c] for r in got.collect()} == {99} for c in names)
    assert sorted((r.doc_id, r.taken) for r in got.collect()) == sorted((r.doc_id, r.taken) for r in mix(document_sizes(docs)).collect())
