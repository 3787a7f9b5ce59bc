"""The stored index gives what scoring the texts gives, after every update."""
import random

import pytest

from sightline.operators import finding as fi
from sightline.sources.search_index import SearchIndex, index_of

DOCS = "doc_id long, text string"
ASKED = [(1, "transformer attention"), (2, "metric distance scale"), (3, "receipt"), (4, "kubernetes cluster"), (5, "the of and"), (6, ""), (7, "absent"), (8, "transf attentive scales")]


def found(df):
    return sorted((r.query, r.doc_id, r.page, round(r.score, 9), r.exact_terms, r.fuzzy) for r in df.collect())


def same(spark, index, docs):
    queries = spark.createDataFrame(ASKED, "query int, text string")
    want = found(fi.page_scores(fi.pages_of(spark.createDataFrame(docs, DOCS)), queries))
    assert found(index.scores(queries)) == want
    return want


def test_updates_by_document(spark, tmp_path):
    docs = {1: "Transformers\nattention is all you need\ntransformer attention", 2: "Depth scale\nmetric distance", 3: None, 4: " \n", 5: "receipt\nkubemetes cluster", 6: "receipt\nnothing"}
    index = SearchIndex(spark, f"{tmp_path}/i", buckets=4).update(spark.createDataFrame(list(docs.items()), DOCS))
    assert same(spark, index, list(docs.items()))
    steps = [{2: "Depth\nanother distance\nscales", 7: "kubernetes\ntransformer"}, {5: None, 6: "", 8: "mmr attention"}, {2: None, 9: "the of"}, {5: "receipt again\nclusters"}]
    for step in steps:
        docs |= step
        index.update(spark.createDataFrame(list(step.items()), DOCS))
        same(spark, index, list(docs.items()))
    same(spark, SearchIndex(spark, f"{tmp_path}/i", buckets=4), list(docs.items()))  # opened anew
    pages, average = index.totals()
    lengths = [r.length for r in fi.pages_of(spark.createDataFrame(list(docs.items()), DOCS)).collect()]
    assert pages == len(lengths) and average == pytest.approx(sum(lengths) / pages)


def test_random_texts(spark, tmp_path):
    rnd = random.Random(4)
    words = ["alpha", "alphas", "alphabet", "beta", "betas", "rnodel", "model", "modell", "mode1", "iilex", "ulex", "the", "of", "port", "sport"]
    text = lambda: "\n".join(" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 9))) for _ in range(rnd.randint(0, 4)))
    docs = {i: text() for i in range(60)}
    index = SearchIndex(spark, f"{tmp_path}/i", buckets=3).update(spark.createDataFrame(list(docs.items()), DOCS))
    new = {i: text() for i in rnd.sample(range(80), 30)}
    docs |= new
    index.update(spark.createDataFrame(list(new.items()), DOCS))
    queries = spark.createDataFrame([(i, " ".join(rnd.choice(words) for _ in range(3))) for i in range(12)], "query int, text string")
    assert found(index.scores(queries)) == found(fi.page_scores(fi.pages_of(spark.createDataFrame(list(docs.items()), DOCS)), queries))


def test_results_snippets_refusals(spark, tmp_path):
    index = SearchIndex(spark, f"{tmp_path}/i").update(spark.createDataFrame([(1, "Receipt\ncoffee and receipt"), (2, "other")], DOCS))
    queries = spark.createDataFrame([(1, "receipt"), (2, "the"), (3, "absent")], "query int, text string")
    got = index.search(queries).collect()
    assert [(r.query, r.doc_id, r.place) for r in got] == [(1, 1, 1)] and "eceipt" in got[0].snippet
    assert {r.query: r.reason for r in index.refusals(queries).collect()} == {2: "no searchable terms", 3: "no document with these terms"}
    empty = SearchIndex(spark, f"{tmp_path}/e").update(spark.createDataFrame([], DOCS))
    assert empty.totals() == (0, 0.0) and {r.reason for r in empty.refusals(queries).collect()} == {"no documents"}


def test_a_failed_update_does_not_count(spark, tmp_path):
    index = SearchIndex(spark, f"{tmp_path}/i").update(spark.createDataFrame([(1, "alpha beta")], DOCS))
    keep = index._write

    def broken(df, name, *rest):
        if name == "totals":
            raise OSError("lost")
        keep(df, name, *rest)

    index._write = broken
    with pytest.raises(OSError):
        index.update(spark.createDataFrame([(2, "alpha gamma")], DOCS))
    again = SearchIndex(spark, f"{tmp_path}/i")
    queries = spark.createDataFrame([(1, "alpha gamma")], "query int, text string")
    assert again.generation == 0 and [r[1] for r in found(again.scores(queries))] == [1]
    again.update(spark.createDataFrame([(2, "alpha delta")], DOCS))
    assert [r[1] for r in found(again.scores(queries))] == [1, 2]


def test_the_index_of_a_table_follows_its_files(spark, tmp_path):
    spark.createDataFrame([(1, "alpha")], DOCS).coalesce(1).write.parquet(f"{tmp_path}/d")
    first = index_of(spark, f"{tmp_path}/d")
    assert index_of(spark, f"{tmp_path}/d") is first
    spark.createDataFrame([(2, "alpha")], DOCS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/d")
    second = index_of(spark, f"{tmp_path}/d")
    assert second is not first and second.totals()[0] == 2
