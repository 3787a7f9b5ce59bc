"""Scores of two readings are those of pages, postings and joins, and little is written for them."""
import os
import random

import pytest

from sightline.operators import finding as fi
from sightline.operators import scanning as sc
from sightline.plans.catalog import queries
from sightline.sources.shared import shared_dir

WORDS = ["alpha", "alphas", "alphabet", "beta", "betas", "rnodel", "model", "modell", "mode1", "iilex", "ulex", "the", "of", "port", "sport", "İstan", "istan", "Kelvin", "kelvin", "ñandu", "x", "\t", " ", "ÄÖ", "ü" * 50, "modelmodelmodel"]


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(7)
    text = lambda: "\n".join("".join(rnd.choice(WORDS) + rnd.choice([" ", " ", "-", ", ", ""]) for _ in range(rnd.randint(0, 30))) for _ in range(rnd.randint(0, 6)))
    rows = [(i, text()) for i in range(150)] + [(1000, None), (1001, ""), (1002, "\n\n \n"), (1003, "abc"), (1004, "abc"), (1005, "\t\nkelvin"), (1006, "alpha beta model\n" * 40), (None, "alpha")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()


@pytest.fixture(scope="module")
def asked(spark):
    rnd = random.Random(8)
    return spark.createDataFrame([(i, " ".join(rnd.choice(WORDS) for _ in range(4))) for i in range(15)] + [(30, ""), (31, "the"), (3, "alphabet"), (None, "beta")], "query int, text string")


def rows(df):
    return sorted(((r.query, r.doc_id, r.page, round(r.score, 9), r.exact_terms, r.fuzzy) for r in df.collect()), key=str)


@pytest.mark.parametrize("small", [False, True])
def test_scores_best_pages_and_ranks(spark, docs, asked, monkeypatch, small):
    if small:  # documents over several slices, queries over several readings
        monkeypatch.setattr(sc, "PAGES", 3)
        monkeypatch.setattr(sc, "SCORED", 200)
        monkeypatch.setattr(sc, "QUERIES", 7)
    want = fi.page_scores(fi.pages_of(docs.where("doc_id IS NOT NULL")), asked).cache()
    best = fi.best_page_per_document(want, 0.1)
    assert rows(sc.scores(docs, asked)) == rows(want)
    assert rows(sc.scores(docs, asked, 0.1)) == rows(best)
    assert rows(fi.search_rank(sc.scores(docs, asked, 0.1, 3), 3)) == rows(fi.search_rank(best, 3))


def test_counts_of_pages(docs):
    total, frequency = fi.corpus_stats(fi.pages_of(docs.where("doc_id IS NOT NULL")))
    counted, pages, average = sc.page_counts(docs)
    assert (pages, average) == (total.first().pages, pytest.approx(total.first().average_length))
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, frequency.collect()))


def test_nothing_to_find(spark, asked):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert sc.page_counts(none)[1:] == (0, 0.0) and sc.scores(none, asked).count() == 0
    some = spark.createDataFrame([(1, "alpha")], "doc_id long, text string")
    assert sc.scores(some, asked.where("query = 30")).count() == sc.scores(some, asked.limit(0), 0.1, 5).count() == 0


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rnd, path = random.Random(9), tmp_path_factory.mktemp("tables")
    some = [f"w{k}" for k in range(300)]
    spark.createDataFrame([(i, "\n".join(" ".join(rnd.choices(some, k=40)) for _ in range(5))) for i in range(1500)], "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, "w1 w22 w299"), (2, "w5")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def _size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)


@pytest.mark.parametrize("name", ["bm25_search", "best_page_per_document", "search_rank", "fuzzy_expand"])
def test_searches_write_no_texts_and_postings(spark, tables, name):
    shared = shared_dir(spark).removeprefix("file://")
    before = _size(shared)
    assert queries()[name](spark, tables).count() > 0
    assert _size(shared) - before < _size(f"{tables}/documents.parquet") / 4
