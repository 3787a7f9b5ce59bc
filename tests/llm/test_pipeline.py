import sys
from collections import Counter, defaultdict

import pytest

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
import corpus_pipeline as P  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out, docs = {"documents": spark.read.parquet(f"{SF}/documents.parquet")}, None
    docs = out["documents"]
    for name, f in P.STAGES:
        path = str(tmp_path_factory.mktemp("p") / name)
        f(spark, docs, SF).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return {k: (v.columns, v.collect()) for k, v in out.items()}


def test_columns_stay(stages):
    for name in ("quality", "near_dedup", "substrings", "mixing"):
        assert stages[name][0] == stages["documents"][0]


def test_each_stage_on_its_own_input(stages):
    from tests.llm.test_near_dup import brute as groups
    from tests.llm.test_quality import brute as measured
    from tests.llm.test_repeats import brute as repeats

    docs = {r.doc_id: r for r in stages["documents"][1]}
    good = {r.doc_id: r for r in stages["quality"][1]}
    assert all(docs[i] == r for i, r in good.items())
    for i, r in docs.items():
        n, *_, rep = measured(r.text)
        if n < 20 or 100 * rep > 30 * n:
            assert i not in good
    rows = [(i, r.text) for i, r in good.items()]
    alone = {i for i, r in stages["near_dedup"][1] and {r.doc_id: r for r in stages["near_dedup"][1]}.items()}
    assert alone == {i for i, _, c in groups(rows, 5, 80) if i == c}
    before = {r.doc_id: r.text for r in stages["near_dedup"][1]}
    after = {r.doc_id: r.text for r in stages["substrings"][1]}
    assert set(before) == set(after)
    import hashlib

    for i, n, gone, digest in repeats(list(before.items()), 50):
        assert after[i] == before[i] if not gone else hashlib.sha256(after[i].encode()).hexdigest() == digest
    mixed = Counter(r.doc_id for r in stages["mixing"][1])
    assert set(mixed) <= set(after) and max(mixed.values()) <= 3
    assert all(r.text == after[r.doc_id] for r in stages["mixing"][1])
    words, kept = defaultdict(int), defaultdict(int)
    for r in stages["substrings"][1]:
        words[r.source] += len((r.text or "").split())
    for r in stages["mixing"][1]:
        kept[r.source] += len((r.text or "").split())
    assert abs(sum(kept.values()) - sum(words.values())) < 0.05 * sum(words.values())
    coded = Counter(r.doc_id for r in stages["encode"][1])
    assert coded == mixed


def test_ids_decode_to_the_text(stages):
    from sightline.llm.bpe import load_ranks

    ranks = {i: b for b, i in load_ranks(P.vocabulary()[0]).items()}
    text = {r.doc_id: r.text for r in stages["mixing"][1]}
    for r in stages["encode"][1]:
        assert b"".join(ranks[i] for i in r.token_ids).decode() == (text[r.doc_id] or "") and r.n_tokens == len(r.token_ids)


def test_odd_rows_go_through(spark, tmp_path):
    docs = spark.createDataFrame([(1, None, None, None, None), (None, "a b " * 20, "en", "s", 3), (2, "", "en", "s", 0), (3, " ".join(f"w{i}" for i in range(40)), None, "s", 9), (3, " ".join(f"w{i}" for i in range(40)), None, "s", 9)], "doc_id long, text string, lang string, source string, n_chars long").withColumnRenamed("n_chars", "n_chars")
    for df in (docs, docs.limit(0)):
        for k, (name, f) in enumerate(P.STAGES):
            f(spark, df, SF).write.mode("overwrite").parquet(f"{tmp_path}/{k}")
            df = spark.read.parquet(f"{tmp_path}/{k}")
