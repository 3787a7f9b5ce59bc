import hashlib
import random
import re

from pyspark.sql import functions as F

from sightline.llm.repeats import strip_repeats

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    first: dict = {}
    split = [(i, W.findall(t or "")) for i, t in rows]
    for i, w in split:
        if i is not None:
            for s in range(len(w) - window + 1):
                k = tuple(w[s : s + window])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, w in split:
        gone = set()
        if i is not None:
            for s in range(len(w) - window + 1):
                if first[tuple(w[s : s + window])] < i:
                    gone |= set(range(s, s + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["a", "b", "c", "dé", "E", "e", " x", "long" * 9])
    passages = [[word() for _ in range(rnd.randint(5, 60))] for _ in range(6)]
    rows = []
    for i in range(120):
        w: list = []
        for _ in range(rnd.randint(0, 5)):
            w += [word() for _ in range(rnd.randint(0, 30))] + (rnd.choice(passages) if rnd.random() < 0.6 else [])
        rows.append((i * 7 % 120, rnd.choice([" ", "\n", "\t "]).join(w) if rnd.random() > 0.05 else None))
    rows += [(5, rows[3][1]), (None, rows[4][1]), (None, "x"), (-3, rows[8][1]), (7, ""), (3, rows[3][1]), (500, "ab " * 3000), (501, "ab " * 100)]
    return rows


def test_against_brute_force(spark):
    for seed, window in ((1, 10), (2, 20), (3, 50)):
        rows = made(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in strip_repeats(df, window=window, texts=False).collect()), key=str)
        assert got == brute(rows, window), (seed, window)


def test_texts_and_columns(spark):
    p = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, "x  " + p, "a"), (2, p + " end", "b"), (3, None, "c")], "doc_id long, text string, n_words string").withColumn("_id", F.lit("clash"))
    out = {r.doc_id: r for r in strip_repeats(df).collect()}
    assert out[1].text == "x  " + p and out[2].text == "end" and out[3].text is None and out[2].n_removed == 60 and out[1]["_id"] == "clash"
    assert strip_repeats(df.limit(0)).count() == 0


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in strip_repeats(df, texts=False).collect()), key=str)
    want = brute([(r.doc_id, r.text) for r in df.collect()], 50)
    assert got == want and sum(r[2] for r in got) > 0


def test_windows_whose_first_hash_clashes(monkeypatch):
    """All windows get one of three first hashes; the second one still tells them apart."""
    import numpy as np
    import pyarrow as pa

    from sightline.llm import repeats

    monkeypatch.setattr(repeats, "_key", lambda h: h % np.uint64(3))
    rows, window, n = made(4), 10, 4
    docs = [pa.table({"_part": pa.array([p] * len(mine), pa.int32()), "_id": pa.array([i for i, _ in mine], pa.int64()), "_text": pa.array([t for _, t in mine], pa.string())}) for p in range(3) for mine in [rows[p::3]]]
    by = lambda t, key: {k: t.filter(pa.array([x == k for x in t.column(key).to_pylist()])) for k in set(t.column(key).to_pylist())}
    hits = pa.concat_tables([repeats._hits(x) for x in by(pa.concat_tables([repeats._anchors(d, window, n) for d in docs]), "bucket").values()])
    mine = by(hits, "part")
    found = pa.concat_tables([repeats._candidates(mine.get(p, hits.slice(0, 0)), d, window, n) for p, d in enumerate(docs)])
    answers = pa.concat_tables([repeats._decide(x) for x in by(found, "bucket").values()])
    told = by(answers, "part")
    out = pa.concat_tables([repeats._strip(told.get(p, answers.slice(0, 0)), d, window, ["_id"], False) for p, d in enumerate(docs)])
    got = sorted(((r["_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out.to_pylist()), key=str)
    assert got == brute(rows, window) and sum(r[2] for r in got) > 100


def test_repeated_rows_are_dealt_over_parts(spark):
    """Copies of one row, also without id or text, and one very long text."""
    p = " ".join(f"w{i}" for i in range(60))
    rows = [(1, p)] * 300 + [(2, p)] * 300 + [(None, None)] * 300 + [(3, "a b c " * 100_000)]
    out = strip_repeats(spark.createDataFrame(rows, "doc_id long, text string"), texts=False).groupBy("doc_id", "n_words", "n_removed").count().collect()
    assert {tuple(r) for r in out} == {(1, 60, 0, 300), (2, 60, 60, 300), (None, 0, 0, 300), (3, 300_000, 0, 1)}
