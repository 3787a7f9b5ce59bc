import random
import re

import pytest

from sightline.llm.components import components
from sightline.llm.near_dup import near_duplicates, shingle_sets
from sightline.llm.workspace import Workspace

W = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t, k):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    w = W.findall(low)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, share):
    sets = [(i, shingles(t, k)) for i, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x] = top[top[x]]
        return x

    by: dict = {}
    for x, (_, s) in enumerate(sets):
        for e in s:
            by.setdefault(e, []).append(x)
    from collections import Counter

    for x, (i, s) in enumerate(sets):
        if not s or i is None:
            continue
        for y, both in Counter(z for e in s for z in by[e] if z < x).items():
            if sets[y][0] is not None and 100 * both >= share * len(s | sets[y][1]):
                top[find(x)] = find(y)
    least: dict = {}
    for x, (i, s) in enumerate(sets):
        if i is not None:
            least[find(x)] = min(least.get(find(x), i), i)
    return sorted(((i, len(s), None if i is None else least[find(x)]) for x, (i, s) in enumerate(sets)), key=str)


def check(spark, rows, k, share):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = near_duplicates(df, k=k, share=share).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, k, share)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_families(spark):
    rnd = random.Random(4)
    rows = []
    for f in range(30):
        base = [f"w{rnd.randint(0, 3000)}" for _ in range(rnd.choice([2, 4, 30, 120, 400]))]
        for _ in range(rnd.choice([1, 2, 3, 6])):
            t = list(base)
            for _ in range(int(len(t) * rnd.choice([0, 0, 0.01, 0.02, 0.05]))):
                t[rnd.randrange(len(t))] = f"x{rnd.randint(0, 999)}"
            rows.append((len(rows) * 31 % 997, " ".join(t).upper() if rnd.random() < 0.3 else " ".join(t)))
    rows += [(2000, None), (2001, ""), (2002, "one"), (2003, "ONE"), (None, "one"), (2004, " \t\n"), (None, None), (2005, "É"), (2006, "é"), (2002, "another text under the same id")]
    check(spark, rows, 3, 85)


def test_one_large_family_whose_hub_is_not_the_smallest(spark):
    rnd = random.Random(9)
    base = [f"b{i}" for i in range(300)]
    rows = [(500, " ".join(base))]
    for i in range(150):
        t = list(base)
        for at in rnd.sample(range(5, 295), 7):
            t[at] = f"v{i}_{at}"
        rows.append((i, " ".join(t)))
    check(spark, rows, 3, 85)


def one_region_without_candidates(limit):
    """A first round whose hubs join nothing: all nodes of a bucket lie in one region."""
    import numpy as np
    import pyarrow as pa

    def run(table):
        node, at = np.unique(np.frombuffer(b"".join(table.column("nodes").to_pylist()), np.int64), return_index=True)
        sketch = np.frombuffer(b"".join(table.column("sketches").to_pylist()), np.uint8).reshape(-1, 64)[at]
        return pa.table({"bucket": pa.array([table.column("bucket")[0].as_py()], pa.int32()), "a": [b""], "b": [b""], "nodes": [node.tobytes()], "regions": [np.zeros(len(node), np.int32).tobytes()], "sketches": [sketch.tobytes()]})

    return run


def test_two_loose_families_joined_by_one_link(spark, monkeypatch):
    from sightline.llm import near_dup

    monkeypatch.setattr(near_dup, "_grow", one_region_without_candidates)
    x = [f"w{i}" for i in range(400)]
    d = [f"d{i}" if i % 14 == 0 else w for i, w in enumerate(x)]
    rows = [(50, " ".join(x)), (20, " ".join(d))]
    for base, name in ((x, "l"), (d, "m")):
        for k in range(6):  # closer to the middle of their family than the two middles are to each other
            rows.append((len(rows) + 100, " ".join(f"{name}{k}_{i}" if i % 23 == 3 * k + 1 else w for i, w in enumerate(base))))
    assert len({c for _, _, c in brute(rows, 1, 85)}) == 1 and len({c for _, _, c in brute(rows[1:], 1, 85)}) == 7 == len({c for _, _, c in brute(rows[:1] + rows[2:], 1, 85)})
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # one bucket, so one region of all
    try:
        check(spark, rows, 1, 85)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)


@pytest.mark.parametrize("share", [70, 80, 85, 95, 100])
def test_trees_follow_the_limit(share):
    """Signatures of pairs at the limit: the chance that no tree holds both at full depth."""
    import numpy as np
    import pyarrow as pa

    from sightline.llm import near_dup

    text = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["a b c d e f"])], names=["id", "text"])
    trees = len(next(near_dup._sign(3, near_dup.trees_for(share))([text])).column(3)[0].as_py()) // 4 // near_dup.DEPTH_MAX
    assert (1 - (share / 100) ** near_dup.DEPTH_MAX) ** trees <= 1e-4
    assert np.iinfo(np.uint16).max > trees


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    check(spark, rows, 3, 85)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_short_texts_are_not_shingles_of_longer_ones():
    sets = shingle_sets(__import__("pyarrow").array(["a b", "a b c", "b", "a a a a"]), 3)
    assert [len(s) for s in sets] == [1, 1, 1, 1] and len({int(s[0]) for s in sets}) == 4


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randint(-50, 300), rnd.randint(-50, 300)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1040)] + [(7, 7)]
    top = {x: x for e in edges for x in e}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "t")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_slices_of_a_batch_give_the_same_sets():
    import pyarrow as pa

    from sightline.llm.text import Words, slices

    rnd = random.Random(3)
    texts = [None if rnd.random() < 0.1 else " ".join(f"W{rnd.randint(0, 99)}É" for _ in range(rnd.randint(0, 80))) for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])
    parts = list(slices(batch, 0, 2000))
    assert len(parts) > 5 and sum(p.num_rows for p in parts) == 300
    cut = [s.tolist() for p in parts for s in shingle_sets(p.column(0), 3)]
    assert cut == [s.tolist() for s in shingle_sets(batch.column(0), 3)]
    assert sum(Words(p.column(0), lower=True).counts.sum() for p in parts) == sum(len((t or "").split()) for t in texts)
