import hashlib
import random
import struct

import numpy as np
from pyspark.sql import functions as F

from sightline.llm.centroids import Bounds, cluster_vectors, squared


def brute(rows, dim, k, rounds, scale=1024, seed=3):
    """Lloyd's rounds with Python's own integers, all distances every time."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [int(np.floor(min(max(scale * x, -(1 << 27)), 1 << 27))) for x in v]))
    seeds = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), struct.pack(f"<{dim}i", *v), j) for j, (i, v) in enumerate(kept) if i is not None)[:k]
    cs = [kept[j][1] for _, _, j in seeds]
    if not cs:
        return []

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cs))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        cs = [[sum(x) // own.count(j) for x in zip(*(v for (_, v), o in zip(kept, of) if o == j))] if (own := of).count(j) else c for j, c in enumerate(cs)]
    last = [(i, *nearest(v)) for i, v in kept]
    per = {j: sum(d for _, d, o in last if o == j) for j in range(len(cs))}
    return sorted(((i, j, d, per[j], sum(per.values()), hashlib.sha256(",".join(map(str, cs[j])).encode()).hexdigest()) for i, d, j in last), key=str)


def result(df, **kw):
    return sorted((tuple(r)[:6] for r in cluster_vectors(df, **kw).collect()), key=str)


def made(n, dim, seed):
    rnd = random.Random(seed)
    middle = [[rnd.uniform(-1, 1) for _ in range(dim)] for _ in range(6)]
    return [(i, [x + rnd.gauss(0, 0.2) for x in rnd.choice(middle)]) for i in range(n)]


ODD = [(900, None), (901, []), (902, [1.0]), (903, [None, 1.0, 1.0, 1.0]), (904, [float("nan"), 0.0, 0.0, 0.0]), (905, [float("inf"), 0.0, 0.0, 0.0]), (None, [0.1, 0.2, 0.3, 0.4]), (906, [0.0] * 4), (907, [-1e300, 1e300, 0.0, 0.0]), (5, [0.1, 0.2, 0.3, 0.4]), (5, [0.1, 0.2, 0.3, 0.4])]


def test_against_brute_force(spark):
    for seed, k, near in ((1, 8, None), (2, 12, 2), (3, 5, 4), (4, 1, None)):
        rows = made(120, 4, seed) + ODD
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
        assert result(df, dim=4, k=k, near=near, rounds=6) == brute(rows, 4, k, 6), (seed, k)


def test_ties_and_equal_vectors(spark):
    rows = [(i, [float(i % 3), float(i % 2)]) for i in range(60)] + [(100 + i, [0.5, 0.5]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert result(df, dim=2, scale=2, rounds=5) == brute(rows, 2, 8, 5, scale=2)


def test_few_vectors_empty_table_other_columns(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("own")).withColumn("row", F.lit("own"))
    assert result(df, dim=2, rounds=3) == brute(rows, 2, 8, 3)
    empty = cluster_vectors(df.limit(0), dim=2)
    assert empty.count() == 0 and empty.schema.names == cluster_vectors(df, dim=2).schema.names
    assert cluster_vectors(df.withColumn("vec_id", F.lit(None).cast("long")), dim=2).count() == 0


def test_no_round_gives_the_first_centroids(spark):
    rows = made(30, 3, 7)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert result(df, dim=3, k=4, rounds=0) == brute(rows, 3, 4, 0)


def test_bounds_certify_and_save_distances():
    rnd = np.random.default_rng(5)
    x = rnd.integers(-1000, 1000, (3000, 8)) + rnd.integers(0, 6, (3000, 1)) * 2000
    cs = x[:20].astype(np.int64)
    state, measured = Bounds.measured(x, cs, 6), []
    for _ in range(8):
        new = np.array([x[state.cluster == j].sum(axis=0) // max(1, (state.cluster == j).sum()) if (state.cluster == j).any() else c for j, c in enumerate(cs)])
        moves = np.sqrt(((new - cs) ** 2).sum(axis=1)) * (1 + 1e-12)
        cs, state.used = new, 0
        state.step(x, cs, moves, 6)
        d = squared(x, cs)
        assert (state.cluster == d.argmin(axis=1)).all()
        own = np.sqrt(d[np.arange(len(x)), state.cluster])
        assert (state.high >= own).all()
        others = np.take_along_axis(np.sqrt(d), state.order, axis=1)
        assert (state.low <= others).all()
        listed = np.concatenate([state.cluster[:, None], state.order], axis=1)
        d[np.arange(len(x))[:, None], listed] = np.iinfo(np.int64).max
        assert (state.rest <= np.sqrt(d.min(axis=1))).all()
        measured.append((state.high >= np.minimum(state.low.min(axis=1), state.rest)).mean())
    assert measured[-1] < 0.2  # most vectors are certified in the end
