import math
import random

import numpy as np
from pyspark.sql import functions as F

from sightline.llm.embeddings import link_vectors


def brute(rows, cosine=0.95):
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) and i is not None for i, v in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    n = [0] * len(rows)
    for x in range(len(rows)):
        for y in range(x):
            if ok[x] and ok[y] and len(rows[x][1]) == len(rows[y][1]):
                a, b = np.array(rows[x][1]), np.array(rows[y][1])
                if (a * b).sum() / math.sqrt((a * a).sum()) / math.sqrt((b * b).sum()) >= cosine:
                    n[x] += 1
                    n[y] += 1
                    top[find(x)] = find(y)
    least: dict = {}
    for x, (i, _) in enumerate(rows):
        if ok[x]:
            least[find(x)] = min(least.get(find(x), i), i)
    return sorted(((i, n[x], least[find(x)] if ok[x] else i) for x, (i, _) in enumerate(rows)), key=str)


def test_against_brute_force(spark):
    rnd = random.Random(1)
    rows = []
    for dim in (3, 20, 64):
        for _ in range(40):
            base = [rnd.gauss(0, 1) for _ in range(dim)]
            for _ in range(rnd.choice([1, 1, 2, 5])):
                s = rnd.choice([0, 0.1, 0.25, 0.33, 0.4])
                rows.append([rnd.choice([1, 1, 3.5]) * (x + rnd.gauss(0, s)) for x in base])
            rows.append(base)
    rows = [(i * 17 % 4001, v) for i, v in enumerate(rows)]
    rows += [(5000, None), (5001, [0.0] * 3), (5002, [float("nan"), 1.0, 1.0]), (5003, [1.0, None, 1.0]), (5004, []), (None, rows[0][1]), (rows[0][0], rows[0][1]), (5005, rows[3][1]), (5006, [1e200, 1e200, 0.0]), (5007, [0.0, 0.0, 1e-300])]
    rows[-2:] = []
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("node", F.lit("clash")).repartition(3)
    want = brute(rows)
    assert any(r[1] > 2 for r in want)
    for tile, axes in ((8192, 2), (20, 2), (50, 3)):
        got = link_vectors(df, tile=tile, axes=axes).collect()
        assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == want
        assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in got)


def test_numbers_whose_squares_do_not_fit(spark):
    df = spark.createDataFrame([(1, [1e200, 1e200]), (2, [1e-200, 1e-200]), (3, [1e200, -1e200])], "vec_id long, embedding array<double>")
    assert {(r.vec_id, r.n_links, r.component_id) for r in link_vectors(df).collect()} == {(1, 1, 1), (2, 1, 1), (3, 0, 3)}


def test_empty_and_float(spark):
    df = spark.createDataFrame([(2, [1.0, 2.0]), (1, [2.0, 4.0])], "vec_id long, embedding array<float>")
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in link_vectors(df).collect()} == {(1, 1, 1, True), (2, 1, 1, False)}
    assert link_vectors(df.limit(0)).count() == 0
