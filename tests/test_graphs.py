import random

from sightline.operators.graphs import bfs_compose, budget_thinning, connected_components, cycle_residuals, drop_small_components, greedy_cover, hop_distances, laplacian_smooth, union_find_census


def brute(nodes, edges):
    label = {n: n for n in nodes}
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            low = min(label[a], label[b])
            moved |= (label[a], label[b]) != (low, low)
            label[a] = label[b] = low
    return label


def table(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long")


def test_components_and_census(spark):
    rng = random.Random(4)
    path = [(i, i + 1) for i in range(100, 160)]
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + path + path[:3] + [(5, 5)]
    nodes = list(range(60)) + list(range(100, 161))
    got = connected_components(spark.createDataFrame([(n,) for n in nodes] + [(None,)], "node long"), table(spark, edges + [(None, 3)]))
    labels = {r.node: r.component for r in got.collect()}
    assert labels == brute(nodes, edges)
    sizes = {r.component: r.members for r in union_find_census(got).collect()}
    assert sum(sizes.values()) == len(nodes)
    big = {r.node for r in drop_small_components(got, 0.9).collect()}
    assert big == {n for n, c in labels.items() if sizes[c] >= max(1, 0.9 * max(sizes.values()))}


def test_no_nodes(spark):
    assert connected_components(spark.createDataFrame([], "node long"), table(spark, [])).collect() == []


def test_hops(spark):
    got = hop_distances(table(spark, [(1, 2), (2, 3), (3, 4), (4, 5), (1, 3), (8, 9)]), spark.createDataFrame([(1,)], "node long"), 2)
    assert {r.node: r.hops for r in got.collect()} == {1: 0, 2: 1, 3: 1, 4: 2}


def test_smoothing_moves_towards_neighbours(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 1.0, 9.0, 0.0), (3, 2.0, 0.0, 0.0), (4, 7.0, 7.0, 7.0)], "node long, x double, y double, z double")
    got = {r.node: r for r in laplacian_smooth(points, table(spark, [(1, 2), (2, 3)]), 1, inflate=0.0).collect()}
    assert (got[2].y, got[1].y, got[4].x) == (4.5, 4.5, 7.0)


def test_compose_and_residuals(spark):
    turn = [0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    eye = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    schema = "src long, dst long, s double, r array<double>, t array<double>"
    tree = [(2, 1, 2.0, turn, [1.0, 0.0, 0.0]), (2, 3, 0.5, eye, [0.0, 0.0, 4.0])]
    placed = bfs_compose(spark.createDataFrame(tree, schema), spark.createDataFrame([(1,)], "node long"))
    got = {r.node: r for r in placed.collect()}
    assert got[2].s == 2 and got[2].t == [1, 0, 0] and got[2].r == turn and got[3].hops == 2
    assert got[3].s == 4 and got[3].t == [1, 0, -16]
    loop = spark.createDataFrame([*tree, (3, 1, 8.0, eye, [1.0, 0.0, -16.0])], schema)
    res = {(r.src, r.dst): r for r in cycle_residuals(loop, placed).collect()}
    assert res[2, 1].degrees < 1e-6 and res[2, 3].shift < 1e-9 and res[2, 3].scale_ratio == 1
    assert abs(res[3, 1].degrees - 90) < 1e-6 and res[3, 1].scale_ratio == 2


def test_cover_and_thinning(spark):
    scores = spark.createDataFrame([(1, 1, 1.0), (1, 2, 1.0), (2, 3, 1.5), (3, 1, 1.0), (3, 2, 1.0), (4, 9, 0.001)], "frame long, point long, score double")
    assert [(r.place, r.frame, round(r.gain, 6)) for r in greedy_cover(scores, 4).collect()] == [(1, 1, 2.0), (2, 2, 1.5), (3, 3, 0.6)]
    rng = random.Random(2)
    points = spark.createDataFrame([(rng.random(), rng.random(), 0.0, 1, 2, 3, i % 9) for i in range(2000)], "x double, y double, z double, r int, g int, b int, confidence int")
    assert 170 <= budget_thinning(points, 200).count() <= 200 and budget_thinning(points, 5000).count() == 2000
