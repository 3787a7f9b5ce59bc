"""Joins of points, cameras and boxes against plain loops, with ties, limits and crowded keys."""
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.functions.assignment import associate, iou
from sightline.operators import views as vi

EYE = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
CAMERA = [(0, 100.0, 100.0, 50.0, 50.0, 100, 100)]
CAMERAS = "camera int, fx double, fy double, cx double, cy double, w int, h int"
POSES = "frame int, camera int, r array<double>, t array<double>"


def rotation(rnd):
    q, _ = np.linalg.qr(np.array([[rnd.gauss(0, 1) for _ in range(3)] for _ in range(3)]))
    return q if np.linalg.det(q) > 0 else -q


def test_reprojections_by_component(spark):
    rnd = random.Random(1)
    poses = {f: (rotation(rnd), np.array([rnd.uniform(-1, 1) for _ in range(3)]) + [0, 0, 2]) for f in range(4)}
    points = {p: (p % 3, np.array([rnd.uniform(-1, 1) for _ in range(3)])) for p in range(60)}
    seen = [(f, p, rnd.uniform(0, 100), rnd.uniform(0, 100)) for f in range(5) for p in rnd.sample(range(65), 30)]
    errors = {}
    for f, p, u, v in seen:
        if f in poses and p in points:
            x = poses[f][0] @ points[p][1] + poses[f][1]
            e = math.hypot(100 * x[0] / x[2] + 50 - u, 100 * x[1] / x[2] + 50 - v) if x[2] > 1e-9 else math.inf
            errors.setdefault(points[p][0], []).append(e)
            errors.setdefault("all", []).append(e)
    frames = spark.createDataFrame([(f, 0, r.ravel().tolist(), t.tolist()) for f, (r, t) in poses.items()], POSES)
    pts = spark.createDataFrame([(p, c, *map(float, x)) for p, (c, x) in points.items()], "point int, component int, x double, y double, z double")
    out = vi.reprojection_stats(vi.reprojections(spark.createDataFrame(seen, "frame int, point int, u double, v double"), frames, pts, spark.createDataFrame(CAMERA, CAMERAS)))
    got = {("all" if r.overall else r.component): r for r in out.collect()}
    assert set(got) == set(errors)
    for k, e in errors.items():
        fine = [x for x in e if x < math.inf]
        assert (got[k]["count"], got[k].behind) == (len(fine), len(e) - len(fine))
        assert (got[k].median, got[k].p95, got[k].p99, got[k]["max"], got[k].over) == pytest.approx((np.median(fine), np.percentile(fine, 95), np.percentile(fine, 99), max(fine), np.mean([x > 3 for x in fine])))


def test_landmarks_need_parallax_and_both_views(spark):
    poses = spark.createDataFrame([(0, 0, EYE, [0.0, 0.0, 0.0]), (1, 0, EYE, [-1.0, 0.0, 0.0]), (2, 0, EYE, [-0.001, 0.0, 0.0]), (3, 0, EYE, [0.0, 0.0, -9.0])], POSES)
    points = spark.createDataFrame([(p, 0, 0.0, 0.0, 5.0) for p in range(6)], "point int, component int, x double, y double, z double")
    seen = [(0, p, 50.0, 50.0) for p in range(6)] + [(1, 0, 30.0, 50.0), (1, 1, 33.0, 50.0), (1, 2, 33.01, 50.0), (2, 3, 50.0, 50.0), (3, 4, 50.0, 50.0)]
    landmarks = spark.createDataFrame([(0, 0, 1), (1, 0, 1), (2, 0, 1), (3, 0, 2), (4, 0, 3), (5, 0, 1)], "point int, a int, b int")
    out = vi.landmark_checks(landmarks, spark.createDataFrame(seen, "frame int, point int, u double, v double"), poses, points, spark.createDataFrame(CAMERA, CAMERAS), 1.5)
    assert {r.point: r.reason for r in out.collect()} == {0: None, 1: None, 2: "high_reprojection", 3: "low_parallax", 4: "high_reprojection", 5: "high_reprojection"}


def test_views_agree_on_the_nearest_pixel(spark):
    poses = spark.createDataFrame([(0, 0, EYE, [0.0, 0.0, 0.0]), (1, 0, EYE, [-1.0, 0.0, 0.0]), (2, 0, EYE, [0.0, 0.0, -100.0])], POSES)
    points = spark.createDataFrame([(0, 0, 0.0, 0.0, 10.0), (1, 0, 0.0, 1.0, 10.0), (2, 0, 90.0, 0.0, 10.0), (3, 0, 0.0, 2.0, 10.0)], "id int, frame int, x double, y double, z double")
    near = spark.createDataFrame([(0, 1), (0, 2)], "frame int, other int")
    depths = spark.createDataFrame([(1, 40, 50, 10.4), (1, 40, 60, 10.51), (1, 40, 70, float("nan"))], "frame int, u long, v long, depth double")
    out = vi.multi_view_agreement(points, near, poses, spark.createDataFrame(CAMERA, CAMERAS), depths, 0.05, 1).collect()
    (r,) = out
    x = (40.5 - 50) / 100 * 10.4 + 1  # what the other camera says, in the world
    assert (r.id, r.agree) == (0, 1) and (r.x, r.y, r.z) == pytest.approx((x / 2, 0.005 * 10.4 / 2, 10.2))


def test_nearest_against_all_pairs(spark):
    rnd = random.Random(3)
    rows = [("a", i, rnd.uniform(0, 1), rnd.uniform(0, 1), 0.0) for i in range(80)] + [("a", 500 + i, 50 + rnd.random(), 0.0, 0.0) for i in range(3)]
    rows += [("b", i, 1.0, 1.0, 1.0) for i in range(5)] + [("c", 1, 0.0, 0.0, 0.0)] + [("d", 1, 0.0, 0.0, 0.0), ("d", 2, 9.0, 0.0, 0.0)] + [(None, i, float(i), 0.0, 0.0) for i in range(4)]
    df = spark.createDataFrame(rows, "g string, id int, x double, y double, z double")
    want = set()
    for g, i, *p in rows:
        others = sorted((sum((a - b) ** 2 for a, b in zip(p, q)), j) for h, j, *q in rows if h == g and j != i)[:3]
        want |= {(g, i, j, n + 1, round(d, 9)) for n, (d, j) in enumerate(others)}
    for size in (None, 0.05, 30.0):
        assert {(r.g, r.id, r.other, r.place, round(r.d2, 9)) for r in vi.nearest(df, 3, size).collect()} == want, size
    assert vi.nearest(df.limit(0), 3).count() == 0


def test_shared_points_with_one_in_every_frame(spark):
    rnd = random.Random(5)
    held = {(0, f) for f in range(40)} | {(p, f) for p in range(1, 30) for f in rnd.sample(range(40), rnd.randint(1, 6))}
    rows = [*held, *list(held)[:50], (None, 1), (3, None)]
    want = {}
    for a, b in itertools.permutations(range(40), 2):
        n = sum((p, a) in held and (p, b) in held for p in range(30))
        want[a, b] = n
    for heavy in (4, 7, 1000):
        got = {(r.frame, r.other): r.shared for r in vi.shared_counts(spark.createDataFrame(rows, "point int, frame int"), heavy).collect()}
        assert got == want, heavy


def test_a_point_in_every_frame_is_many_keys(spark):
    """No key of the join holds over a tenth of a hot point's pairs."""
    df = spark.createDataFrame([(0, f) for f in range(200)], "point int, frame int")
    n = df.groupBy("point").agg(F.count("*").alias("n"))
    blocks = -(-200 // 16)
    assert n.first().n == 200 and blocks**2 > 100
    assert vi.shared_counts(df, 16).agg(F.sum("shared")).first()[0] == 200 * 199


def test_overlaps_and_assignment(spark):
    rnd = random.Random(7)

    def boxes(n, f):
        return [(f, i, rnd.choice(["cup", "pen"]), x := rnd.uniform(-50, 300), y := rnd.uniform(-50, 300), x + rnd.choice([0.0, 40.0, 120.0]), y + rnd.uniform(1, 150)) for i in range(n)]

    a, b = [r for f in range(4) for r in boxes(14, f)], [r for f in range(4) for r in boxes(14, f)]
    left, right = (spark.createDataFrame(x, f"frame int, {k} int, label string, x0 double, y0 double, x1 double, y1 double") for x, k in ((a, "track"), (b, "detection")))
    want = {(p[0], p[1], q[1]): iou(list(p[3:]), list(q[3:])) for p in a for q in b if p[0] == q[0] and p[2] == q[2]}
    want = {k: v for k, v in want.items() if v >= 0.25}
    for tile in (32.0, 5000.0):
        got = {(r.frame, r.track, r.detection): r.iou for r in vi.overlaps(left, right, 0.25, tile).collect()}
        assert got == pytest.approx(want), tile
    chosen = {(r.frame, r.track): r.detection for r in vi.assigned(left, right).collect()}
    for f in range(4):
        s, t = [r for r in a if r[0] == f], [r for r in b if r[0] == f]
        one = associate([[r[2], *r[3:]] for r in s], [[r[2], *r[3:]] for r in t])
        assert {k[1]: v for k, v in chosen.items() if k[0] == f} == {s[i][1]: t[j][1] for i, j in one.items()}


def test_both_tracks_are_matched(spark):
    """The best pair alone would leave the second track without one."""
    t = spark.createDataFrame([(0, 1, "p", 0.0, 0.0, 4.0, 1.0), (0, 2, "p", 0.0, 0.0, 1.0, 1.0)], "frame int, track int, label string, x0 double, y0 double, x1 double, y1 double")
    d = spark.createDataFrame([(0, 1, "p", 0.0, 0.0, 4.0, 1.0), (0, 2, "p", 1.0, 0.0, 4.0, 1.0), (0, 3, "q", 0.0, 0.0, 4.0, 1.0)], "frame int, detection int, label string, x0 double, y0 double, x1 double, y1 double")
    assert {(r.track, r.detection) for r in vi.assigned(t, d).collect()} == {(1, 2), (2, 1)}
