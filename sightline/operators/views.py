"""Points seen by posed cameras, neighbours, shared points and overlapping boxes, as joins; oracles are texts of their own.

A pose is r (nine numbers, by rows) and t (three), from world to camera: p = r x + t; a camera is fx, fy, cx, cy and w, h.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.arrays import best_pairs

from .graphs import cut, drop
from .measuring import percentile_by_rank
from .tables import table


def in_camera(x: list[Column], r: Column = None, t: Column = None) -> list[Column]:
    """World coordinates to a camera's."""
    r, t = F.col("r") if r is None else r, F.col("t") if t is None else t
    return [sum((F.get(r, 3 * i + k) * x[k] for k in range(3)), F.get(t, i)) for i in range(3)]


def on_picture(p: list[Column], least: float = 1e-9) -> tuple[Column, Column]:
    """Pixels of a place in camera coordinates; null at or behind the camera."""
    z = F.when(p[2] > least, p[2])
    return F.col("fx") * p[0] / z + F.col("cx"), F.col("fy") * p[1] / z + F.col("cy")


def reprojections(observations: DataFrame, poses: DataFrame, points: DataFrame, cameras: DataFrame) -> DataFrame:
    """observations (frame, point, u, v), poses (frame, camera, r, t), points (point, component, x, y, z), cameras (camera, fx, fy, cx, cy) ->
    frame, point, component, error in pixels, infinite at or behind the camera. Observations of a frame without a pose or of an unknown point are none."""
    o = observations.join(poses, "frame").join(points, "point").join(cameras, "camera")
    u, v = on_picture(in_camera([F.col(c) for c in "xyz"]))
    e = F.sqrt(F.pow(u - F.col("u"), 2) + F.pow(v - F.col("v"), 2))
    return o.select("frame", "point", "component", F.coalesce(e, F.lit(float("inf"))).alias("error"))


def reprojection_stats(errors: DataFrame, limit: float = 3.0) -> DataFrame:
    """reprojections' rows -> a row a component and one for all (component null, overall true): count, median, p95, p99 and max of the finite errors, share
    over the limit, and how many are behind the camera. A component all behind it has no row but counts in the whole.

    Percentiles are linear between ranks. They come from counts of distinct errors by blocks of values, so no task holds a component's errors.
    """
    both = errors.withColumn("overall", F.lit(False)).unionByName(errors.withColumn("overall", F.lit(True)).withColumn("component", F.lit(None).cast(errors.schema["component"].dataType)))
    key = F.when(F.col("overall"), F.lit("*")).otherwise(F.concat(F.lit("c"), F.coalesce(F.col("component").cast("string"), F.lit(""))))
    both = both.withColumn("g", key)
    fine = both.where(F.col("error") < float("inf"))
    whole = both.groupBy("g", "overall", "component").agg(F.count_if(F.col("error") == float("inf")).alias("behind"), F.count_if(F.col("error") < float("inf")).alias("count"), F.max(F.when(F.col("error") < float("inf"), F.col("error"))).alias("max"), F.avg(F.when(F.col("error") < float("inf"), (F.col("error") > limit).cast("int"))).alias("over")).where("count > 0")
    counts = cut(fine.groupBy("g", "error").agg(F.count("*").alias("n")), "errors")
    for name, share in (("median", 0.5), ("p95", 0.95), ("p99", 0.99)):
        low, high = (percentile_at(counts, share, up).select(F.col("group").alias("g"), F.col("value").alias(f"_{k}")) for k, up in (("a", False), ("b", True)))
        spot = share * (F.col("count") - 1)
        whole = whole.join(low, "g").join(high, "g").withColumn(name, F.col("_a") + (F.col("_b") - F.col("_a")) * (spot - F.floor(spot))).drop("_a", "_b")
    return whole.drop("g")


def percentile_at(counts: DataFrame, share: float, up: bool) -> DataFrame:
    """counts (g, error, n) -> group, value at the rank below or above share of the way from the first to the last."""
    return percentile_by_rank(counts, "g", "error", low=True, share=share, rank=lambda n: 1 + (F.ceil(share * (n - 1)) if up else F.floor(share * (n - 1))))


def landmark_checks(landmarks: DataFrame, observations: DataFrame, poses: DataFrame, points: DataFrame, cameras: DataFrame, least_angle: float, most_px: float = 3.0) -> DataFrame:
    """landmarks (point, a, b: its two frames) and the tables of reprojections -> point, angle, error, reason: low_parallax first, then high_reprojection, null if
    kept. The angle is between the rays from both camera centres; a landmark that isn't seen from both frames, or is behind one, has no small error."""
    e = reprojections(observations, poses, points, cameras)
    centre = F.array(*(-sum(F.get("r", 3 * k + i) * F.get("t", k) for k in range(3)) for i in range(3)))
    c = poses.select("frame", centre.alias("c"))
    j = landmarks.join(points.select("point", "x", "y", "z"), "point")
    for k in "ab":
        j = j.join(c.select(F.col("frame").alias(k), F.col("c").alias(f"c{k}")), k).join(e.select(F.col("frame").alias(k), "point", F.col("error").alias(f"e{k}")), [k, "point"], "left")
    ray = {k: [F.get(f"c{k}", i) - F.col(x) for i, x in enumerate("xyz")] for k in "ab"}
    norm = lambda v: F.sqrt(sum(x * x for x in v))
    both = norm(ray["a"]) * norm(ray["b"])
    cosine = sum(p * q for p, q in zip(ray["a"], ray["b"])) / F.when(both > 0, both)
    angle = F.coalesce(F.degrees(F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0)))), F.lit(0.0))
    worst = F.greatest(F.coalesce("ea", F.lit(float("inf"))), F.coalesce("eb", F.lit(float("inf"))))
    j = j.select("point", angle.alias("angle"), worst.alias("error"))
    return j.withColumn("reason", F.when(F.col("angle") < least_angle, "low_parallax").when(F.col("error") > most_px, "high_reprojection"))


def multi_view_agreement(points: DataFrame, neighbours: DataFrame, poses: DataFrame, cameras: DataFrame, depths: DataFrame, tau: float = 0.05, least: int = 2, tile: int = 64) -> DataFrame:
    """points (id, frame, x, y, z), neighbours (frame, other), poses, cameras, depths (frame, u, v, depth: whole pixels) -> id, agree, and the mean place of
    the point and of what agreeing views say, for points that at least `least` views agree with.

    A point is projected into each neighbour; in front of it and inside the picture it falls on the nearest pixel, whose depth agrees if it is
    within tau of the predicted one, relative to it. Pixels meet depths by frame and image tile, so a frame's picture is many keys, not one.
    """
    seen = points.join(neighbours, "frame").join(poses.withColumnRenamed("frame", "other"), "other").join(cameras, "camera")
    p = in_camera([F.col(c) for c in "xyz"])
    u, v = on_picture(p, 1e-3)
    seen = seen.withColumn("_z", p[2]).withColumn("_u", u).withColumn("_v", v).where("_u >= 0 AND _v >= 0 AND _u < w - 1 AND _v < h - 1")
    pixel = lambda c: F.bround(c, 0).cast("long")
    seen = seen.withColumn("u", pixel(F.col("_u"))).withColumn("v", pixel(F.col("_v")))
    tiles = lambda df, frame: df.withColumn("_tile", F.concat_ws(",", F.floor(F.col("u") / tile), F.floor(F.col("v") / tile))).withColumn("_frame", F.col(frame))
    hit = tiles(seen, "other").join(tiles(depths.where("depth IS NOT NULL AND NOT isnan(depth)"), "frame").drop("frame"), ["_frame", "_tile", "u", "v"])
    hit = hit.where(F.abs(F.col("depth") - F.col("_z")) / F.greatest("_z", F.lit(1e-6)) < tau)
    own = [(F.col("u") + 0.5 - F.col("cx")) / F.col("fx") * F.col("depth") - F.get("t", 0), (F.col("v") + 0.5 - F.col("cy")) / F.col("fy") * F.col("depth") - F.get("t", 1), F.col("depth") - F.get("t", 2)]
    back = [sum(F.get("r", 3 * k + i) * own[k] for k in range(3)) for i in range(3)]
    out = hit.groupBy("id").agg(F.count("*").alias("agree"), *(F.sum(b).alias(f"_{c}") for b, c in zip(back, "xyz"))).where(F.col("agree") >= least)
    return points.join(out, "id").select("id", "agree", *(((F.col(c) + F.col(f"_{c}")) / (1 + F.col("agree"))).alias(c) for c in "xyz"))


def nearest(points: DataFrame, k: int, size: float | None = None, rings: int = 40) -> DataFrame:
    """points (g, id, x, y, z) -> g, id, other, d2, place: of each point of a group its k nearest others by squared distance, the smaller id of equal ones.

    Points lie in cells of the grid `size`; in round n a point looks into the shell of cells n away, and it is done when it has k others nearer than
    n times the size, as what is farther out can't be nearer. Cells double where a round ends with points still open, so rounds grow
    with the logarithm of a group's extent; a point with fewer than k others in its group ends at its extent.
    """
    pts = points.select("g", "id", *(F.col(c).cast("double").alias(c) for c in "xyz"))
    box = pts.groupBy("g").agg(F.count("*").alias("_n"), F.greatest(*(F.max(c) - F.min(c) for c in "xyz")).alias("_wide"))
    # about k points a cell, were they spread evenly over a plane of the group's width
    grid = box.withColumn("_size", F.lit(float(size)) if size else F.greatest(F.col("_wide") / F.greatest(F.sqrt(F.col("_n") / k), F.lit(1.0)), F.lit(1e-9)))
    grid = grid.withColumnRenamed("g", "_h")
    pts = cut(pts.join(grid, F.col("g").eqNullSafe(F.col("_h"))).select("g", "id", *"xyz", "_n", "_wide", "_size"), "points")
    key = lambda scale: [F.floor(F.col(c) / (F.col("_size") * scale)).alias(f"_{c}") for c in "xyz"]
    open_, done, scale = pts, [], 1.0
    around = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1))))
    for _ in range(rings):
        probe = open_.select("*", *key(scale), around.alias("_m")).select("*", *((F.col(f"_{c}") + F.col(f"_m.{m}")).alias(f"_k{c}") for c, m in zip("xyz", "abc")))
        there = pts.select(F.col("g").alias("_g"), F.col("id").alias("other"), *(F.col(c).alias(f"o{c}") for c in "xyz"), *key(scale))
        there = there.select("_g", "other", "ox", "oy", "oz", *(F.col(f"_{c}").alias(f"_k{c}") for c in "xyz"))
        near = probe.join(there, ["_kx", "_ky", "_kz"]).where(F.col("g").eqNullSafe(F.col("_g")) & (F.col("id") != F.col("other")))
        near = near.select("g", "id", "other", "_n", "_wide", "_size", sum(F.pow(F.col(c) - F.col(f"o{c}"), 2) for c in "xyz").alias("d2"))
        near = near.selectExpr("*", "row_number() OVER (PARTITION BY g, id ORDER BY d2, other) AS place").where(F.col("place") <= k)
        sure = F.col("d2") < F.pow(F.col("_size") * scale, 2)  # within one cell's width: no nearer one is outside the 27 cells
        near = cut(near.withColumn("_sure", sure | (F.col("_wide") <= F.col("_size") * scale)), "near")
        state = near.groupBy("g", "id").agg(F.count_if("_sure").alias("c"), F.max("_n").alias("m"), F.max((F.col("_wide") <= F.col("_size") * scale).cast("int")).alias("whole"))
        ready = state.where((F.col("c") >= k) | (F.col("whole") == 1)).select("g", "id")
        done.append(_semi(near, ready).select("g", "id", "other", "d2", "place"))
        alone = F.col("_wide") <= F.col("_size") * scale
        left = cut(_anti(open_.where(~alone), ready), "open")
        if left.isEmpty():
            out = done[0]
            for d in done[1:]:
                out = out.unionByName(d)
            return out
        open_, scale = left, scale * 2
    raise RuntimeError(f"points are still open after {rings} doublings of the cells")


def _semi(df: DataFrame, keys: DataFrame) -> DataFrame:
    k = keys.select(F.col("g").alias("_h"), F.col("id").alias("_i"))
    return df.join(k, F.col("g").eqNullSafe(F.col("_h")) & (F.col("id") == F.col("_i")), "left_semi")


def _anti(df: DataFrame, keys: DataFrame) -> DataFrame:
    k = keys.select(F.col("g").alias("_h"), F.col("id").alias("_i"))
    return df.join(k, F.col("g").eqNullSafe(F.col("_h")) & (F.col("id") == F.col("_i")), "left_anti")


def shared_counts(support: DataFrame, heavy: int = 64) -> DataFrame:
    """support (point, frame) -> frame, other, shared: of every two frames, both ways, how many points both hold.

    Points of few frames are joined by point. A point of more than `heavy` frames is dealt: its frames lie in blocks of `heavy`, and each pair
    of blocks is a key of its own, so that a point of n frames is (n / heavy)^2 keys of heavy^2 pairs, wherever it lies. Pairs add up before the shuffle.
    """
    s = support.where("point IS NOT NULL AND frame IS NOT NULL").distinct()
    n = s.groupBy("point").agg(F.count("*").alias("_n"))
    s = cut(s.join(n, "point").where("_n > 1"), "support")
    light = s.where(F.col("_n") <= heavy)
    pairs = light.select("point", "frame").join(light.select("point", F.col("frame").alias("other")), "point").where("frame < other").select("frame", "other")
    many = s.where(F.col("_n") > heavy).withColumn("_blocks", F.ceil(F.col("_n") / heavy)).withColumn("_b", F.pmod(F.xxhash64("frame"), F.col("_blocks")))
    left = many.withColumn("_c", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).select("point", "_b", "_c", "frame")
    right = many.withColumn("_a", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).select("point", F.col("_a").alias("_b"), F.col("_b").alias("_c"), F.col("frame").alias("other"))
    pairs = pairs.union(left.join(right, ["point", "_b", "_c"]).where("frame < other").select("frame", "other"))
    half = cut(pairs.groupBy("frame", "other").agg(F.count("*").alias("shared")), "shared")
    drop(s)
    return half.union(half.select("other", "frame", "shared"))


def overlaps(tracks: DataFrame, detections: DataFrame, least: float = 0.25, tile: float = 64.0) -> DataFrame:
    """tracks (frame, track, label, x0, y0, x1, y1), detections (frame, detection, label, x0, ...) -> frame, track, detection, iou of those of one frame and
    label whose boxes overlap by at least `least` of their union.

    Boxes go to the tiles they touch, and a pair belongs to the tile of the upper left corner of what they share, so it is found once and
    a crowded frame is many keys. Boxes without an area overlap nothing.
    """
    def spread(df: DataFrame, k: str) -> DataFrame:
        d = df.where("x1 > x0 AND y1 > y0").select("frame", "label", k, *(F.col(c).alias(f"{k[0]}{c}") for c in ("x0", "y0", "x1", "y1")))
        cells = lambda a: F.sequence(F.floor(F.col(f"{k[0]}{a}0") / tile), F.floor(F.col(f"{k[0]}{a}1") / tile))
        return d.withColumn("_i", F.explode(cells("x"))).withColumn("_j", F.explode(cells("y")))

    j = spread(tracks, "track").join(spread(detections, "detection"), ["frame", "label", "_i", "_j"])
    x0, y0, x1, y1 = F.greatest("tx0", "dx0"), F.greatest("ty0", "dy0"), F.least("tx1", "dx1"), F.least("ty1", "dy1")
    j = j.where((x1 > x0) & (y1 > y0) & (F.floor(x0 / tile) == F.col("_i")) & (F.floor(y0 / tile) == F.col("_j")))
    both = (x1 - x0) * (y1 - y0)
    area = lambda k: (F.col(f"{k}x1") - F.col(f"{k}x0")) * (F.col(f"{k}y1") - F.col(f"{k}y0"))
    return j.select("frame", "label", "track", "detection", (both / (area("t") + area("d") - both)).alias("iou")).where(F.col("iou") >= least)


def assigned(tracks: DataFrame, detections: DataFrame, least: float = 0.25) -> DataFrame:
    """The tables of overlaps -> frame, track, detection: in each frame as many pairs as possible, of these the most overlap, every track and detection once; ties by number.

    A pair whose track and detection overlap nothing else is taken as it is. Other frames' candidates are lists of their own, as long as what overlaps in them.
    """
    pairs = overlaps(tracks, detections, least).selectExpr("*", "count(*) OVER (PARTITION BY frame, track) AS _a", "count(*) OVER (PARTITION BY frame, detection) AS _b")
    crowd = pairs.groupBy("frame").agg(F.collect_list(F.when((F.col("_a") > 1) | (F.col("_b") > 1), F.struct(F.col("track").cast("long").alias("track"), F.col("detection").cast("long").alias("detection"), "iou"))).alias("l"), F.collect_list(F.when((F.col("_a") == 1) & (F.col("_b") == 1), F.struct(F.col("track").cast("long").alias("track"), F.col("detection").cast("long").alias("detection")))).alias("sure"))

    chosen = F.concat("sure", F.when(F.size("l") > 0, best_pairs("l")).otherwise(F.slice("sure", 1, 0)))
    return crowd.select("frame", F.explode(chosen).alias("p")).select("frame", "p.*")



# ---- bindings

_AT = lambda i: f"CAST(embedding[{i}] AS DOUBLE)"


def _scene(s, d):
    """observations, poses, points, cameras: vectors as points, labels as frames that turn about z; every fifth stands before the points."""
    e = table(s, d, "embeddings").selectExpr("vec_id AS point", "CAST(label AS BIGINT) AS frame", *(f"{_AT(i)} AS {c}" for i, c in enumerate("xyz")))
    turn = "CAST(frame AS DOUBLE) * 0.05"
    poses = e.select("frame").distinct().selectExpr("frame", "frame % 3 AS camera", f"array(cos({turn}), -sin({turn}), 0D, sin({turn}), cos({turn}), 0D, 0D, 0D, 1D) AS r", "array(frame * 0.01D, 0D, 2D - frame % 5 * 0.5D) AS t").where("frame % 11 <> 10")
    cameras = s.createDataFrame([(k, 500.0 + 10 * k, 480.0, 320.0, 240.0, 640, 480) for k in range(3)], "camera long, fx double, fy double, cx double, cy double, w int, h int")
    seen = e.selectExpr("explode(array(frame, frame + 1)) AS frame", "point", "320 + 250 * x AS u", "240 + 245 * y AS v")
    return seen, poses, e.selectExpr("point", "point % 4 AS component", "x", "y", "z"), cameras


_D_SCENE = """e AS (SELECT vec_id AS point, label AS f, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings), fr AS (SELECT DISTINCT f FROM e WHERE f % 11 <> 10),
ob AS (SELECT e.*, e.f + k AS o FROM e, (VALUES (0), (1)) n(k) WHERE e.f + k IN (SELECT f FROM fr)),
pj AS (SELECT point, f, o, x, y, z, cos(o * 0.05) * x - sin(o * 0.05) * y + o * 0.01 AS px, sin(o * 0.05) * x + cos(o * 0.05) * y AS py, z + 2 - o % 5 * 0.5 AS pz FROM ob),
er AS (SELECT point, f, o, pz, CASE WHEN pz > 1e-9 THEN sqrt(((500 + 10 * (o % 3)) * px / pz - 250 * x) ** 2 + (480 * py / pz - 245 * y) ** 2) END AS err FROM pj)"""


def _coarse(s, d):
    """A picture of 40 x 30 pixels a frame: of the points in each pixel the nearest one's depth, off by up to four per cent."""
    _, poses, points, _ = _scene(s, d)
    cameras = s.createDataFrame([(k, 20.0, 20.0, 20.0, 15.0, 40, 30) for k in range(3)], "camera long, fx double, fy double, cx double, cy double, w int, h int")
    own = table(s, d, "embeddings").selectExpr("vec_id AS id", "CAST(label AS BIGINT) AS frame", *(f"{_AT(i)} AS {c}" for i, c in enumerate("xyz")))
    p = own.join(poses, "frame").join(cameras, "camera")
    at = in_camera([F.col(c) for c in "xyz"])
    u, v = on_picture(at)
    depths = p.select("frame", F.bround(u, 0).cast("long").alias("u"), F.bround(v, 0).cast("long").alias("v"), (at[2] * (1 + (F.col("id") % 5 - 2) * 0.02)).alias("depth")).where("u IS NOT NULL").groupBy("frame", "u", "v").agg(F.min("depth").alias("depth"))
    near = own.select("frame").distinct().selectExpr("frame", "explode(array(frame + 1, frame + 2, frame + 3)) AS other")
    return multi_view_agreement(own, near, poses, cameras, depths, 0.05, 1, 16).selectExpr("id", "agree", *(f"round({c}, 6) AS {c}" for c in "xyz"))


def _boxes(s, d, kind):
    """The lines of an order as boxes of a frame; of three labels."""
    l = table(s, d, "lineitem").selectExpr("l_orderkey AS frame", "l_linenumber AS n", "l_returnflag AS label", "CAST(l_partkey AS DOUBLE) AS x0", "CAST(l_suppkey AS DOUBLE) AS y0", "CAST(l_quantity AS DOUBLE) AS w").groupBy("frame", "n").agg(F.min(F.struct("label", "x0", "y0", "w")).alias("b")).select("frame", "n", "b.*")
    moved = "0" if kind == "track" else "n % 3"
    return l.selectExpr("frame", f"CAST(n AS BIGINT) AS {kind}", "label", f"x0 + {moved} AS x0", "y0", f"x0 + {moved} + w AS x1", f"y0 + w / 2 - {moved} AS y1")


OPS = {
    "reprojection_stats": (
        lambda s, d: (lambda o, p, x, c: reprojection_stats(reprojections(o, p, x, c)).selectExpr("overall", "component", "count", "behind", *(f"round({k}, 6) AS {k}" for k in ("median", "p95", "p99", "max", "over"))))(*_scene(s, d)),
        f"""WITH {_D_SCENE}, g AS (SELECT false AS overall, point % 4 AS component, err FROM er UNION ALL SELECT true, NULL, err FROM er)
            SELECT overall, component, count(err) AS count, count(*) - count(err) AS behind, round(quantile_cont(err, 0.5), 6) AS median, round(quantile_cont(err, 0.95), 6) AS p95, round(quantile_cont(err, 0.99), 6) AS p99, round(max(err), 6) AS max, round(avg((err > 3)::INT), 6) AS over FROM g GROUP BY 1, 2 HAVING count(err) > 0""",
    ),
    "landmark_gate": (
        lambda s, d: (lambda o, p, x, c: landmark_checks(table(s, d, "embeddings").selectExpr("vec_id AS point", "CAST(label AS BIGINT) AS a", "CAST(label AS BIGINT) + 1 AS b"), o, p, x, c, 0.5, 12.0).selectExpr("point AS vec_id", "reason"))(*_scene(s, d)),
        f"""WITH {_D_SCENE}, c AS (SELECT f, -(cos(f * 0.05) * f * 0.01) AS cx, sin(f * 0.05) * f * 0.01 AS cy, -(2 - f % 5 * 0.5) AS cz FROM fr), l AS (SELECT e.point, e.x - a.cx AS ax, e.y - a.cy AS ay, e.z - a.cz AS az, e.x - b.cx AS bx, e.y - b.cy AS by_, e.z - b.cz AS bz, e.f FROM e JOIN c a ON a.f = e.f JOIN c b ON b.f = e.f + 1),
            g AS (SELECT l.point, degrees(acos(greatest(-1, least(1, (ax * bx + ay * by_ + az * bz) / sqrt((ax * ax + ay * ay + az * az) * (bx * bx + by_ * by_ + bz * bz)))))) AS angle, greatest(coalesce(p.err, 'inf'::DOUBLE), coalesce(q.err, 'inf'::DOUBLE)) AS err FROM l LEFT JOIN er p ON p.point = l.point AND p.o = l.f LEFT JOIN er q ON q.point = l.point AND q.o = l.f + 1)
            SELECT point AS vec_id, CASE WHEN angle < 0.5 THEN 'low_parallax' WHEN err > 12 THEN 'high_reprojection' END AS reason FROM g""",
    ),
    "multi_view_agreement": (
        _coarse,
        """WITH e AS (SELECT vec_id AS id, label AS f, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings), fr AS (SELECT DISTINCT f, cos(f * 0.05) AS c, sin(f * 0.05) AS s, f * 0.01::DOUBLE AS tx, 2 - f % 5 * 0.5 AS tz FROM e WHERE f % 11 <> 10),
           own AS (SELECT id, fr.f, round_even(20 * (c * x - s * y + tx) / (z + tz) + 20, 0)::BIGINT AS u, round_even(20 * (s * x + c * y) / (z + tz) + 15, 0)::BIGINT AS v, (z + tz) * (1 + (id % 5 - 2) * 0.02::DOUBLE) AS depth FROM e JOIN fr USING (f) WHERE z + tz > 1e-9), dp AS (SELECT f, u, v, min(depth) AS depth FROM own GROUP BY ALL),
           pr AS (SELECT id, fr.*, 20 * (c * x - s * y + tx) / (z + tz) + 20 AS u, 20 * (s * x + c * y) / (z + tz) + 15 AS v, z + tz AS pz FROM e, fr WHERE fr.f BETWEEN e.f + 1 AND e.f + 3 AND z + tz > 1e-3),
           hit AS (SELECT pr.*, depth, (dp.u + 0.5 - 20) / 20 * depth - tx AS ox, (dp.v + 0.5 - 15) / 20 * depth AS oy FROM pr JOIN dp ON dp.f = pr.f AND dp.u = round_even(pr.u, 0) AND dp.v = round_even(pr.v, 0) WHERE pr.u >= 0 AND pr.u < 39 AND pr.v >= 0 AND pr.v < 29 AND abs(depth - pz) / pz < 0.05),
           m AS (SELECT id, count(*) AS n, sum(c * ox + s * oy) AS sx, sum(c * oy - s * ox) AS sy, sum(depth - tz) AS sz FROM hit GROUP BY id) SELECT id, n AS agree, round((x + sx) / (n + 1), 6) AS x, round((y + sy) / (n + 1), 6) AS y, round((z + sz) / (n + 1), 6) AS z FROM m JOIN e USING (id)""",
    ),
    "knn_neighbours": (
        lambda s, d: nearest(table(s, d, "embeddings").selectExpr("vec_id % 3 AS g", "vec_id AS id", *(f"{_AT(i)} AS {c}" for i, c in enumerate("xyz"))), 4).selectExpr("id", "other", "place", "round(d2, 6) AS d2"),
        """WITH e AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings), p AS (SELECT a.vec_id AS id, b.vec_id AS other, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 AS d FROM e a JOIN e b ON a.vec_id % 3 = b.vec_id % 3 AND a.vec_id <> b.vec_id)
           SELECT id, other, place, round(d, 6) AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS place FROM p) x WHERE place <= 4""",
    ),
    "iou_candidates": (
        lambda s, d: overlaps(_boxes(s, d, "track"), _boxes(s, d, "detection")).selectExpr("frame", "track", "detection", "round(1 + iou, 6) AS weight"),
        """WITH l AS (SELECT l_orderkey AS frame, l_linenumber AS n, l_returnflag AS label, l_partkey AS x, l_suppkey AS y, l_quantity::DOUBLE AS w FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_returnflag, l_partkey, l_suppkey, l_quantity) = 1),
           p AS (SELECT a.frame, a.n AS track, b.n AS detection, greatest(0, least(a.x + a.w, b.x + b.n % 3 + b.w) - greatest(a.x, b.x + b.n % 3)) * greatest(0, least(a.y + a.w / 2, b.y + b.w / 2 - b.n % 3) - greatest(a.y, b.y)) AS both_, a.w * a.w / 2 AS sa, b.w * (b.w / 2 - b.n % 3) AS sb FROM l a JOIN l b ON a.frame = b.frame AND a.label = b.label WHERE b.w / 2 > b.n % 3)
           SELECT frame, track::BIGINT AS track, detection::BIGINT AS detection, round(1 + both_ / (sa + sb - both_), 6) AS weight FROM p WHERE both_ / (sa + sb - both_) >= 0.25""",
    ),
    "iou_association": (lambda s, d: assigned(_boxes(s, d, "track"), _boxes(s, d, "detection")), None),
}
