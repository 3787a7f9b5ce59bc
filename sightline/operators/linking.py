"""Joins, graphs and meshes over their own columns, bound to the driver's tables; oracles are texts of their own."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.arrays import observation_id

from . import graphs
from .graphs import cut, drop
from .tables import events, table
from .views import shared_counts


def lookup_by_derived_id(rows: DataFrame, wanted: DataFrame, cutoff: float) -> DataFrame:
    """rows (session, label, observed_at, recorded_at), wanted (id, and other columns) -> wanted with found and observed_at: by the id computed from a
    row's session, class and time, inside retention only; of several rows of one id the first recorded one."""
    live = rows.where(F.coalesce(F.col("recorded_at") >= cutoff, F.lit(False))).select(observation_id(F.col("session").cast("string"), "label", F.col("observed_at").cast("double")).alias("_id"), "observed_at", "recorded_at")
    first = live.groupBy("_id").agg(F.min_by("observed_at", "recorded_at").alias("observed_at"))
    return wanted.join(first, F.col("id") == F.col("_id"), "left").withColumn("found", F.col("_id").isNotNull()).drop("_id")


def trajectory(keyframes: DataFrame, poses: DataFrame) -> DataFrame:
    """keyframes (world, pos, id), poses (id, status, x, y, z) -> all keyframes in journal order; a place only where the pose is solved or an anchor and has one."""
    usable = F.col("status").isin("solved", "anchor") & F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()
    out = keyframes.join(poses, "id", "left")
    return out.select("world", F.expr("row_number() OVER (PARTITION BY world ORDER BY pos, id)").alias("place"), "id", *(F.when(usable, F.col(c)).alias(c) for c in "xyz"))


def point_owner(observations: DataFrame, frames: DataFrame) -> DataFrame:
    """observations (point, frame), frames (frame, segment, component, posed, in_horizon) -> point, frame, segment, component, anchor, mode.

    A point belongs to its first frame. Its segment counts only if all of the segment's frames are in the horizon (else
    pending) and one of them has a pose (else refused); a segment's component is that of most of its frames, the lowest of
    equal ones; its anchor the first posed frame.
    """
    own = observations.groupBy("point").agg(F.min("frame").alias("frame"))
    per = frames.groupBy("segment").agg(F.bool_and("in_horizon").alias("whole"), F.min(F.when(F.col("posed"), F.col("frame"))).alias("anchor"))
    votes = frames.where("component IS NOT NULL").groupBy("segment", "component").agg(F.count("*").alias("n")).groupBy("segment").agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("majority"))
    seg = per.join(votes, "segment", "left")
    mode = F.when(~F.col("whole"), "pending").when(F.col("anchor").isNull(), "refused").otherwise("replaced")
    out = own.join(frames.select("frame", "segment"), "frame").join(seg, "segment").withColumn("mode", mode)
    good = F.col("mode") == "replaced"
    return out.select("point", "frame", F.when(good, F.col("segment")).alias("segment"), F.when(good, F.col("majority")).alias("component"), F.when(good, F.col("anchor")).alias("anchor"), "mode")


def capture_lineage(captures: DataFrame, max_rounds: int = 40) -> DataFrame:
    """captures (id, continues) -> id, head, pos, cyclic: the walk each belongs to and its place there.

    Of several captures that continue one, the smallest id does. Pointers double each round, so a walk of n captures
    takes log2(n) joins; one that bites its own tail has no head and is cyclic, its smallest id standing for it. A round takes
    along and writes only captures whose head isn't known yet.
    """
    first = captures.where("continues IS NOT NULL AND continues <> id").groupBy("continues").agg(F.min("id").alias("next")).select(F.col("next").alias("id"), F.col("continues").alias("up"))
    known = captures.select("id").distinct()
    first = first.join(known.withColumnRenamed("id", "up"), "up", "left_semi")
    at = cut(known.join(first, "id", "left").select("id", "up", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("steps"), F.least("id", "up").alias("low"), F.coalesce("up", "id").alias("head")), "lineage")
    n, columns = at.count(), ["id", "up", "steps", "low", "head"]
    settled, open_ = at.where("up IS NULL").select(columns), at.where("up IS NOT NULL").select(columns)
    for k in range(max_rounds):
        if 2**k > n or open_.isEmpty():
            break
        above = settled.unionByName(open_).select(F.col("id").alias("_u"), F.col("up").alias("_up"), F.col("steps").alias("_s"), F.col("low").alias("_low"), F.col("head").alias("_h"))
        joined = open_.join(above, F.col("up") == F.col("_u"))
        moved = cut(joined.select("id", F.col("_up").alias("up"), (F.col("steps") + F.col("_s")).alias("steps"), F.least("low", "_low").alias("low"), F.col("_h").alias("head")), "lineage")
        settled, open_ = settled.unionByName(moved.where("up IS NULL")), moved.where("up IS NOT NULL")
    at = settled.unionByName(open_)
    cyclic = F.col("up").isNotNull()
    return at.select("id", F.when(cyclic, F.col("low")).otherwise(F.col("head")).alias("head"), F.when(~cyclic, F.col("steps")).alias("pos"), cyclic.alias("cyclic"))


def frame_resolution(asked: DataFrame, lineage: DataFrame, held: DataFrame) -> DataFrame:
    """asked (capture, seq, best), lineage (id, head, pos), held (capture, path) -> path: the first of the walk's captures, from the
    asked one on, that holds the best look, else the frame's own name, at least eight digits wide."""
    l = lineage.where("NOT cyclic").select("id", "head", "pos")
    a = asked.join(l, asked.capture == l.id, "left").drop("id")
    h = held.join(l, held.capture == l.id).select(F.col("capture").alias("holder"), F.col("path").alias("_path"), F.col("head").alias("_head"), F.col("pos").alias("_pos"))
    hits = a.join(h, (F.col("head") == F.col("_head")) & (F.col("best") == F.col("_path")) & (F.col("_pos") >= F.col("pos")), "left")
    best = hits.groupBy("capture", "seq").agg(F.min_by(F.struct("holder", "_path"), "_pos").alias("b"))
    return best.select("capture", "seq", F.coalesce(F.concat(F.col("b.holder").cast("string"), F.lit("/"), F.col("b._path")), F.concat(F.lit("frames/"), F.when(F.col("seq").isNotNull(), F.format_string("%08d", "seq")), F.lit(".jpg"))).alias("path"))


def ab_compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, b (prefix, segments, keyframes, solved, points) -> deltas and verdict: refused if the runs cover other captures, else
    VOID for all if segments or keyframes moved anywhere, else ok."""
    r = lambda df, k: df.select("prefix", *(F.col(c).alias(f"{c}_{k}") for c in ("segments", "keyframes", "solved", "points")))
    j = r(a, "a").join(r(b, "b"), "prefix", "full")
    moved = (F.col("segments_a") != F.col("segments_b")) | (F.col("keyframes_a") != F.col("keyframes_b"))
    whole = j.agg(F.bool_or(F.col("segments_a").isNull() | F.col("segments_b").isNull()).alias("apart"), F.bool_or(moved).alias("moved"))
    out = j.crossJoin(F.broadcast(whole))  # one row
    verdict = F.when(F.col("apart"), "refused").when(F.col("moved"), "VOID").otherwise("ok")
    return out.select("prefix", F.when(verdict != "refused", F.col("solved_b") - F.col("solved_a")).alias("solved"), F.when(verdict != "refused", F.col("points_b") - F.col("points_a")).alias("points"), moved.alias("moved"), verdict.alias("verdict"))


def covisibility_topk(support: DataFrame, k_top: int, k_loop: int, least: int, loop_gap: int, skip: int = 0) -> DataFrame:
    """support (point, frame), frames numbered in time -> frame, other: of each frame its k_top partners with most shared points, at
    least `least`, and the k_loop best of those at least loop_gap frames away; `skip` leaves out the first of each list."""
    n = shared_counts(support).where(F.col("shared") >= least)
    n = n.withColumn("far", F.abs(F.col("frame") - F.col("other")) >= loop_gap)
    n = n.selectExpr("*", "row_number() OVER (PARTITION BY frame ORDER BY shared DESC, other) AS k", "row_number() OVER (PARTITION BY frame, far ORDER BY shared DESC, other) AS z")
    return n.where(F.col("k").between(skip + 1, skip + k_top) | (F.col("far") & F.col("z").between(skip + 1, skip + k_loop))).select("frame", "other", "shared")


def cross_budget(na: Column, nb: Column, budget: int, floor: int) -> tuple[Column, Column]:
    """How many of na and nb rows are taken, so that their product is within the budget: the larger side gives way until it equals the other, then
    both in turn, the first of equal ones first; neither falls below min(its rows, floor)."""
    low, high, root = F.least(na, nb), F.greatest(na, nb), math.isqrt(budget)
    cut_high = F.least(high, F.greatest(F.least(high, F.lit(floor)), F.floor(F.lit(budget) / low)))  # while the smaller side's square fits
    one_more = root + (root * (root + 1) <= budget)
    fits, square = na * nb <= budget, low <= root
    a = F.when(fits, na).when(square & (na >= nb), cut_high).when(square, na).otherwise(F.greatest(F.lit(root), F.least(na, F.lit(floor))))
    b = F.when(fits, nb).when(square & (na >= nb), nb).when(square, cut_high).otherwise(F.greatest(F.lit(one_more), F.least(nb, F.lit(floor))))
    return a.cast("long"), b.cast("long")


def sampled_cross_product(frames: DataFrame, pairs: DataFrame, budget: int = 256, floor: int = 8) -> DataFrame:
    """frames (segment, pos), pairs (a, b) -> a, b, frame_a, frame_b: evenly spread samples of both sides, ends included, whose product is within the budget.

    The larger side gives way first, neither below min(its frames, floor). So both end equal, or one whole and the other cut.
    """
    n = frames.groupBy("segment").agg(F.count("*").alias("n"))
    p = pairs.join(n.selectExpr("segment AS a", "n AS na"), "a").join(n.selectExpr("segment AS b", "n AS nb"), "b")
    ta, tb = cross_budget(F.col("na"), F.col("nb"), budget, floor)
    p = p.withColumn("ta", ta).withColumn("tb", tb)
    at = lambda n, t: F.when(F.col(n) <= F.col(t), F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(0), F.col(t) - 1), lambda i: F.bround(i * (F.col(n) - 1) / F.greatest(F.col(t) - 1, F.lit(1)), 0).cast("long"))))
    p = p.select("a", "b", F.explode(at("na", "ta")).alias("ia"), at("nb", "tb").alias("l")).select("a", "b", "ia", F.explode("l").alias("ib"))
    f = frames.selectExpr("segment", "pos", "row_number() OVER (PARTITION BY segment ORDER BY pos) - 1 AS i")
    return p.join(f.selectExpr("segment AS a", "i AS ia", "pos AS frame_a"), ["a", "ia"]).join(f.selectExpr("segment AS b", "i AS ib", "pos AS frame_b"), ["b", "ib"]).select("a", "b", "frame_a", "frame_b")


def label_eval_join(counts: DataFrame, truths: DataFrame) -> DataFrame:
    """counts (frame, class, got), truths (frame, class, truth) -> labelled frames only: a class that one side lacks counts 0 there."""
    seen = truths.select("frame").distinct()
    return counts.join(seen, "frame", "left_semi").join(truths, ["frame", "class"], "full").select("frame", "class", F.coalesce("truth", F.lit(0)).alias("truth"), F.coalesce("got", F.lit(0)).alias("got"))


def _voxel(size: float) -> list[Column]:
    return [F.floor(F.col(c) / size).alias(f"i{c}") for c in "xyz"]


def redaction_consensus(votes: DataFrame, pixels: DataFrame, size: float, least: int) -> DataFrame:
    """votes (frame, x, y, z) of redacted places, pixels (id, x, y, z) -> the pixels whose voxel at least `least` frames voted for."""
    agreed = votes.select("frame", *_voxel(size)).groupBy("ix", "iy", "iz").agg(F.count_distinct("frame").alias("n")).where(F.col("n") >= least)
    return pixels.select("id", *_voxel(size)).join(agreed, ["ix", "iy", "iz"], "left_semi").select("id")


def placement_join(segments: DataFrame, placements: DataFrame, digests: DataFrame) -> DataFrame:
    """segments (world, segment), placements (world, segment, state, reference, digest, x), digests (world, digest) -> all segments; a
    transform only if it was solved against this build, is registered, and its reference is so too."""
    fresh = placements.join(digests.withColumnRenamed("digest", "_now"), "world").where(F.col("digest") == F.col("_now"))
    reg = fresh.where("state = 'registered'")
    good = reg.join(reg.select("world", F.col("segment").alias("reference")), ["world", "reference"], "left_semi").select("world", "segment", "x", "reference", F.lit(True).alias("_good"))
    return segments.join(good, ["world", "segment"], "left").select("world", "segment", "x", "reference", F.coalesce("_good", F.lit(False)).alias("placed"))


def calibration_lookup(frames: DataFrame, calibrations: DataFrame) -> DataFrame:
    """frames (id, w, h), calibrations (w, h, fx, fy, cx, cy) -> the calibration of exactly that size, or unknown: also if it is impossible; never rescaled."""
    c = calibrations.select(F.col("w").alias("_w"), F.col("h").alias("_h"), "fx", "fy", "cx", "cy")
    sane = (F.col("fx") > 0) & (F.col("fy") > 0) & F.col("cx").between(0, F.col("_w")) & F.col("cy").between(0, F.col("_h"))
    return frames.join(c, (F.col("w") == F.col("_w")) & (F.col("h") == F.col("_h")), "left").select("id", F.when(F.coalesce(sane, F.lit(False)), "known").otherwise("unknown").alias("state"), F.when(sane, F.col("fx")).alias("fx"))


def key_set_equality(a: DataFrame, b: DataFrame, prefix: int) -> DataFrame:
    """a, b (key) -> keys that one side lacks, and prefixes that don't stand for exactly one key of a."""
    left, right = a.select("key").distinct(), b.select("key").distinct()
    only = left.join(right, "key", "left_anti").select("key", F.lit("left").alias("problem")).union(right.join(left, "key", "left_anti").select("key", F.lit("right")))
    short = left.groupBy(F.substring("key", 1, prefix).alias("key")).agg(F.count("*").alias("n")).where("n > 1").select("key", F.lit("ambiguous").alias("problem"))
    return only.union(short)


# ---- graphs and meshes


def pair_admission(pairs: DataFrame) -> DataFrame:
    """Both directions' scale_*, cameras_*, span_*, ambiguity_*, reprojection_* (f, r) and rotation, the angle of both composed -> admitted, reason.

    Clauses in their order: collapsed scale, too few cameras, stood still, scales not reciprocal, orientation, ambiguous, reprojection.
    """
    c = F.col
    fin = lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))
    solved = F.coalesce(fin(c("scale_f")) & fin(c("scale_r")) & (c("scale_f") > 0) & (c("scale_r") > 0), F.lit(False))
    low, high = lambda k: F.least(f"{k}_f", f"{k}_r"), lambda k: F.greatest(f"{k}_f", f"{k}_r")
    reason = (
        F.when(~solved, "collapsed").when(low("cameras") < 3, "cameras").when(low("span") < 0.05, "stood still").when(F.abs(c("scale_f") * c("scale_r") - 1) > 0.15, "reciprocity")
        .when(c("rotation") > 10, "rotation").when(high("ambiguity") > 1.5, "ambiguous").when(high("reprojection") > 4, "reprojection")
    )
    return pairs.withColumn("admitted", reason.isNull()).withColumn("reason", reason)


def merge_references(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (node, points), edges -> component of each node, its lowest segment as reference, and its anchor: the one with most points, the lowest of equal ones."""
    comp = graphs.connected_components(nodes, edges)
    full = comp.join(nodes, "node")
    ref = full.groupBy("component").agg(F.min("node").alias("reference"), F.max_by("node", F.struct("points", -F.col("node"))).alias("anchor"), F.count("*").alias("members"))
    return comp.join(ref, "component").select("node", "reference", "anchor", "members")


def weld_mesh(vertices: DataFrame, faces: DataFrame, quantum: float) -> tuple[DataFrame, DataFrame]:
    """vertices (id, x, y, z), faces (id, a, b, c) -> (id, welded), (id, a, b, c): the first vertex of a place stays; faces that lose a corner or are there already go."""
    key = [F.bround(F.col(c) / quantum, 0).alias(f"k{c}") for c in "xyz"]
    v = vertices.select("id", *key)
    first = v.groupBy("kx", "ky", "kz").agg(F.min("id").alias("welded"))
    weld = v.join(first, ["kx", "ky", "kz"]).select("id", "welded")
    f = faces
    for c in "abc":
        f = f.join(weld.select(F.col("id").alias(c), F.col("welded").alias(f"_{c}")), c)
    f = f.select("id", *(F.col(f"_{c}").alias(c) for c in "abc")).where("a <> b AND b <> c AND a <> c")
    f = f.withColumn("_s", F.sort_array(F.array("a", "b", "c"))).groupBy("_s").agg(F.min(F.struct("id", "a", "b", "c")).alias("m")).select("m.*")
    return weld, f


def _edges(faces: DataFrame) -> DataFrame:
    """(id, v0, v1): each face's edges, the smaller end first."""
    e = F.explode(F.array(*(F.struct(F.least(p, q).alias("v0"), F.greatest(p, q).alias("v1")) for p, q in (("a", "b"), ("b", "c"), ("c", "a")))))
    return faces.select("id", e.alias("e")).select("id", "e.v0", "e.v1")


def boundary_curve(faces: DataFrame) -> DataFrame:
    """Edges of exactly one face -> vertex, neighbours, kind: curve if it has two boundary neighbours, else junction."""
    open_ = _edges(faces).groupBy("v0", "v1").agg(F.count("*").alias("n")).where("n = 1")
    ends = open_.selectExpr("v0 AS vertex").union(open_.selectExpr("v1"))
    return ends.groupBy("vertex").agg(F.count("*").alias("neighbours")).withColumn("kind", F.when(F.col("neighbours") == 2, "curve").otherwise("junction"))


def drop_small_components(faces: DataFrame, share: float) -> DataFrame:
    """Faces of components with at least max(1, share of the largest) faces, their vertices numbered anew without holes, in order."""
    edges = _edges(faces)
    comp = graphs.connected_components(edges.selectExpr("v0 AS node"), edges.selectExpr("v0 AS src", "v1 AS dst"))
    marked = faces.join(comp.select(F.col("node").alias("a"), "component"), "a")
    sizes = marked.groupBy("component").agg(F.count("*").alias("n"))
    keep = sizes.crossJoin(F.broadcast(sizes.agg(F.max("n").alias("most")))).where(F.col("n") >= F.greatest(F.lit(1), F.floor(F.col("most") * share))).select("component")
    kept = cut(marked.join(keep, "component", "left_semi"), "kept")
    used = kept.select(F.explode(F.array("a", "b", "c")).alias("v")).distinct()
    index = numbered(used, "v").select("v", "new")
    for c in "abc":
        kept = kept.join(index.select(F.col("v").alias(c), F.col("new").alias(f"n{c}")), c)
    return kept.select("id", F.col("na").alias("a"), F.col("nb").alias("b"), F.col("nc").alias("c"))


def numbered(rows: DataFrame, key: str, block: int = 1 << 16) -> DataFrame:
    """rows with new, from 0 in order of a whole-number key: blocks of keys are counted, and only within a block are rows numbered one by one."""
    r = rows.withColumn("_b", F.floor(F.col(key) / block))
    ahead = r.groupBy("_b").agg(F.count("*").alias("n")).selectExpr("_b AS _o", "coalesce(sum(n) OVER (ORDER BY _b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _ahead")
    return r.withColumn("_k", F.expr(f"row_number() OVER (PARTITION BY _b ORDER BY {key}) - 1")).join(ahead, F.col("_b") == F.col("_o")).withColumn("new", F.col("_k") + F.col("_ahead")).drop("_b", "_o", "_k", "_ahead")


def rim_hops(faces: DataFrame, cap: int) -> DataFrame:
    """faces (id, a, b, c, aspect, nx, ny, nz) -> vertex, hops from the boundary up to cap (cap if farther), worst aspect, agreement: length of the mean unit normal."""
    edges = cut(_edges(faces), "mesh")
    open_ = edges.groupBy("v0", "v1").agg(F.count("*").alias("n")).where("n = 1")
    hops = graphs.hop_distances(edges.selectExpr("v0 AS src", "v1 AS dst"), open_.selectExpr("v0 AS node").union(open_.selectExpr("v1")), cap)
    per = faces.select(F.explode(F.array("a", "b", "c")).alias("vertex"), "aspect", "nx", "ny", "nz").groupBy("vertex").agg(F.max("aspect").alias("aspect"), F.sqrt(sum(F.pow(F.avg(n), 2) for n in ("nx", "ny", "nz"))).alias("agreement"))
    return per.join(hops.withColumnRenamed("node", "vertex"), "vertex", "left").select("vertex", F.coalesce("hops", F.lit(cap)).alias("hops"), "aspect", "agreement")


def sealed_patches(vertices: DataFrame, faces: DataFrame, quantum: float) -> DataFrame:
    """vertices (id, x, y, z, filled), faces (id, a, b, c) -> the faces that stay. A face is filled if any of its corners is. Of the connected patches
    of filled faces of the welded mesh those go that own an open edge: one that exactly one distinct triangle of the whole mesh uses; a triangle and
    its own copy are one."""
    place = Window.partitionBy(*(F.bround(F.col(c) / max(quantum, 1e-12), 0) for c in "xyz"))
    weld = cut(vertices.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL").select("id", F.min("id").over(place).alias("welded"), F.coalesce("filled", F.lit(False)).alias("filled")), "weld")
    f = faces.select("id", "a", "b", "c", F.lit(False).alias("filled"))
    for c in "abc":
        w = weld.select(F.col("id").alias(c), F.col("welded").alias("_w"), F.col("filled").alias("_f"))
        before, f = f, cut(f.join(w, c).select("id", *(F.col("_w" if k == c else k).alias(k) for k in "abc"), (F.col("filled") | F.col("_f")).alias("filled")), "corners")
        if c != "a":
            drop(before)
    drop(weld)
    # of one edge two triangles are the same if their third corners are
    corners = F.explode(F.array(*(F.struct(F.least(p, q).alias("v0"), F.greatest(p, q).alias("v1"), F.col(r).alias("t")) for p, q, r in ("abc", "bca", "cab"))))
    edges = f.select("filled", corners.alias("e")).groupBy("e.v0", "e.v1").agg(F.bool_or("filled").alias("filled"), (F.min("e.t") == F.max("e.t")).alias("open"))
    edges = cut(edges.where("filled").select("v0", "v1", "open"), "patches")
    comp = graphs.connected_components(edges.selectExpr("v0 AS node"), edges.selectExpr("v0 AS src", "v1 AS dst"))
    frontier = edges.where("open").join(comp, F.col("v0") == F.col("node")).select("component").distinct()
    gone = comp.join(frontier, "component", "left_semi").select(F.col("node").alias("a"))
    gone = cut(f.where("filled").join(gone, "a", "left_semi").select("id"), "gone")
    drop(f, edges)
    return faces.join(gone, "id", "left_anti").select("id")


def refused_clusters(residuals: DataFrame, components: DataFrame, degrees: float = 20.0, ratio: float = 2.0) -> DataFrame:
    """residuals (src, dst, degrees, scale_ratio), components (node, component) -> component, refused: if any edge turns by more than
    20 degrees or is off in scale by more than 2x."""
    bad = F.coalesce((F.col("degrees") > degrees) | (F.col("scale_ratio") > ratio), F.lit(True))
    r = residuals.join(components, F.col("src") == F.col("node")).groupBy("component").agg(F.bool_or(bad).alias("refused"))
    return components.select("component").distinct().join(r, "component", "left").select("component", F.coalesce("refused", F.lit(False)).alias("refused"))


# ---- bindings


def _captures(s, d):
    """Orders of a customer as captures: most continue the one before; some claim the same, some bite their tail."""
    w = "PARTITION BY o_custkey ORDER BY o_orderkey"
    o = table(s, d, "orders").selectExpr("o_custkey", "o_orderkey AS id", f"lag(o_orderkey) OVER ({w}) AS p1", f"lag(o_orderkey, 2) OVER ({w}) AS p2", f"max(o_orderkey) OVER (PARTITION BY o_custkey) AS z", f"min(o_orderkey) OVER (PARTITION BY o_custkey) AS a")
    return o.selectExpr("id", "CASE WHEN o_custkey % 10 = 0 AND id = a THEN z WHEN id % 7 = 0 THEN NULL WHEN id % 11 = 0 THEN p2 ELSE p1 END AS continues")


_D_CAPS = """cp AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 10 = 0 AND o_orderkey = min(o_orderkey) OVER (PARTITION BY o_custkey) THEN max(o_orderkey) OVER (PARTITION BY o_custkey) WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN lag(o_orderkey, 2) OVER w ELSE lag(o_orderkey) OVER w END AS up FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
nx AS (SELECT up, min(id) AS id FROM cp WHERE up IS NOT NULL AND up <> id GROUP BY up), hd AS (SELECT id FROM cp WHERE id NOT IN (SELECT id FROM nx)),
wk(id, head, pos) AS (SELECT id, id, 0 FROM hd UNION ALL SELECT nx.id, head, pos + 1 FROM wk JOIN nx ON nx.up = wk.id),
rest AS (SELECT id FROM cp WHERE id NOT IN (SELECT id FROM wk)), rt(id, o) AS (SELECT id, id FROM rest UNION SELECT nx.id, o FROM rt JOIN nx ON nx.up = rt.id),
ln AS (SELECT id, head, pos::BIGINT AS pos, false AS cyclic FROM wk UNION ALL SELECT id, min(o), NULL, true FROM rt GROUP BY id)"""


def _sim3_edges(s, d):
    """A ring of turns in each scene: node k to k + 1, closing exactly unless the scene is odd."""
    e = table(s, d, "nation").selectExpr("n_nationkey AS k", "n_regionkey AS g").selectExpr("g", "row_number() OVER (PARTITION BY g ORDER BY k) - 1 AS i", "count(*) OVER (PARTITION BY g) AS n")
    turn = "2 * pi() / n + CASE WHEN g % 2 = 1 AND i = n - 1 THEN 0.6D ELSE 0D END"
    scale = "CASE WHEN i = 0 THEN 2D WHEN i = n - 1 THEN 0.5D * CASE WHEN g = 2 THEN 3D ELSE 1D END ELSE 1D END"
    return e.selectExpr("CAST(g * 100 + i AS BIGINT) AS src", "CAST(g * 100 + (i + 1) % n AS BIGINT) AS dst", f"{scale} AS s", f"array(cos({turn}), -sin({turn}), 0D, sin({turn}), cos({turn}), 0D, 0D, 0D, 1D) AS r", "array(0D, 0D, 0D) AS t")


def _sim3(s, d):
    edges = cut(_sim3_edges(s, d), "ring")
    roots = edges.groupBy(F.floor(F.col("src") / 100)).agg(F.min("src").alias("node")).select("node")
    return edges, graphs.bfs_compose(edges, roots)


def _faces(s, d):
    """A strip of triangles over the lines of each order; some repeated, some degenerate."""
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber").distinct().selectExpr("l_orderkey * 10 + l_linenumber AS id", "l_orderkey * 10 + l_linenumber AS a", "l_orderkey * 10 + l_linenumber + 1 AS b", "CASE WHEN l_orderkey % 19 = 0 THEN l_orderkey * 10 + l_linenumber + 1 ELSE l_orderkey * 10 + l_linenumber + 2 END AS c", "l_orderkey AS o", "l_linenumber AS l")


def _corners(s, d):
    """Corners of the strips; in every fourth order three places hold them all, so that strips close."""
    v = _faces(s, d).select(F.explode(F.array("a", "b", "c")).alias("id")).distinct()
    return v.selectExpr("id", "CAST(CASE WHEN id DIV 10 % 4 = 0 THEN id DIV 10 * 10 + id % 10 % 3 ELSE id END AS DOUBLE) + id % 7 * 0.01D AS x", "CASE WHEN id DIV 10 % 4 = 0 THEN 1D ELSE 0D END AS y", "0D AS z", "id DIV 10 % 3 = 0 AND id % 10 BETWEEN 3 AND 4 AS filled")


_D_FACES = "fc AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS id, l_orderkey * 10 + l_linenumber AS a, l_orderkey * 10 + l_linenumber + 1 AS b, l_orderkey * 10 + l_linenumber + CASE WHEN l_orderkey % 19 = 0 THEN 1 ELSE 2 END AS c, l_orderkey AS o, l_linenumber AS l FROM lineitem)"
_D_EDGES = "ed AS (SELECT id, least(a, b) AS v0, greatest(a, b) AS v1 FROM fc UNION ALL SELECT id, least(b, c), greatest(b, c) FROM fc UNION ALL SELECT id, least(a, c), greatest(a, c) FROM fc)"


def _place(s, d):
    seg = table(s, d, "customer").selectExpr("c_nationkey AS world", "c_custkey AS segment")
    p = table(s, d, "customer").where("c_custkey % 9 > 0").selectExpr("c_nationkey AS world", "c_custkey AS segment", "CASE WHEN c_custkey % 4 > 0 THEN 'registered' ELSE 'refused' END AS state", "min(c_custkey) OVER (PARTITION BY c_nationkey) + c_custkey % 3 * 0 AS reference", "CASE WHEN c_custkey % 5 > 0 THEN 'now' ELSE 'old' END AS digest", "CAST(c_acctbal AS DOUBLE) AS x")
    return placement_join(seg, p, table(s, d, "nation").selectExpr("n_nationkey AS world", "CASE WHEN n_nationkey % 6 > 0 THEN 'now' END AS digest"))


OPS = {
    "lookup_by_derived_id": (
        lambda s, d: lookup_by_derived_id(events(s, d).selectExpr("CASE WHEN seq % 4 > 0 THEN capture END AS session", "label", "seq / 7 AS observed_at", "CASE WHEN seq % 10 > 0 THEN CAST(seq AS DOUBLE) END AS recorded_at"), events(s, d).where("seq % 5 = 0").select(F.col("seq").alias("asked"), observation_id(F.expr("CASE WHEN seq % 4 > 0 THEN CAST(capture AS STRING) END"), F.expr("CASE WHEN seq % 3 = 0 THEN 'other' ELSE label END"), F.expr("seq / 7")).alias("id")), 2000.0).drop("id"),
        "SELECT event_id AS asked, ok AS found, CASE WHEN ok THEN event_id / 7 END AS observed_at FROM (SELECT *, event_id >= 2000 AND event_id % 3 > 0 AND event_id % 10 > 0 AS ok FROM events WHERE event_id % 5 = 0) x",
    ),
    "trajectory_left_join": (
        lambda s, d: trajectory(table(s, d, "orders").selectExpr("o_custkey AS world", "o_totalprice AS pos", "o_orderkey AS id"), table(s, d, "orders").where("o_orderkey % 9 > 0").selectExpr("o_orderkey AS id", "element_at(array('solved', 'anchor', 'refused'), CAST(o_orderkey % 3 + 1 AS INT)) AS status", "CAST(o_orderkey AS DOUBLE) AS x", "CASE WHEN o_orderkey % 4 > 0 THEN 1D END AS y", "2D AS z")),
        "SELECT o_custkey AS world, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS place, o_orderkey AS id, CASE WHEN ok THEN o_orderkey::DOUBLE END AS x, CASE WHEN ok THEN 1.0::DOUBLE END AS y, CASE WHEN ok THEN 2.0::DOUBLE END AS z FROM (SELECT *, o_orderkey % 9 > 0 AND o_orderkey % 3 < 2 AND o_orderkey % 4 > 0 AS ok FROM orders) x",
    ),
    "point_owner_join": (
        lambda s, d: point_owner(table(s, d, "lineitem").selectExpr("l_partkey AS point", "l_orderkey AS frame"), table(s, d, "orders").selectExpr("o_orderkey AS frame", "o_custkey AS segment", "o_orderkey % 3 AS component", "o_orderkey % 13 = 0 AS posed", "o_orderkey % 101 > 0 AS in_horizon")),
        """WITH own AS (SELECT l_partkey AS point, min(l_orderkey) AS frame FROM lineitem GROUP BY 1), v AS (SELECT o_custkey, o_orderkey % 3 AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderkey % 3) AS k FROM orders GROUP BY o_custkey, o_orderkey % 3),
           g AS (SELECT o_custkey, count(*) FILTER (o_orderkey % 101 = 0) = 0 AS whole, min(o_orderkey) FILTER (o_orderkey % 13 = 0) AS anchor FROM orders GROUP BY 1), r AS (SELECT point, frame, g.o_custkey AS seg, c, anchor, CASE WHEN NOT whole THEN 'pending' WHEN anchor IS NULL THEN 'refused' ELSE 'replaced' END AS mode FROM own JOIN orders o ON o.o_orderkey = frame JOIN g ON g.o_custkey = o.o_custkey JOIN v ON v.o_custkey = g.o_custkey AND k = 1)
           SELECT point, frame, CASE mode WHEN 'replaced' THEN seg END AS segment, CASE mode WHEN 'replaced' THEN c END AS component, CASE mode WHEN 'replaced' THEN anchor END AS anchor, mode FROM r""",
    ),
    "capture_lineage": (lambda s, d: capture_lineage(_captures(s, d)), f"WITH RECURSIVE {_D_CAPS} SELECT * FROM ln"),
    "frame_resolution": (
        lambda s, d: frame_resolution(table(s, d, "orders").selectExpr("o_orderkey AS capture", "o_orderkey % 1000 * 1234567 AS seq", "concat('best/', o_orderkey % 3, '.jpg') AS best"), capture_lineage(_captures(s, d)), table(s, d, "orders").where("o_orderkey % 4 = 0").selectExpr("o_orderkey AS capture", "concat('best/', o_orderkey % 5, '.jpg') AS path")),
        f"""WITH RECURSIVE {_D_CAPS}, h AS (SELECT ln.*, id % 5 AS p FROM ln WHERE id % 4 = 0 AND NOT cyclic) SELECT o_orderkey AS capture, o_orderkey % 1000 * 1234567 AS seq, coalesce((SELECT h.id || '/best/' || p || '.jpg' FROM h WHERE h.head = a.head AND h.pos >= a.pos AND p = o_orderkey % 3 ORDER BY h.pos LIMIT 1), 'frames/' || printf('%08d', o_orderkey % 1000 * 1234567) || '.jpg') AS path
            FROM orders LEFT JOIN ln a ON a.id = o_orderkey AND NOT cyclic""",
    ),
    "ab_compare": (
        lambda s, d: (lambda c: ab_compare(c.selectExpr("prefix", "n AS segments", "n AS keyframes", "n AS solved", "n AS points"), c.selectExpr("prefix", "n AS segments", "n AS keyframes", "n + prefix % 3 AS solved", "n * 2 AS points")).selectExpr("'same' AS run", "*")
            .union(ab_compare(c.selectExpr("prefix", "n AS segments", "n AS keyframes", "n AS solved", "n AS points"), c.selectExpr("prefix", "n + CASE WHEN prefix = 3 THEN 1 ELSE 0 END", "n", "n", "n").toDF("prefix", "segments", "keyframes", "solved", "points")).selectExpr("'moved'", "*"))
            .union(ab_compare(c.selectExpr("prefix", "n AS segments", "n AS keyframes", "n AS solved", "n AS points"), c.where("prefix > 2").selectExpr("prefix", "n AS segments", "n AS keyframes", "n AS solved", "n AS points")).selectExpr("'apart'", "*")))(table(s, d, "customer").groupBy(F.col("c_nationkey").alias("prefix")).agg(F.count("*").alias("n"))),
        """WITH c AS (SELECT c_nationkey AS prefix, count(*) AS n FROM customer GROUP BY 1) SELECT 'same' AS run, prefix, prefix % 3 AS solved, n AS points, false AS moved, 'ok' AS verdict FROM c UNION ALL SELECT 'moved', prefix, 0, 0, prefix = 3, 'VOID' FROM c
           UNION ALL SELECT 'apart', prefix, NULL, NULL, CASE WHEN prefix > 2 THEN false END, 'refused' FROM c""",
    ),
    "covisibility_pairs": (
        lambda s, d: covisibility_topk(table(s, d, "lineitem").selectExpr("l_partkey AS point", "l_suppkey AS frame"), 4, 2, 2, 40),
        """WITH u AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS f FROM lineitem), n AS (SELECT a.f AS frame, b.f AS other, count(*) AS shared FROM u a JOIN u b ON a.p = b.p AND a.f <> b.f GROUP BY ALL HAVING count(*) > 1), r AS (SELECT *, rank() OVER (PARTITION BY frame ORDER BY shared DESC, other) AS k FROM n),
           l AS (SELECT frame, other, shared FROM (SELECT *, rank() OVER (PARTITION BY frame ORDER BY shared DESC, other) AS z FROM n WHERE abs(frame - other) >= 40) x WHERE z < 3) SELECT frame, other, shared FROM r WHERE k < 5 UNION SELECT * FROM l""",
    ),
    "sampled_cross_product": (
        lambda s, d: sampled_cross_product(table(s, d, "orders").selectExpr("o_custkey % 60 AS segment", "o_orderkey AS pos"), s.range(59).selectExpr("id AS a", "id + 1 AS b")),
        """WITH RECURSIVE f AS (SELECT o_custkey % 60 AS g, o_orderkey AS pos, row_number() OVER (PARTITION BY o_custkey % 60 ORDER BY o_orderkey) - 1 AS i FROM orders), n AS (SELECT g, count(*) AS n FROM f GROUP BY g), pr AS (SELECT x.g AS a, y.g AS b, x.n AS na, y.n AS nb FROM n x JOIN n y ON y.g = x.g + 1),
           t(a, b, na, nb, ta, tb) AS (SELECT a, b, na, nb, na, nb FROM pr UNION ALL SELECT a, b, na, nb, CASE WHEN ta > least(na, 8) AND ta >= tb OR tb <= least(nb, 8) THEN ta - 1 ELSE ta END, CASE WHEN NOT (ta > least(na, 8) AND ta >= tb) AND tb > least(nb, 8) THEN tb - 1 ELSE tb END FROM t WHERE ta * tb > 256 AND (ta > least(na, 8) OR tb > least(nb, 8))),
           e AS (SELECT a, b, any_value(na) AS na, any_value(nb) AS nb, min(ta) AS ta, min(tb) AS tb FROM t GROUP BY a, b), ia AS (SELECT DISTINCT a, b, CASE WHEN ta = na THEN i ELSE round_even(i * (na - 1) / (ta - 1), 0)::BIGINT END AS i FROM (SELECT *, unnest(range(ta)) AS i FROM e) x),
           ib AS (SELECT DISTINCT a, b, CASE WHEN tb = nb THEN i ELSE round_even(i * (nb - 1) / (tb - 1), 0)::BIGINT END AS i FROM (SELECT *, unnest(range(tb)) AS i FROM e) x) SELECT ia.a, ia.b, p.pos AS frame_a, q.pos AS frame_b FROM ia JOIN ib USING (a, b) JOIN f p ON p.g = ia.a AND p.i = ia.i JOIN f q ON q.g = ia.b AND q.i = ib.i""",
    ),
    "label_eval_join": (
        lambda s, d: label_eval_join(events(s, d).groupBy(F.col("capture").alias("frame"), F.col("label").alias("class")).agg(F.count("*").alias("got")), table(s, d, "labels").selectExpr("doc_id AS frame", "element_at(array('view', 'click', 'unicorn'), CAST(doc_id % 3 + 1 AS INT)) AS class", "CAST(quality AS BIGINT) AS truth").dropDuplicates(["frame"])),
        """WITH t AS (SELECT doc_id AS frame, ['view', 'click', 'unicorn'][doc_id % 3 + 1] AS class, max(quality)::BIGINT AS truth FROM labels GROUP BY 1, 2), g AS (SELECT user_id AS frame, event_type AS class, count(*) AS got FROM events WHERE user_id IN (SELECT frame FROM t) GROUP BY ALL)
           SELECT frame, class, max(truth) AS truth, max(got) AS got FROM (SELECT frame, class, truth, 0 AS got FROM t UNION ALL SELECT frame, class, 0, got FROM g) x GROUP BY ALL""",
    ),
    "redaction_consensus": (
        lambda s, d: redaction_consensus(*((lambda e: (e.where("id % 2 = 0").selectExpr("f AS frame", "x", "y", "z"), e.select("id", "x", "y", "z")))(table(s, d, "embeddings").selectExpr("vec_id AS id", "label AS f", *(f"CAST(embedding[{i}] AS DOUBLE) AS {c}" for i, c in enumerate("xyz"))))), 0.15, 3),
        "WITH p AS (SELECT vec_id, label, floor(embedding[1]::DOUBLE / 0.15) || ' ' || floor(embedding[2]::DOUBLE / 0.15) || ' ' || floor(embedding[3]::DOUBLE / 0.15) AS k FROM embeddings) SELECT vec_id AS id FROM p WHERE (SELECT count(DISTINCT label) FROM p q WHERE q.k = p.k AND q.vec_id % 2 = 0) >= 3",
    ),
    "placement_join": (
        _place,
        """WITH c AS (SELECT *, min(c_custkey) FILTER (c_custkey % 9 > 0) OVER (PARTITION BY c_nationkey) AS ref FROM customer), ok AS (SELECT c_nationkey AS w, c_custkey AS k, ref, c_acctbal::DOUBLE AS x FROM c WHERE c_custkey % 9 > 0 AND c_custkey % 4 > 0 AND c_custkey % 5 > 0 AND c_nationkey % 6 > 0)
           SELECT c_nationkey AS world, c_custkey AS segment, CASE WHEN p THEN x END AS x, CASE WHEN p THEN ok.ref END AS reference, coalesce(p, false) AS placed FROM c LEFT JOIN (SELECT *, ref IN (SELECT k FROM ok) AS p FROM ok) ok ON k = c_custkey""",
    ),
    "calibration_lookup": (
        lambda s, d: calibration_lookup(table(s, d, "part").selectExpr("p_partkey AS id", "p_size AS w", "p_size % 7 AS h"), s.range(1, 51).selectExpr("id AS w", "id % 7 AS h", "CAST(CASE WHEN id % 5 = 0 THEN -1 ELSE id * 10 END AS DOUBLE) AS fx", "10D AS fy", "CAST(CASE WHEN id % 8 = 0 THEN 99 ELSE id / 2 END AS DOUBLE) AS cx", "0D AS cy").where("w % 3 > 0")),
        "SELECT p_partkey AS id, CASE WHEN ok THEN 'known' ELSE 'unknown' END AS state, CASE WHEN ok THEN p_size * 10.0::DOUBLE END AS fx FROM (SELECT *, p_size % 3 > 0 AND p_size % 5 > 0 AND p_size % 8 > 0 AND p_size BETWEEN 1 AND 50 AS ok FROM part) x",
    ),
    "orphan_segments": (
        lambda s, d: table(s, d, "lineitem").selectExpr("l_suppkey AS segment").distinct().join(table(s, d, "supplier").where("s_nationkey % 3 > 0").selectExpr("s_suppkey AS segment"), "segment", "left_anti"),
        "SELECT s_suppkey AS segment FROM supplier WHERE s_nationkey % 3 = 0 AND EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey)",
    ),
    "keep_list_prune": (
        lambda s, d: table(s, d, "orders").selectExpr("o_orderkey AS blob").join(table(s, d, "lineitem").where("l_returnflag = 'R'").selectExpr("l_orderkey AS blob"), "blob", "left_anti"),
        "SELECT o_orderkey AS blob FROM orders EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'",
    ),
    "key_set_equality": (
        lambda s, d: key_set_equality(table(s, d, "customer").where("c_custkey % 5 > 0").selectExpr("sha2(CAST(c_custkey AS STRING), 256) AS key"), table(s, d, "customer").where("c_custkey % 7 > 0").selectExpr("sha2(CAST(c_custkey AS STRING), 256) AS key"), 3),
        """WITH a AS (SELECT sha256(c_custkey::VARCHAR) AS key FROM customer WHERE c_custkey % 5 > 0), b AS (SELECT sha256(c_custkey::VARCHAR) AS key FROM customer WHERE c_custkey % 7 > 0)
           SELECT key, 'left' AS problem FROM (SELECT key FROM a EXCEPT SELECT key FROM b) x UNION ALL SELECT key, 'right' FROM (SELECT key FROM b EXCEPT SELECT key FROM a) y UNION ALL SELECT key[1:3], 'ambiguous' FROM a GROUP BY 1 HAVING count(*) > 1""",
    ),
    "pair_admission": (
        lambda s, d: pair_admission(table(s, d, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 23 = 0 THEN CAST('NaN' AS DOUBLE) ELSE 1 + o_orderkey % 5 / 20 END AS scale_f", "1 / (1 + o_orderkey % 7 / 20) AS scale_r", "o_orderkey % 11 AS cameras_f", "o_orderkey % 13 AS cameras_r", "o_orderkey % 17 / 100 AS span_f", "0.5D AS span_r", "o_orderkey % 19 / 10 AS ambiguity_f", "1D AS ambiguity_r", "o_orderkey % 29 / 6 AS reprojection_f", "1D AS reprojection_r", "CAST(o_orderkey % 31 / 2 AS DOUBLE) AS rotation")).select("o_orderkey", "admitted", "reason"),
        """SELECT k AS o_orderkey, reason IS NULL AS admitted, reason FROM (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 23 = 0 THEN 'collapsed' WHEN o_orderkey % 11 <= 2 OR o_orderkey % 13 <= 2 THEN 'cameras' WHEN o_orderkey % 17 < 5 THEN 'stood still' WHEN abs((20 + o_orderkey % 5) / (20 + o_orderkey % 7) - 1) > 0.15 THEN 'reciprocity'
           WHEN o_orderkey % 31 > 20 THEN 'rotation' WHEN o_orderkey % 19 > 15 THEN 'ambiguous' WHEN o_orderkey % 29 > 24 THEN 'reprojection' END AS reason FROM orders) x""",
    ),
    "resolve_merge_components": (
        lambda s, d: merge_references(table(s, d, "orders").selectExpr("o_orderkey AS node", "o_orderkey % 37 AS points"), table(s, d, "orders").selectExpr("o_orderkey AS src", "lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS dst")),
        "SELECT o_orderkey AS node, min(o_orderkey) OVER w AS reference, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 37 DESC, o_orderkey) AS anchor, count(*) OVER w AS members FROM orders WINDOW w AS (PARTITION BY o_custkey)",
    ),
    "weld_vertices": (
        lambda s, d: weld_mesh(table(s, d, "embeddings").selectExpr("vec_id AS id", *(f"CAST(embedding[{i}] AS DOUBLE) AS {c}" for i, c in enumerate("xyz"))), s.range(1).selectExpr("id", "id AS a", "id AS b", "id AS c"), 0.13)[0],
        "SELECT vec_id AS id, min(vec_id) OVER (PARTITION BY round_even(embedding[1]::DOUBLE / 0.13, 0), round_even(embedding[2]::DOUBLE / 0.13, 0), round_even(embedding[3]::DOUBLE / 0.13, 0)) AS welded FROM embeddings",
    ),
    "weld_faces": (
        lambda s, d: weld_mesh(table(s, d, "embeddings").selectExpr("vec_id AS id", *(f"CAST(embedding[{i}] AS DOUBLE) AS {c}" for i, c in enumerate("xyz"))), table(s, d, "embeddings").selectExpr("vec_id AS id", "vec_id AS a", "vec_id DIV 2 AS b", "vec_id DIV 3 AS c"), 0.13)[1],
        """WITH w AS (SELECT vec_id AS id, min(vec_id) OVER (PARTITION BY round_even(embedding[1]::DOUBLE / 0.13, 0), round_even(embedding[2]::DOUBLE / 0.13, 0), round_even(embedding[3]::DOUBLE / 0.13, 0)) AS w FROM embeddings),
           f AS (SELECT v.vec_id AS id, x.w AS a, y.w AS b, z.w AS c FROM embeddings v JOIN w x ON x.id = vec_id JOIN w y ON y.id = vec_id // 2 JOIN w z ON z.id = vec_id // 3 WHERE x.w <> y.w AND y.w <> z.w AND x.w <> z.w) SELECT id, a, b, c FROM f QUALIFY row_number() OVER (PARTITION BY list_sort([a, b, c]) ORDER BY id) = 1""",
    ),
    "boundary_edges": (
        lambda s, d: boundary_curve(_faces(s, d)),
        f"WITH {_D_FACES}, {_D_EDGES}, b AS (SELECT v0, v1 FROM ed GROUP BY v0, v1 HAVING count(*) = 1), e AS (SELECT v0 AS vertex FROM b UNION ALL SELECT v1 FROM b) SELECT vertex, count(*) AS neighbours, CASE count(*) WHEN 2 THEN 'curve' ELSE 'junction' END AS kind FROM e GROUP BY vertex",
    ),
    "drop_small_components": (
        lambda s, d: drop_small_components(_faces(s, d).select("id", "a", "b", "c"), 0.8),
        f"""WITH {_D_FACES}, r AS (SELECT *, count_if(brk) OVER (ORDER BY id) AS run FROM (SELECT *, lag(id) OVER (ORDER BY id) IS NULL OR id - lag(id) OVER (ORDER BY id) > CASE WHEN o % 19 = 0 AND lag(o) OVER (ORDER BY id) = o THEN 1 WHEN lag(o) OVER (ORDER BY id) % 19 = 0 THEN 1 ELSE 2 END AS brk FROM fc) x),
            s AS (SELECT run, count(*) AS n FROM r GROUP BY run), k AS (SELECT id, a, b, c FROM r WHERE run IN (SELECT run FROM s WHERE n >= greatest(1, floor((SELECT max(n) FROM s) * 0.8)))), v AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM (SELECT a AS v FROM k UNION SELECT b FROM k UNION SELECT c FROM k) y)
            SELECT k.id, x.i AS a, y.i AS b, z.i AS c FROM k JOIN v x ON x.v = a JOIN v y ON y.v = b JOIN v z ON z.v = c""",
    ),
    "rim_hops": (
        lambda s, d: rim_hops(_faces(s, d).selectExpr("id", "a", "b", "c", "CAST(l AS DOUBLE) AS aspect", "CASE WHEN l % 2 = 0 THEN 1D ELSE 0D END AS nx", "CASE WHEN l % 2 = 1 THEN 1D ELSE 0D END AS ny", "0D AS nz"), 3).selectExpr("vertex", "hops", "aspect", "round(agreement, 6) AS agreement"),
        f"""WITH RECURSIVE {_D_FACES}, {_D_EDGES}, b AS (SELECT v0, v1 FROM ed GROUP BY v0, v1 HAVING count(*) = 1), h(v, k) AS (SELECT v0, 0 FROM b UNION SELECT v1, 0 FROM b UNION SELECT t, k + 1 FROM h JOIN (SELECT v0 AS f, v1 AS t FROM ed UNION SELECT v1, v0 FROM ed) e2 ON v = f WHERE k < 3), n AS (SELECT v, min(k) AS k FROM h GROUP BY v),
            i AS (SELECT DISTINCT id, v, l FROM (SELECT id, unnest([a, b, c]) AS v, l FROM fc) x), p AS (SELECT v, max(l)::DOUBLE AS aspect, sqrt(avg((l % 2 = 0)::INT) ** 2 + avg((l % 2 = 1)::INT) ** 2) AS ag FROM (SELECT id, unnest([a, b, c]) AS v, l FROM fc) x GROUP BY v)
            SELECT p.v AS vertex, coalesce(k, 3)::INT AS hops, aspect, round(ag, 6) AS agreement FROM p LEFT JOIN n ON n.v = p.v""",
    ),
    "sealed_patches": (
        lambda s, d: sealed_patches(_corners(s, d), _faces(s, d).where("o % 3 > 0 OR l < 9"), 0.25),
        f"""WITH RECURSIVE {_D_FACES}, vx AS (SELECT DISTINCT v FROM (SELECT unnest([a, b, c]) AS v FROM fc) q), w AS (SELECT v, min(v) OVER (PARTITION BY CASE WHEN v // 10 % 4 = 0 THEN v // 10 * 10 + v % 10 % 3 ELSE v END) AS w, v // 10 % 3 = 0 AND v % 10 BETWEEN 3 AND 4 AS filled FROM vx),
            f AS (SELECT id, x.w AS a, y.w AS b, z.w AS c, x.filled OR y.filled OR z.filled AS filled FROM fc JOIN w x ON x.v = a JOIN w y ON y.v = b JOIN w z ON z.v = c),
            e AS (SELECT id, filled, list_sort([a, b, c]) AS t, least(p, q) AS v0, greatest(p, q) AS v1 FROM (SELECT *, a AS p, b AS q FROM f UNION ALL SELECT *, b, c FROM f UNION ALL SELECT *, c, a FROM f) s), o AS (SELECT v0, v1 FROM e GROUP BY v0, v1 HAVING count(DISTINCT t) = 1),
            l AS (SELECT v0 AS x, v1 AS y FROM e WHERE filled UNION SELECT v1, v0 FROM e WHERE filled), r(x, k) AS (SELECT x, x FROM l UNION SELECT l.y, k FROM r JOIN l ON l.x = r.x), g AS (SELECT x, min(k) AS k FROM r GROUP BY x),
            bad AS (SELECT DISTINCT k FROM e JOIN g ON x = v0 JOIN o ON o.v0 = e.v0 AND o.v1 = e.v1 WHERE filled) SELECT f.id FROM f LEFT JOIN g ON x = f.a WHERE NOT filled OR k NOT IN (SELECT k FROM bad)""",
    ),
    "bfs_compose": (
        lambda s, d: _sim3(s, d)[1].selectExpr("node", "hops", "round(s, 6) AS scale", "round(r[0], 6) AS cosine", "round(r[3], 6) AS sine"),
        """WITH g AS (SELECT n_regionkey AS g, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation), h AS (SELECT *, least(i, n - i) AS h, i <= n - i AS there, 2 * pi() * i / n AS w FROM g)
           SELECT g * 100 + i AS node, h::INT AS hops, CASE WHEN i = 0 THEN 1 WHEN there THEN 0.5 WHEN g = 2 THEN 1.5 ELSE 0.5 END::DOUBLE AS scale, round(cos(CASE WHEN NOT there AND g % 2 = 1 THEN 0.6 ELSE 0 END - w), 6) AS cosine, round(sin(CASE WHEN NOT there AND g % 2 = 1 THEN 0.6 ELSE 0 END - w), 6) AS sine FROM h""",
    ),
    "cycle_residuals": (
        lambda s, d: (lambda e, p: refused_clusters(graphs.cycle_residuals(e, p), p.selectExpr("node", "node DIV 100 AS component")))(*_sim3(s, d)),
        "SELECT DISTINCT n_regionkey AS component, n_regionkey IN (1, 2, 3) AS refused FROM nation",
    ),
}
