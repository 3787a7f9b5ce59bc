"""Graph operators over edge tables (src, dst); every round is a join and a written table, so lineage stays short."""
from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.sources.shared import hadoop, shared_dir


#: With this a query's shuffle files go when it ends, not when the driver next collects its garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, tag: str) -> DataFrame:
    """The rows, written to the shared folder and read again; what was exchanged for them goes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graph-{tag}-{uuid.uuid4().hex}"
    was = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if was is None else spark.conf.set(_CLEAN, was)
    out = spark.read.parquet(path)
    out._kept_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Removes tables of cut() that no later plan reads."""
    for df in frames:
        fs, path = hadoop(df.sparkSession, df._kept_path)
        fs.delete(path, True)


def connected_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable. Nodes without edges are their own; null ends are no edges.

    Labels spread to neighbours, then jump to the label of their label, so rounds grow with the logarithm of
    a path's length. Raises if labels still move after max_rounds.
    """
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = cut(both.union(both.select("b", "a")).distinct(), "edges")
    label = cut(nodes.select("node").where("node IS NOT NULL").union(both.select("a")).distinct().select("node", F.col("node").alias("component")), "labels")
    for _ in range(max_rounds):
        near = both.join(label, both.b == label.node).groupBy("a").agg(F.min("component").alias("near"))
        spread = label.join(near, label.node == near.a, "left").select("node", F.least("component", "near").alias("component"), F.col("component").alias("was"))
        spread = cut(spread, "spread")
        up = spread.select(F.col("node").alias("p"), F.col("component").alias("top"))
        label = cut(spread.join(up, spread.component == up.p, "left").select("node", F.least("component", "top").alias("component"), "was"), "labels")
        drop(spread)
        if label.where("component <> was").isEmpty():
            drop(both)
            return label.select("node", "component")
        label = label.select("node", "component")
    raise RuntimeError(f"components still change after {max_rounds} rounds")


def union_find_census(components: DataFrame) -> DataFrame:
    """(component, members): sizes, isolated nodes included."""
    return components.groupBy("component").agg(F.count("*").alias("members"))


def drop_small_components(components: DataFrame, fraction: float) -> DataFrame:
    """Nodes of components with at least max(1, fraction of the largest) members."""
    sizes = union_find_census(components)
    largest = sizes.agg(F.max("members").alias("largest"))
    keep = sizes.crossJoin(F.broadcast(largest)).where(F.col("members") >= F.greatest(F.lit(1.0), F.lit(fraction) * F.col("largest"))).select("component")
    return components.join(keep, "component", "left_semi").select("node", "component")


def hop_distances(edges: DataFrame, seeds: DataFrame, cap: int) -> DataFrame:
    """(node, hops): fewest edges from a seed, up to cap; nodes farther than that are absent."""
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    both = cut(both.union(both.select("b", "a")).distinct(), "edges")
    seen = cut(seeds.select("node").where("node IS NOT NULL").distinct().withColumn("hops", F.lit(0)), "hops")
    parts = [seen]
    for k in range(1, cap + 1):
        edge = both.join(seen.where(F.col("hops") == k - 1), both.a == F.col("node")).select(F.col("b").alias("node")).distinct()
        fresh = cut(edge.join(seen, "node", "left_anti").withColumn("hops", F.lit(k)), "hops")
        if fresh.isEmpty():
            break
        seen = seen.unionByName(fresh)
        parts.append(fresh)
    out = cut(seen, "hops")
    drop(both, *parts)
    return out


def laplacian_smooth(values: DataFrame, edges: DataFrame, passes: int, shrink: float = 0.5, inflate: float = -0.53) -> DataFrame:
    """(node, x, y, z) after passes of a shrinking and an inflating step towards the mean of the neighbours."""
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    both = cut(both.union(both.select("b", "a")).distinct(), "edges")
    for _ in range(passes):
        for rate in (shrink, inflate):
            at = values.select(F.col("node").alias("n"), *[F.col(c).alias(f"{c}_") for c in "xyz"])
            mean = both.join(at, both.b == at.n).groupBy("a").agg(*[F.avg(f"{c}_").alias(f"{c}_") for c in "xyz"])
            moved = values.join(mean, values.node == mean.a, "left")
            old, values = values, cut(moved.select("node", *[F.coalesce(F.col(c) + rate * (F.col(f"{c}_") - F.col(c)), F.col(c)).alias(c) for c in "xyz"]), "smooth")
            if hasattr(old, "_kept_path"):
                drop(old)
    drop(both)
    return values


def _dot(a: str, b: str, i: int, j: int):
    """Entry (i, j) of the product of two 3 x 3 matrices held as arrays."""
    return sum(F.col(a)[3 * i + k] * F.col(b)[3 * k + j] for k in range(3))


def _inverse(s: str, r: str, t: str) -> list:
    back = [F.col(r)[3 * k + i] for i in range(3) for k in range(3)]
    return [(1 / F.col(s)).alias(s), F.array(*back).alias(r), F.array(*[-sum(F.col(r)[3 * k + i] * F.col(t)[k] for k in range(3)) / F.col(s) for i in range(3)]).alias(t)]


def bfs_compose(edges: DataFrame, roots: DataFrame, max_hops: int = 100) -> DataFrame:
    """(node, s, r, t, hops): similarity from each node to the root of its component, along fewest edges; unreachable nodes are absent.

    edges: src, dst, s, r (nine numbers, by rows), t (three), taking src to dst coordinates; roots: node. Of
    equally short paths the one by the smallest neighbour counts.
    """
    there = edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), F.col("s").alias("es"), F.col("r").alias("er"), F.col("t").alias("et"))
    back = there.select(F.col("b").alias("a"), F.col("a").alias("b"), *_inverse("es", "er", "et"))
    both = cut(there.unionByName(back).where("a IS NOT NULL AND b IS NOT NULL AND a <> b"), "sim3")
    eye = F.array(*[F.lit(float(i % 4 == 0)) for i in range(9)])
    seen = cut(roots.select("node", F.lit(1.0).alias("s"), eye.alias("r"), F.array(*[F.lit(0.0)] * 3).alias("t"), F.lit(0).alias("hops")), "bfs")
    parts = [seen]
    for hop in range(1, max_hops + 1):
        edge = both.join(seen.where(F.col("hops") == hop - 1), F.col("a") == F.col("node")).join(seen.select(F.col("node").alias("b")), "b", "left_anti")
        moved = F.array(*[F.col("s") * sum(F.col("r")[3 * i + k] * F.col("et")[k] for k in range(3)) + F.col("t")[i] for i in range(3)])
        made = edge.select("b", "a", (F.col("s") * F.col("es")).alias("s"), F.array(*[_dot("r", "er", i, j) for i in range(3) for j in range(3)]).alias("r"), moved.alias("t"))
        fresh = cut(made.groupBy("b").agg(F.min(F.struct("a", "s", "r", "t")).alias("m")).select(F.col("b").alias("node"), "m.s", "m.r", "m.t", F.lit(hop).alias("hops")), "bfs")
        if fresh.isEmpty():
            out = cut(seen, "bfs")
            drop(both, *parts)
            return out
        seen = seen.unionByName(fresh)
        parts.append(fresh)
    raise RuntimeError(f"nodes beyond {max_hops} hops")


def cycle_residuals(edges: DataFrame, placed: DataFrame) -> DataFrame:
    """(src, dst, degrees, scale_ratio, shift): how far each edge is from what the placements of its ends say; edges of the tree give zeros."""
    p = lambda tag, key: placed.select(F.col("node").alias(key), *[F.col(c).alias(f"{c}{tag}") for c in ("s", "r", "t")])
    j = edges.join(p("1", "src"), "src").join(p("2", "dst"), "dst")
    # r1' is r2 * r of the edge; its angle to r1 is that of the trace of r1 transposed times it.
    trace = sum(F.col("r1")[3 * k + i] * _dot("r2", "r", k, i) for i in range(3) for k in range(3))
    ratio = F.col("s2") * F.col("s") / F.col("s1")
    off = [F.col("s2") * sum(F.col("r2")[3 * i + k] * F.col("t")[k] for k in range(3)) + F.col("t2")[i] - F.col("t1")[i] for i in range(3)]
    return j.select("src", "dst", F.degrees(F.acos(F.greatest(F.least((trace - 1) / 2, F.lit(1.0)), F.lit(-1.0)))).alias("degrees"), F.greatest(ratio, 1 / ratio).alias("scale_ratio"), F.sqrt(sum(o * o for o in off)).alias("shift"))


def greedy_cover(scores: DataFrame, budget: int, second: float = 0.3, least_gain: float = 0.01, tried: int = 64) -> DataFrame:
    """(place, frame, gain): frames chosen one by one for points, from (frame, point, score).

    A frame gains what it adds to the best score of its points, and `second` times what it adds to the second best. Ends
    at the budget, without a gain, or once a gain is under least_gain of the sum of gains so far. Equal gains (to nine
    places): the smallest frame.

    Gains only fall as frames are chosen, so the last gain of a frame is a bound of its next one. A round takes the
    `tried` frames of highest bound and measures them, until the best is above all other bounds; the driver holds the
    bounds of measured frames, at most budget times `tried` times the turns a round takes.
    """
    gain = lambda top, next_: F.greatest(F.col("score") - top, F.lit(0.0)) + second * F.greatest(F.least(F.col("score"), top) - next_, F.lit(0.0))
    scores = cut(scores.where("score > 0").groupBy("frame", "point").agg(F.max("score").alias("score")), "scores")
    bounds = cut(scores.groupBy("frame").agg(F.sum("score").alias("bound")), "bounds")
    state = cut(scores.select("point").distinct().select("point", F.lit(0.0).alias("top"), F.lit(0.0).alias("next")), "cover")
    picked, fresh, gone, total = [], {}, set(), 0.0
    key = lambda f, g: (-round(g, 9), f)
    while len(picked) < budget:
        exact: dict = {}
        while True:
            stale = bounds.where(~F.col("frame").isin([*fresh, *gone])) if fresh or gone else bounds
            head = [(r.frame, r.bound) for r in stale.orderBy(F.desc("bound"), "frame").limit(tried + 1).collect()]
            pool = sorted([*head, *((f, g) for f, g in fresh.items() if f not in exact)], key=lambda r: key(*r))
            best = min(exact.items(), key=lambda r: key(*r), default=None)
            if not pool or best and round(pool[0][1], 9) < round(best[1], 9):
                break
            turn = [f for f, _ in pool[:tried]]
            got = {r.frame: r.gain for r in scores.where(F.col("frame").isin(turn)).join(state, "point").groupBy("frame").agg(F.sum(gain(F.col("top"), F.col("next"))).alias("gain")).collect()}
            exact |= {f: got.get(f, 0.0) for f in turn}
            fresh |= {f: got.get(f, 0.0) for f in turn}
        if best is None or best[1] <= 0 or total > 0 and best[1] < least_gain * total:
            break
        frame, won = best
        picked.append((len(picked) + 1, frame, won))
        total += won
        gone.add(frame)
        fresh.pop(frame, None)
        own = scores.where(F.col("frame") == frame).select("point", "score")
        new = F.coalesce("score", F.lit(0.0))
        old, state = state, cut(state.join(own, "point", "left").select("point", F.greatest("top", new).alias("top"), F.greatest("next", F.least("top", new)).alias("next")), "cover")
        drop(old)
    kind = scores.schema["frame"].dataType.simpleString()
    drop(scores, bounds, state)
    return bounds.sparkSession.createDataFrame(picked, f"place int, frame {kind}, gain double")


def budget_thinning(points: DataFrame, budget: int, hint: float | None = None, probes: int = 8) -> DataFrame:
    """points (x, y, z, r, g, b, confidence) -> one row a voxel (measuring.voxel_reduce), of the size whose count comes closest under the budget.

    Points lie on surfaces, so their count falls with the square of the size: each probe solves for 92 % of the budget, from the
    hint or the extent over the root of the count, until one is within 85 to 100 % or the step stops moving. If none came under the
    budget, the most confident rows of the last size stay, the first by place of equal ones. A cloud within the budget stays as it is.
    """
    from .measuring import voxel_reduce

    box = points.agg(F.count("*").alias("n"), F.greatest(*(F.max(c) - F.min(c) for c in "xyz")).alias("span")).first()
    if box.n <= budget:
        return points
    span = box.span if box.span and math.isfinite(box.span) else 1.0
    probe, best = hint or span / max(math.sqrt(box.n), 1.0), None
    for _ in range(probes):
        if not math.isfinite(probe) or probe <= 0:
            break
        n = points.select(*(F.floor(F.col(c) / probe) for c in "xyz")).distinct().count()
        if n <= budget and (best is None or n > best[1]):
            best = probe, n
        if 0.85 * budget <= n <= budget:
            break
        probe = max(span / 1e6, probe * math.sqrt(n / max(1.0, 0.92 * budget)))
        if best is not None and abs(probe - best[0]) < best[0] * 1e-3:
            break
    out = voxel_reduce(points, best[0] if best else probe)
    columns = ["x", "y", "z", "r", "g", "b", "confidence"]
    return out.select(columns) if best else out.orderBy(F.desc("confidence"), "ix", "iy", "iz").limit(budget).select(columns)
