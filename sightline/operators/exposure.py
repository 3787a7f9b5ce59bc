"""Exposure of frames from points that several of them see: a robust sparse fit in rounds of joins; oracle a text of its own."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.sources.shared import Bucketed

from .graphs import cut, drop
from .tables import table


def _huber(residual: Column, delta: float) -> Column:
    """Weight 1 up to delta, delta over its size beyond."""
    return F.when(F.abs(residual) <= delta, F.lit(1.0)).otherwise(delta / F.abs(residual))


def exposure_gains(observations: DataFrame, channels: tuple = ("r", "g", "b"), unit: tuple = ("frame",), rounds: int = 30, delta: float = 0.15, least_views: int = 3) -> tuple[DataFrame, DataFrame]:
    """observations (scene, point, the columns of `unit`, channels of 0 to 1) -> (scene, unit, n, gain_* of each channel), (scene, n, before, after).

    A colour is its point's own times the gain of its unit, which is a frame, or a frame and a cell of its picture. In logarithms both are fitted in turn
    as weighted means, with Huber weights of what is left; the mean log gain of a scene's units is 0. Points that fewer than `least_views` observations
    see don't count; a unit without an observation that counts has gain 1. before and after are the median sizes of what points alone, and
    points and gains, leave.

    Observations are written once, bucketed by point, and points' colours bucketed alike: a round scans both in place, and only sums of units are exchanged. No task holds a
    scene, and the driver sees no unknown.
    """
    spark = observations.sparkSession
    tables, key, own = Bucketed(spark, "exposure"), ["scene", "point"], ["scene", *unit]
    clean = observations.select(*key, *unit, *(F.log(F.greatest(F.col(c), F.lit(1e-4))).alias(c) for c in channels)).where(" AND ".join(f"{c} IS NOT NULL" for c in (*key, *unit, *channels)))
    seen = clean.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") >= least_views).drop("_n")
    obs = tables.keep(clean.join(seen, key, "left_semi").repartition(tables.buckets, *key), *key)
    gains = cut(obs.groupBy(*own).agg(F.count("*").alias("n")).select("*", *(F.lit(0.0).alias(f"g_{c}") for c in channels)), "gains")
    colours = None
    for _ in range(rounds):
        o = obs.join(gains.drop("n"), own)
        if colours is not None:
            o = o.join(colours, key)
        w = {c: F.lit(1.0) if colours is None else _huber(F.col(c) - F.col(f"g_{c}") - F.col(f"a_{c}"), delta) for c in channels}
        new = tables.keep(o.groupBy(*key).agg(*(((F.sum(w[c] * (F.col(c) - F.col(f"g_{c}")))) / F.sum(w[c])).alias(f"a_{c}") for c in channels)), *key)
        if colours is not None:
            tables.drop(colours)
        colours = new
        o = obs.join(gains, own).join(colours, key)
        w = {c: _huber(F.col(c) - F.col(f"g_{c}") - F.col(f"a_{c}"), delta) for c in channels}
        moved = o.groupBy(*own).agg(F.first("n").alias("n"), *((F.sum(w[c] * (F.col(c) - F.col(f"a_{c}"))) / F.sum(w[c])).alias(f"g_{c}") for c in channels))
        mean = moved.groupBy("scene").agg(*(F.avg(f"g_{c}").alias(f"m_{c}") for c in channels))
        old, gains = gains, cut(moved.join(mean, "scene").select(*own, "n", *((F.col(f"g_{c}") - F.col(f"m_{c}")).alias(f"g_{c}") for c in channels)), "gains")
        drop(old)
    plain = obs.groupBy(*key).agg(*(F.avg(c).alias(f"p_{c}") for c in channels))
    left = obs.join(plain, key).join(gains.drop("n"), own)
    left = left.join(colours, key) if colours is not None else left.select("*", *(F.col(f"p_{c}").alias(f"a_{c}") for c in channels))
    each = F.explode(F.array(*(F.struct(F.abs(F.col(c) - F.col(f"p_{c}")).alias("before"), F.abs(F.col(c) - F.col(f"g_{c}") - F.col(f"a_{c}")).alias("after")) for c in channels)))
    report = cut(left.select("scene", each.alias("e")).groupBy("scene").agg((F.count("*") / len(channels)).cast("long").alias("n"), F.percentile_approx("e.before", 0.5, 100_000).alias("before"), F.percentile_approx("e.after", 0.5, 100_000).alias("after")), "report")
    tables.drop(obs, *([] if colours is None else [colours]))
    units = observations.select(*own).distinct()
    out = units.join(gains, own, "left").select(*own, F.coalesce("n", F.lit(0)).alias("n"), *(F.exp(F.coalesce(f"g_{c}", F.lit(0.0))).alias(f"gain_{c}") for c in channels))
    return out, report


# ---- bindings


def _votes(s, d):
    """Lines of orders as points that suppliers' frames see."""
    return table(s, d, "lineitem").selectExpr("l_suppkey % 5 AS scene", "l_partkey AS point", "l_suppkey AS frame", "0.05D + CAST(l_discount AS DOUBLE) + l_suppkey % 7 / 50 AS r", "0.9D - CAST(l_tax AS DOUBLE) * 2 AS g")


def _oracle(rounds: int, delta: float = 0.15) -> str:
    """Each round as tables of its own: points' means, frames' means, frames less their scene's mean."""
    w = lambda x: f"CASE WHEN abs({x}) <= {delta} THEN 1.0::DOUBLE ELSE {delta}::DOUBLE / abs({x}) END"
    steps = ["g0 AS (SELECT scene, frame, 0.0::DOUBLE AS r, 0.0::DOUBLE AS g FROM ob GROUP BY ALL)"]
    for k in range(1, rounds + 1):
        weight = {c: "1.0::DOUBLE" if k == 1 else w(f"ob.{c} - f.{c} - p.{c}") for c in "rg"}
        old = "" if k == 1 else f" JOIN a{k - 1} p ON p.scene = ob.scene AND p.point = ob.point"
        steps.append(f"a{k} AS MATERIALIZED (SELECT ob.scene, ob.point, {', '.join(f'sum({weight[c]} * (ob.{c} - f.{c})) / sum({weight[c]}) AS {c}' for c in 'rg')} FROM ob JOIN g{k - 1} f ON f.frame = ob.frame AND f.scene = ob.scene{old} GROUP BY 1, 2)")
        now = {c: w(f"ob.{c} - p.{c} - f.{c}") for c in "rg"}
        steps.append(f"h{k} AS (SELECT ob.scene, ob.frame, {', '.join(f'sum({now[c]} * (ob.{c} - p.{c})) / sum({now[c]}) AS {c}' for c in 'rg')} FROM ob JOIN g{k - 1} f ON f.frame = ob.frame AND f.scene = ob.scene JOIN a{k} p ON p.scene = ob.scene AND p.point = ob.point GROUP BY 1, 2)")
        steps.append(f"g{k} AS MATERIALIZED (SELECT scene, frame, r - avg(r) OVER (PARTITION BY scene) AS r, g - avg(g) OVER (PARTITION BY scene) AS g FROM h{k})")
    return f"""WITH al AS (SELECT l_suppkey % 5 AS scene, l_partkey AS point, l_suppkey AS frame, ln(greatest(0.05 + l_discount::DOUBLE + l_suppkey % 7 / 50, 1e-4)) AS r, ln(greatest(0.9 - l_tax::DOUBLE * 2, 1e-4)) AS g FROM lineitem),
ob AS MATERIALIZED (SELECT * FROM al QUALIFY count(*) OVER (PARTITION BY scene, point) >= 3), {", ".join(steps)},
n AS (SELECT scene, frame, count(*) AS n FROM ob GROUP BY ALL), u AS (SELECT DISTINCT scene, frame FROM al)
SELECT u.scene, u.frame, coalesce(n, 0) AS n, round(exp(coalesce(r, 0)), 6) AS gain_r, round(exp(coalesce(g, 0)), 6) AS gain_g FROM u LEFT JOIN n USING (scene, frame) LEFT JOIN g{rounds} USING (scene, frame)"""


OPS = {
    "exposure_solve": (
        lambda s, d: exposure_gains(_votes(s, d), ("r", "g"), rounds=4)[0].selectExpr("scene", "frame", "n", "round(gain_r, 6) AS gain_r", "round(gain_g, 6) AS gain_g"),
        _oracle(4),
    ),
}
