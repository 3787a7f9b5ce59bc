"""Operators that are programs rather than one SQL text, bound to the driver's tables; oracles where SQL has them."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.arrays import observation_id
from sightline.sources.store import upsert_monotonic
from sightline.streaming import folds
from sightline.streaming.keyed import fold_table

from . import graphs


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _chain(spark, sf) -> DataFrame:
    """A customer's orders in a row, by key."""
    return _t(spark, sf, "orders").selectExpr("o_orderkey AS src", "lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS dst")


def _components(spark, sf) -> DataFrame:
    return graphs.connected_components(_t(spark, sf, "orders").selectExpr("o_orderkey AS node"), _chain(spark, sf))


def _smooth(spark, sf) -> DataFrame:
    v = _t(spark, sf, "embeddings").selectExpr("vec_id AS node", *[f"CAST(embedding[{i}] AS DOUBLE) AS {c}" for i, c in enumerate("xyz")], "label")
    edges = v.selectExpr("node AS src", "lead(node) OVER (PARTITION BY label ORDER BY node) AS dst").where("dst IS NOT NULL")
    return graphs.laplacian_smooth(v.drop("label"), edges, 1).selectExpr("node", "round(x, 6) AS x", "round(y, 6) AS y", "round(z, 6) AS z")


def _cover(spark, sf) -> DataFrame:
    return graphs.greedy_cover(_t(spark, sf, "lineitem").selectExpr("l_suppkey AS frame", "l_partkey AS point", "CAST(l_discount AS DOUBLE) AS score"), 5).selectExpr("place", "frame", "round(gain, 6) AS gain")


def _thin(spark, sf) -> DataFrame:
    v = _t(spark, sf, "embeddings").selectExpr(*[f"CAST(embedding[{i}] AS DOUBLE) AS {c}" for i, c in enumerate("xyz")], *(f"CAST(vec_id * {k} % 256 AS INT) AS {c}" for k, c in ((1, "r"), (3, "g"), (7, "b"))), "CAST(vec_id % 11 AS INT) AS confidence")
    return graphs.budget_thinning(v, 100).selectExpr(*(f"round({c}, 6) AS {c}" for c in "xyz"), "r", "g", "b", "confidence")


def _upsert(spark, sf) -> DataFrame:
    e = _t(spark, sf, "events").selectExpr("event_id", "event_type AS class", "CAST(user_id AS DOUBLE) AS observed_at", "value AS best_score", "CAST(event_id AS DOUBLE) AS last_seen_at", "event_id AS frame_count", "CASE WHEN value < 100 THEN 'low' ELSE 'high' END AS confidence", "CAST(event_id AS STRING) AS frame")
    old = e.where("event_id % 2 = 0").groupBy("class", "observed_at").agg(F.max_by(F.struct(*[c for c in e.columns if c not in ("class", "observed_at")]), F.struct("best_score", "event_id")).alias("m")).select("class", "observed_at", "m.*").drop("event_id")
    return upsert_monotonic(old, e.where("event_id % 2 = 1").drop("event_id")).select("class", "observed_at", "best_score", "confidence")


def _tracks(spark, sf) -> DataFrame:
    """Lines of an order as a frame's boxes, of a supplier as a capture."""
    box = F.struct(F.col("l_returnflag").alias("label"), F.col("l_linenumber").cast("double").alias("x0"), F.lit(0.0).alias("y0"), (F.col("l_linenumber") + 4.5).cast("double").alias("x1"), F.lit(5.0).alias("y1"), F.when(F.col("l_partkey") % 2 == 0, F.col("l_linestatus")).alias("facing"))
    frames = _t(spark, sf, "lineitem").groupBy("l_suppkey", F.col("l_orderkey").cast("double").alias("at")).agg(F.to_json(F.sort_array(F.collect_list(box))).alias("boxes"))
    return fold_table(frames, "l_suppkey", ["at"], folds.multi_object_tracker(), "l_suppkey long, " + folds.TRACKS)


QUERIES = {
    "connected_components": _components,
    "union_find_census": lambda spark, sf: graphs.union_find_census(_components(spark, sf)),
    "laplacian_smooth": _smooth,
    "greedy_cover": _cover,
    "budget_thinning": _thin,
    "upsert_monotonic": _upsert,
    "observation_id": lambda spark, sf: _t(spark, sf, "events").select("event_id", observation_id(F.when(F.col("event_id") % 5 > 0, F.col("user_id").cast("string")), "event_type", F.col("value").cast("double")).alias("id")),
    "multi_object_tracker": _tracks,
}

_MEMBERS = "m AS (SELECT o_orderkey AS node, min(o_orderkey) OVER (PARTITION BY o_custkey) AS component, count(*) OVER (PARTITION BY o_custkey) AS members FROM orders)"
_SMOOTH = ", ".join(f"round({c}, 6) AS {c}" for c in "xyz")


def _pass(source: str, rate: float) -> str:
    """One step on a chain, where neighbours are the rows before and after."""
    mean = "(coalesce(lag({c}) OVER w, 0) + coalesce(lead({c}) OVER w, 0)) / nullif(count(*) OVER (PARTITION BY label ORDER BY node ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) - 1, 0)"
    moved = ", ".join(f"coalesce({c} + {rate} * ({mean.format(c=c)} - {c}), {c}) AS {c}" for c in "xyz")
    return f"SELECT node, label, {moved} FROM {source} WINDOW w AS (PARTITION BY label ORDER BY node)"


def _cover_sql(budget: int) -> str:
    """A round is three tables: what each frame would add, the choice, the points' two best scores so far."""
    steps = ["t0 AS (SELECT p, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM s GROUP BY p)", "c0 AS (SELECT NULL::BIGINT AS f, 0.0::DOUBLE AS g, 0.0::DOUBLE AS total)"]
    for k in range(1, budget + 1):
        before = " UNION ALL ".join(f"SELECT f FROM c{j} WHERE f IS NOT NULL" for j in range(k))
        steps.append(f"g{k} AS (SELECT s.f, sum(greatest(v - a, 0) + 0.3::DOUBLE * greatest(least(v, a) - b, 0)) AS g FROM s JOIN t{k - 1} USING (p) WHERE s.f NOT IN ({before}) GROUP BY s.f)")
        steps.append(f"c{k} AS (SELECT x.f, x.g, y.total + x.g AS total FROM (SELECT f, g FROM g{k} ORDER BY round(g, 9) DESC, f LIMIT 1) x, c{k - 1} y WHERE x.g > 0 AND (y.total = 0 OR x.g >= 0.01 * y.total))")
        steps.append(f"t{k} AS MATERIALIZED (SELECT t.p, greatest(a, coalesce(v, 0)) AS a, greatest(b, least(a, coalesce(v, 0))) AS b FROM t{k - 1} t LEFT JOIN s ON s.p = t.p AND s.f = (SELECT f FROM c{k}))")
    rows = " UNION ALL ".join(f"SELECT {k}::INT AS place, f AS frame, round(g, 6) AS gain FROM c{k}" for k in range(1, budget + 1))
    return f"WITH s AS (SELECT l_suppkey AS f, l_partkey AS p, max(l_discount)::DOUBLE AS v FROM lineitem WHERE l_discount > 0 GROUP BY ALL), {', '.join(steps)} {rows}"


_THIN = """WITH RECURSIVE v AS (SELECT embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, vec_id % 256 AS r, vec_id * 3 % 256 AS g, vec_id * 7 % 256 AS b, vec_id % 11 AS c FROM embeddings),
box AS (SELECT count(*) AS n, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS span FROM v),
p(k, size, n) AS (SELECT 0, span / sqrt(n), (SELECT count(*) FROM (SELECT DISTINCT floor(x / (box.span / sqrt(box.n))), floor(y / (box.span / sqrt(box.n))), floor(z / (box.span / sqrt(box.n))) FROM v)) FROM box UNION ALL
  SELECT k + 1, size * sqrt(n / 92.0), (SELECT count(*) FROM (SELECT DISTINCT floor(x / (p.size * sqrt(p.n / 92.0))), floor(y / (p.size * sqrt(p.n / 92.0))), floor(z / (p.size * sqrt(p.n / 92.0))) FROM v)) FROM p WHERE k < 7 AND NOT n BETWEEN 85 AND 100),
best AS (SELECT size FROM p WHERE n <= 100 ORDER BY n DESC, k LIMIT 1)
SELECT round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, floor(avg(r))::INT AS r, floor(avg(g))::INT AS g, floor(avg(b))::INT AS b, max(c)::INT AS confidence FROM v, best GROUP BY floor(v.x / size), floor(v.y / size), floor(v.z / size)"""

ORACLES = {
    "connected_components": f"WITH {_MEMBERS} SELECT node, component FROM m",
    "union_find_census": f"WITH {_MEMBERS} SELECT component, count(*) AS members FROM m GROUP BY component",
    "laplacian_smooth": f"WITH v AS (SELECT vec_id AS node, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings), a AS ({_pass('v', 0.5)}), b AS ({_pass('a', -0.53)}) SELECT node, {_SMOOTH} FROM b",
    "greedy_cover": _cover_sql(5),
    "budget_thinning": _THIN,
    "upsert_monotonic": "SELECT event_type AS class, CAST(user_id AS DOUBLE) AS observed_at, max(value) AS best_score, CASE WHEN max(value) < 100 THEN 'low' ELSE 'high' END AS confidence FROM events GROUP BY event_type, user_id",
}
