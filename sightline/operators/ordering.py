"""Windows, runs, choices and folds over ordered rows, bound to the driver's tables; oracles are texts of their own."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.streaming import folds
from sightline.streaming.keyed import fold_table

from .tables import DUCK_EVENTS, events, table

_UP = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def forward_only_duration(rows: DataFrame) -> DataFrame:
    """rows (key, seq, t) -> forward (sum of steps ahead) and how many steps went back, which add nothing."""
    d = rows.selectExpr("key", "t - lag(t) OVER (PARTITION BY key ORDER BY seq) AS step")
    return d.groupBy("key").agg(F.coalesce(F.sum(F.greatest("step", F.lit(0))), F.lit(0)).alias("forward"), F.count_if(F.col("step") < 0).alias("backward"))


def streak_confirm(rows: DataFrame, latch: int = 3, counted: int = 6, dropped: int = 12) -> DataFrame:
    """rows (track, frame, hit) -> frame, life, misses, confirmed, counted, while a track lives.

    `latch` hits in a row confirm for the rest of a life; it is counted while confirmed and with at most `counted` misses
    in a row; after more than `dropped` it ends, and a later hit begins another life.
    """
    w = "PARTITION BY track ORDER BY frame"
    r = rows.selectExpr("*", f"row_number() OVER ({w}) AS i")
    r = r.selectExpr("*", f"max(CASE WHEN hit THEN i END) OVER ({w} {_UP}) AS last_hit", f"max(CASE WHEN hit THEN i END) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hit_before", f"CASE WHEN hit THEN i - sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER ({w} {_UP}) END AS run")
    r = r.where("last_hit IS NOT NULL").selectExpr("*", "i - last_hit AS misses", f"sum(CASE WHEN hit AND (hit_before IS NULL OR i - hit_before > {dropped + 1}) THEN 1 ELSE 0 END) OVER ({w} {_UP}) AS life")
    r = r.where(f"misses <= {dropped}").selectExpr("*", "CASE WHEN hit THEN row_number() OVER (PARTITION BY track, run, hit ORDER BY frame) ELSE 0 END AS streak")
    r = r.selectExpr("*", f"max(streak) OVER (PARTITION BY track, life ORDER BY frame {_UP}) >= {latch} AS confirmed")
    return r.selectExpr("track", "frame", "life", "misses", "confirmed", f"confirmed AND misses <= {counted} AS counted")


def local_std(rows: DataFrame, width: int = 5) -> DataFrame:
    """rows (key, seq, value) -> population deviation of `width` rows, of full windows only."""
    w = f"PARTITION BY key ORDER BY seq ROWS BETWEEN {width - 1} PRECEDING AND CURRENT ROW"
    return rows.selectExpr("key", "seq", f"count(value) OVER ({w}) AS n", f"stddev_pop(value) OVER ({w}) AS std").where(F.col("n") == width).drop("n")


def step_lag(rows: DataFrame, share: float = 0.632) -> DataFrame:
    """rows (key, seq, value, after: at or behind the step) -> how many rows from the step on it takes until the value reaches that share, 1 if the first does; infinite if none."""
    r = rows.where("after").selectExpr("key", "value", "row_number() OVER (PARTITION BY key ORDER BY seq) AS i")
    return r.groupBy("key").agg(F.coalesce(F.min(F.when(F.col("value") >= share, F.col("i"))).cast("double"), F.lit(float("inf"))).alias("lag"))


def stall_detector(rows: DataFrame, most: int = 90) -> DataFrame:
    """rows (key, seq, accepted) -> since: rows since the last accepted one (of all so far, if none); stalled: more than `most`."""
    w = "PARTITION BY key ORDER BY seq"
    r = rows.selectExpr("*", f"row_number() OVER ({w}) AS i").selectExpr("*", f"coalesce(max(CASE WHEN accepted THEN i END) OVER ({w} {_UP}), 0) AS z")
    return r.selectExpr("key", "seq", "i - z AS since", f"i - z > {most} AS stalled")


def seq_renumber(rows: DataFrame) -> DataFrame:
    """rows (key, pos, seq) -> seq with an offset from each place on where it doesn't rise, so that it always does."""
    w = "PARTITION BY key ORDER BY pos"
    r = rows.selectExpr("*", f"lag(seq) OVER ({w}) AS was").selectExpr("*", "CASE WHEN seq <= was THEN was + 1 - seq ELSE 0 END AS jump")
    return r.selectExpr("key", "pos", "seq AS raw", f"seq + sum(jump) OVER ({w} {_UP}) AS seq")


def stride_subsample(rows: DataFrame, most: int) -> DataFrame:
    """rows (segment, pos) -> of each segment max(1, round(most * n / total)) rows, evenly spread: places floor(i * n / budget)."""
    r = rows.selectExpr("*", "row_number() OVER (PARTITION BY segment ORDER BY pos) - 1 AS k")
    per = rows.groupBy("segment").agg(F.count("*").alias("n"))
    per = per.selectExpr("segment AS _s", "n", "sum(n) OVER () AS total").withColumn("budget", F.greatest(F.lit(1), F.bround(most * F.col("n") / F.col("total"), 0)).cast("long"))
    r = r.join(per, F.col("segment").eqNullSafe(F.col("_s"))).withColumn("budget", F.least("budget", "n"))
    # place k is taken if some i has floor(i n / b) = k, that is if the first i with i n >= k b has i n < (k + 1) b
    i = F.ceil(F.col("k") * F.col("budget") / F.col("n"))
    return r.where((i < F.col("budget")) & (F.floor(i * F.col("n") / F.col("budget")) == F.col("k"))).select(*rows.columns)


def resume_grace(captures: DataFrame, grace: float = 90.0) -> DataFrame:
    """captures (owner, id, started, ended, reason) -> what each continues: the one before, if it ended by a disconnect at most `grace` before."""
    w = "PARTITION BY owner ORDER BY started, id"
    c = captures.selectExpr("*", f"lag(named_struct('id', id, 'ended', ended, 'reason', reason)) OVER ({w}) AS b")
    return c.select("owner", "id", F.when((F.col("b.reason") == "disconnect") & (F.col("started") - F.col("b.ended") <= grace), F.col("b.id")).alias("continues"))


def dense_gap_check(rows: DataFrame) -> DataFrame:
    """rows (key, id) numbered from 0 -> how many are lost, the first one lost, the widest hole; a null first_lost is a whole journal."""
    g = rows.selectExpr("key", "id", "coalesce(lag(id) OVER (PARTITION BY key ORDER BY id), -1) AS was")
    hole = F.col("id") - F.col("was") - 1
    return g.groupBy("key").agg(F.sum(hole).alias("lost"), F.min(F.when(hole > 0, F.col("was") + 1)).alias("first_lost"), F.max(hole).alias("widest"))


def best_n_per_segment(rows: DataFrame, n: int = 2) -> DataFrame:
    """rows (segment, id, sharpness, squareness) -> the best n by sharpness * max(squareness, 0.05), the first of equal ones."""
    r = rows.withColumn("s", F.col("sharpness") * F.greatest("squareness", F.lit(0.05)))
    return r.selectExpr("segment", "id", "row_number() OVER (PARTITION BY segment ORDER BY s DESC, id) AS place").where(F.col("place") <= n)


def batch_sightings(rows: DataFrame, gap: float, least_frames: int) -> DataFrame:
    """rows (capture, label, seq, at or null) in order of at, else of seq; a missing time on either side counts as no gap; runs of enough frames."""
    w = "PARTITION BY capture, label ORDER BY coalesce(at, seq), seq"
    r = rows.selectExpr("*", f"CASE WHEN lag(seq) OVER ({w}) IS NULL OR coalesce(at - lag(at) OVER ({w}), 0) > {gap} THEN 1 ELSE 0 END AS fresh")
    r = r.selectExpr("*", f"sum(fresh) OVER ({w} {_UP}) AS run")
    return r.groupBy("capture", "label", "run").agg(F.count("*").alias("frames"), F.min("seq").alias("first_seq"), F.min("at").alias("first_at"), F.max("at").alias("last_at")).where(F.col("frames") >= least_frames)


def rolling_ratio(rows: DataFrame, width: int = 30, least: int = 5) -> DataFrame:
    """rows (key, seq, value) -> ratio to the upper middle of the last `width` values with this one; null under `least` of them."""
    r = rows.selectExpr("*", f"sort_array(collect_list(value) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN {width - 1} PRECEDING AND CURRENT ROW)) AS l")
    middle = F.get("l", F.floor(F.size("l") / 2).cast("int"))
    return r.select("key", "seq", F.when(F.size("l") >= least, F.col("value") / F.nullif(middle, F.lit(0.0))).alias("ratio"))


def ema(rows: DataFrame, rate: float) -> DataFrame:
    """rows (key, seq, value) -> y: the first value, then rate * value + (1 - rate) * y before; a null leaves y as it is."""

    def step(y, row):
        x = row["value"]
        y = y if x is None else x if y is None else rate * x + (1 - rate) * y
        return y, [{"seq": row["seq"], "y": y}]

    return fold_table(rows, "key", ["seq"], step, "key long, seq long, y double")


def world_listing_sort(worlds: DataFrame) -> DataFrame:
    """worlds (owner, id, updated, created, sessions array of struct<started, id>) -> place: updated, created, id downwards, what is no finite time last; sessions upwards."""
    ok = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))
    w = worlds.withColumn("_u", ok("updated")).withColumn("_c", ok("created"))
    return w.select("owner", "id", F.expr("row_number() OVER (PARTITION BY owner ORDER BY _u DESC NULLS LAST, _c DESC NULLS LAST, id DESC)").alias("place"), F.transform(F.array_sort("sessions"), lambda s: s["id"]).alias("sessions"))


def frame_rank(segments: DataFrame) -> DataFrame:
    """segments (world, reference, revision, points) -> a row a frame, most points first, then reference, revision; the first is called 'world'."""
    g = segments.groupBy("world", "reference", "revision").agg(F.sum("points").alias("points"), F.count("*").alias("segments"))
    g = g.withColumn("place", F.expr("row_number() OVER (PARTITION BY world ORDER BY points DESC, reference, revision)"))
    return g.withColumn("name", F.when(F.col("place") == 1, "world").otherwise(F.concat(F.lit("frame-"), F.col("place").cast("string"))))


def cluster_rank(segments: DataFrame) -> DataFrame:
    """segments (world, reference, revision, segment, points) -> clusters of two or more, the largest first, then reference, revision; members by points downwards, then number."""
    g = segments.groupBy("world", "reference", "revision").agg(F.sort_array(F.collect_list(F.struct((-F.col("points")).alias("p"), "segment"))).alias("m")).where(F.size("m") >= 2)
    g = g.withColumn("place", F.expr("row_number() OVER (PARTITION BY world ORDER BY size(m) DESC, reference, revision)"))
    return g.select("world", "reference", "revision", "place", F.transform("m", lambda x: x["segment"]).alias("members"))


def topk_per_cell(points: DataFrame, k: int, threshold: float, least: int) -> DataFrame:
    """points (frame, id, cell, response) -> at most k of a cell; all of them at or above the threshold, then the best below it until a frame has `least`."""
    p = points.selectExpr("*", "row_number() OVER (PARTITION BY frame, cell ORDER BY response DESC, id) AS in_cell").where(F.col("in_cell") <= k)
    p = p.selectExpr("*", "row_number() OVER (PARTITION BY frame ORDER BY response DESC, id) AS place")
    return p.where((F.col("response") >= threshold) | (F.col("place") <= least)).select("frame", "id", "cell", (F.col("response") >= threshold).alias("above"))


def most_relevant_world(worlds: DataFrame) -> DataFrame:
    """worlds (owner, id, pos, live, updated) -> one of each owner: live before others, then the latest update, then the first."""
    pick = F.max_by(F.struct("id", "live"), F.struct(F.col("live").cast("int"), F.coalesce("updated", F.lit(float("-inf"))), -F.col("pos")))
    return worlds.groupBy("owner").agg(pick.alias("b")).select("owner", "b.*")


def ranked_truth_pairing(runs: DataFrame, truths: DataFrame) -> DataFrame:
    """runs (label, id, best), truths (label, pos, truth) -> runs by best score downwards beside the truths of their class in order; runs without one go."""
    a = runs.selectExpr("*", "row_number() OVER (PARTITION BY label ORDER BY best DESC, id) AS k")
    b = truths.selectExpr("*", "row_number() OVER (PARTITION BY label ORDER BY pos) AS k")
    return a.join(b, ["label", "k"]).select("label", "k", "id", "truth")


# ---- bindings

_R = lambda df, *cs: df.select(*(F.round(c, 6).alias(c) if c in cs else F.col(c) for c in df.columns))


def _rows(s, d):
    return events(s, d).selectExpr("capture AS key", "seq", "score AS value", "t", "label")


def _fold(fold, out, *columns):
    step, close = fold if isinstance(fold, tuple) else (fold, None)
    return lambda s, d: fold_table(events(s, d).selectExpr("capture AS user_id", "seq", "t / 1000000 AS at", *columns), "user_id", ["seq"], step, f"user_id long, {out}", close)


_D_ROWS = "e AS (SELECT user_id AS key, event_id AS seq, value / 500 AS value, epoch_us(ts) AS t, event_type AS label FROM events)"
_D_STEPS = "z AS (SELECT user_id AS u, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, epoch_us(ts) / 1000000 AS t, event_type AS label, value / 500 AS v, event_id AS seq FROM events)"

OPS = {
    "forward_only_duration": (
        lambda s, d: forward_only_duration(_rows(s, d).selectExpr("key", "seq", "t + CASE WHEN seq % 9 = 0 THEN 90000000000 ELSE 0 END AS t")),
        f"WITH {_D_ROWS}, x AS (SELECT key, t + 90000000000 * (seq % 9 = 0)::INT - lag(t + 90000000000 * (seq % 9 = 0)::INT) OVER (PARTITION BY key ORDER BY seq) AS d FROM e) SELECT key, coalesce(sum(d) FILTER (d > 0), 0)::BIGINT AS forward, count(*) FILTER (d < 0) AS backward FROM x GROUP BY key",
    ),
    "streak_confirm": (
        lambda s, d: streak_confirm(_rows(s, d).selectExpr("key AS track", "seq AS frame", "label IN ('view', 'click') AND key % 5 > 0 OR seq % 17 < 2 AS hit")),
        f"""WITH RECURSIVE {_D_STEPS}, h AS (SELECT u, i, seq, label IN ('view', 'click') AND u % 5 > 0 OR seq % 17 < 2 AS hit FROM z),
            w(u, i, seq, life, streak, misses, ok, live) AS (SELECT u, i, seq, hit::INT, hit::INT, 0, false, hit FROM h WHERE i = 1 UNION ALL
              SELECT h.u, h.i, h.seq, w.life + (h.hit AND NOT w.live)::INT, CASE WHEN h.hit THEN CASE WHEN w.live THEN w.streak ELSE 0 END + 1 ELSE 0 END, CASE WHEN h.hit THEN 0 ELSE w.misses + 1 END,
                CASE WHEN h.hit AND NOT w.live THEN false ELSE w.ok OR h.hit AND w.streak >= 2 END, CASE WHEN h.hit THEN true ELSE w.live AND w.misses < 12 END FROM w JOIN h ON h.u = w.u AND h.i = w.i + 1)
            SELECT u AS track, seq AS frame, life::BIGINT AS life, misses::BIGINT AS misses, ok AS confirmed, ok AND misses <= 6 AS counted FROM w WHERE live""",
    ),
    "local_std": (lambda s, d: _R(local_std(_rows(s, d)), "std"), f"WITH {_D_ROWS}, n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS i FROM e) SELECT a.key, a.seq, round(stddev_pop(b.value), 6) AS std FROM n a JOIN n b ON a.key = b.key AND b.i > a.i - 5 AND b.i <= a.i GROUP BY ALL HAVING count(*) = 5"),
    "step_lag": (
        lambda s, d: step_lag(_rows(s, d).selectExpr("key", "seq", "value * 6 AS value", "seq >= 5000 AS after")),
        f"WITH {_D_ROWS}, r AS (SELECT key, value * 6 >= 0.632 AS hit, row_number() OVER (PARTITION BY key ORDER BY seq) AS i FROM e WHERE seq > 4999) SELECT key, CASE WHEN bool_or(hit) THEN (min(i) FILTER (hit))::DOUBLE ELSE 'inf'::DOUBLE END AS lag FROM r GROUP BY key",
    ),
    "stall_detector": (
        lambda s, d: stall_detector(_rows(s, d).selectExpr("key", "seq", "label = 'purchase' AS accepted"), 9),
        f"WITH RECURSIVE {_D_STEPS}, w(u, i, seq, n) AS (SELECT u, i, seq, CASE label WHEN 'purchase' THEN 0 ELSE 1 END FROM z WHERE i = 1 UNION ALL SELECT z.u, z.i, z.seq, CASE z.label WHEN 'purchase' THEN 0 ELSE w.n + 1 END FROM w JOIN z ON z.u = w.u AND z.i = w.i + 1) SELECT u AS key, seq, n::BIGINT AS since, n >= 10 AS stalled FROM w",
    ),
    "seq_renumber": (
        lambda s, d: seq_renumber(_rows(s, d).selectExpr("key", "seq AS pos", "seq % 1000 AS seq")),
        f"WITH RECURSIVE {_D_STEPS}, w(u, i, pos, raw, out) AS (SELECT u, i, seq, seq % 1000, seq % 1000 FROM z WHERE i = 1 UNION ALL SELECT z.u, z.i, z.seq, z.seq % 1000, w.out + CASE WHEN z.seq % 1000 > w.raw THEN z.seq % 1000 - w.raw ELSE 1 END FROM w JOIN z ON z.u = w.u AND z.i = w.i + 1) SELECT u AS key, pos, raw, out AS seq FROM w",
    ),
    "stride_subsample": (
        lambda s, d: stride_subsample(_rows(s, d).selectExpr("key AS segment", "seq AS pos"), 1000),
        "WITH e AS (SELECT user_id AS segment, event_id AS pos, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events), n AS (SELECT segment, count(*) AS n, greatest(1, round_even(1000 * count(*) / (SELECT count(*) FROM events), 0))::BIGINT AS b FROM e GROUP BY 1), p AS (SELECT segment, n, b, unnest(range(least(n, b))) AS i FROM n) SELECT e.segment, pos FROM e JOIN p ON e.segment = p.segment AND e.k = i * n // least(n, b)",
    ),
    "resume_grace": (
        lambda s, d: resume_grace(_rows(s, d).selectExpr("key AS owner", "seq AS id", "t / 1000000 AS started", "t / 1000000 + 3600 AS ended", "element_at(array('disconnect', 'stopped'), CAST(seq % 2 + 1 AS INT)) AS reason"), 3600.0),
        f"WITH {_D_ROWS}, l AS (SELECT key, seq, t, lag(seq) OVER w AS p, lag(t) OVER w AS pt FROM e WINDOW w AS (PARTITION BY key ORDER BY t, seq)) SELECT key AS owner, seq AS id, CASE WHEN p % 2 = 0 AND t - pt - 3600000000 <= 3600000000 THEN p END AS continues FROM l",
    ),
    "dense_gap_check": (
        lambda s, d: dense_gap_check(_rows(s, d).selectExpr("key", "seq", "row_number() OVER (PARTITION BY key ORDER BY seq) - 1 AS id").where("seq % 7 > 0 OR key % 3 = 0").drop("seq")),
        f"WITH {_D_ROWS}, a AS (SELECT key, seq, row_number() OVER (PARTITION BY key ORDER BY seq) - 1 AS id FROM e), k AS (SELECT key, max(id) AS m FROM a WHERE seq % 7 > 0 OR key % 3 = 0 GROUP BY key), x AS (SELECT a.key, id, seq % 7 = 0 AND a.key % 3 > 0 AS gone, id - row_number() OVER (PARTITION BY a.key, seq % 7 = 0 AND a.key % 3 > 0 ORDER BY id) AS run FROM a JOIN k ON a.key = k.key AND id <= m), h AS (SELECT key, run, count(*) AS n FROM x WHERE gone GROUP BY ALL) SELECT key, count(*) FILTER (gone) AS lost, min(id) FILTER (gone) AS first_lost, coalesce((SELECT max(n) FROM h WHERE h.key = x.key), 0) AS widest FROM x GROUP BY key",
    ),
    "best_n_per_segment": (
        lambda s, d: best_n_per_segment(_rows(s, d).selectExpr("concat(key, label) AS segment", "seq AS id", "value AS sharpness", "seq % 10 / 10 AS squareness")),
        f"WITH {_D_ROWS}, x AS (SELECT key || label AS segment, seq AS id, value * CASE WHEN seq % 10 = 0 THEN 0.05::DOUBLE ELSE seq % 10 / 10 END AS s FROM e) SELECT segment, id, place FROM (SELECT segment, id, rank() OVER (PARTITION BY segment ORDER BY s DESC, id) AS place FROM x) y WHERE place < 3",
    ),
    "batch_sightings": (
        lambda s, d: batch_sightings(events(s, d).selectExpr("capture", "label", "seq", "CASE WHEN seq % 11 > 0 THEN t / 1000000 END AS at"), 86400.0, 3).selectExpr("capture", "label", "frames", "first_seq", "round(last_at - first_at, 3) AS seconds"),
        f"""WITH {DUCK_EVENTS}, o AS (SELECT capture, label, seq, CASE WHEN seq % 11 > 0 THEN t / 1000000 END AS t, row_number() OVER (PARTITION BY capture, label ORDER BY CASE WHEN seq % 11 > 0 THEN t / 1000000 ELSE seq END, seq) AS i FROM ev),
            c AS (SELECT b.*, count_if(a.i IS NULL OR b.t - a.t > 86400) OVER (PARTITION BY b.capture, b.label ORDER BY b.i) AS run FROM o b LEFT JOIN o a ON a.capture = b.capture AND a.label = b.label AND a.i = b.i - 1)
            SELECT capture, label, count(*) AS frames, min(seq) AS first_seq, round(max(t) - min(t), 3) AS seconds FROM c GROUP BY capture, label, run HAVING count(*) > 2""",
    ),
    "rolling_ratio": (
        lambda s, d: _R(rolling_ratio(_rows(s, d).selectExpr("key", "seq", "CASE WHEN seq % 13 > 0 THEN value END AS value")), "ratio"),
        f"""WITH {_D_ROWS}, i AS (SELECT key, seq, CASE WHEN seq % 13 > 0 THEN value END AS v, row_number() OVER (PARTITION BY key ORDER BY seq) AS i FROM e), m AS (SELECT a.key, a.seq, a.v, count(b.v) AS n, list_sort(list(b.v) FILTER (b.v IS NOT NULL)) AS l FROM i a JOIN i b ON a.key = b.key AND b.i BETWEEN a.i - 29 AND a.i GROUP BY a.key, a.seq, a.v)
            SELECT key, seq, CASE WHEN n >= 5 THEN round(v / nullif(l[n // 2 + 1], 0), 6) END AS ratio FROM m""",
    ),
    "ema": (
        lambda s, d: _R(ema(_rows(s, d).selectExpr("key", "seq", "CASE WHEN seq % 13 > 0 THEN sqrt(value) END AS value"), 0.3), "y"),
        f"WITH RECURSIVE {_D_STEPS}, w(u, i, seq, y) AS (SELECT u, i, seq, CASE WHEN seq % 13 > 0 THEN sqrt(v) END FROM z WHERE i = 1 UNION ALL SELECT z.u, z.i, z.seq, CASE WHEN z.seq % 13 = 0 THEN w.y WHEN w.y IS NULL THEN sqrt(z.v) ELSE w.y + 0.3::DOUBLE * (sqrt(z.v) - w.y) END FROM w JOIN z ON z.u = w.u AND z.i = w.i + 1) SELECT u AS key, seq, round(y, 6) AS y FROM w",
    ),
    "world_listing_sort": (
        lambda s, d: world_listing_sort(table(s, d, "orders").selectExpr("o_custkey AS owner", "o_orderkey AS id", "CASE o_orderkey % 6 WHEN 1 THEN CAST('NaN' AS DOUBLE) WHEN 2 THEN CAST('Infinity' AS DOUBLE) ELSE CAST(o_orderkey % 4 AS DOUBLE) END AS updated", "CAST(o_orderkey % 3 AS DOUBLE) AS created", "array(named_struct('started', o_orderkey % 7, 'id', 'a'), named_struct('started', 3L, 'id', 'b')) AS sessions")).withColumn("sessions", F.concat_ws("", "sessions")),
        "WITH o AS (SELECT *, CASE WHEN o_orderkey % 6 IN (1, 2) THEN -1 ELSE o_orderkey % 4 END AS u FROM orders) SELECT o_custkey AS owner, o_orderkey AS id, rank() OVER (PARTITION BY o_custkey ORDER BY u DESC, o_orderkey % 3 DESC, o_orderkey DESC) AS place, CASE WHEN o_orderkey % 7 <= 3 THEN 'ab' ELSE 'ba' END AS sessions FROM o",
    ),
    "frame_rank": (
        lambda s, d: frame_rank(table(s, d, "customer").selectExpr("c_nationkey AS world", "c_mktsegment AS reference", "c_custkey % 3 AS revision", "c_custkey % 50 AS points")),
        "WITH g AS (SELECT c_nationkey AS world, c_mktsegment AS reference, c_custkey % 3 AS revision, sum(c_custkey % 50)::BIGINT AS points, count(*) AS segments FROM customer GROUP BY ALL), p AS (SELECT *, rank() OVER (PARTITION BY world ORDER BY points DESC, reference, revision) AS place FROM g) SELECT *, CASE place WHEN 1 THEN 'world' ELSE 'frame-' || place END AS name FROM p",
    ),
    "cluster_rank": (
        lambda s, d: cluster_rank(table(s, d, "customer").selectExpr("c_nationkey AS world", "c_mktsegment AS reference", "c_custkey % 5 AS revision", "c_custkey AS segment", "c_custkey % 7 AS points")).withColumn("members", F.concat_ws(",", F.transform("members", lambda x: x.cast("string")))),
        "WITH g AS (SELECT c_nationkey AS world, c_mktsegment AS reference, c_custkey % 5 AS revision, count(*) AS n, string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey % 7 DESC, c_custkey) AS members FROM customer GROUP BY ALL HAVING count(*) > 1) SELECT world, reference, revision, row_number() OVER (PARTITION BY world ORDER BY n DESC, reference, revision) AS place, members FROM g",
    ),
    "topk_per_cell": (
        lambda s, d: topk_per_cell(table(s, d, "embeddings").selectExpr("label AS frame", "vec_id AS id", "floor(CAST(embedding[0] AS DOUBLE) * 8) AS cell", "CAST(embedding[2] AS DOUBLE) AS response"), 3, 0.12, 12),
        """WITH v AS (SELECT label, vec_id, floor(embedding[1]::DOUBLE * 8)::BIGINT AS cell, embedding[3]::DOUBLE AS r FROM embeddings), a AS (SELECT * FROM v WHERE (SELECT count(*) FROM v x WHERE x.label = v.label AND x.cell = v.cell AND (x.r > v.r OR x.r = v.r AND x.vec_id < v.vec_id)) < 3)
           SELECT label AS frame, vec_id AS id, cell, r >= 0.12 AS above FROM a WHERE r >= 0.12 OR (SELECT count(*) FROM a x WHERE x.label = a.label AND (x.r > a.r OR x.r = a.r AND x.vec_id < a.vec_id)) < 12""",
    ),
    "most_relevant_world": (
        lambda s, d: most_relevant_world(table(s, d, "orders").selectExpr("o_custkey AS owner", "o_orderkey AS id", "o_orderkey AS pos", "o_orderkey % 11 = 0 AS live", "CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderkey % 4 AS DOUBLE) END AS updated")),
        "SELECT o_custkey AS owner, first(o_orderkey ORDER BY o_orderkey % 11 = 0 DESC, CASE WHEN o_orderkey % 5 = 0 THEN -1 ELSE o_orderkey % 4 END DESC, o_orderkey) AS id, bool_or(o_orderkey % 11 = 0) AS live FROM orders GROUP BY 1",
    ),
    "ranked_truth_pairing": (
        lambda s, d: ranked_truth_pairing(_rows(s, d).groupBy("label", F.col("key").alias("id")).agg(F.max("value").alias("best")), table(s, d, "labels").selectExpr("element_at(array('view', 'click', 'purchase'), CAST(doc_id % 3 + 1 AS INT)) AS label", "doc_id AS pos", "quality AS truth")),
        """WITH r AS (SELECT event_type AS label, user_id AS id, max(value) AS b FROM events GROUP BY ALL), a AS (SELECT *, rank() OVER (PARTITION BY label ORDER BY b DESC, id) AS k FROM r), t AS (SELECT ['view', 'click', 'purchase'][doc_id % 3 + 1] AS label, quality AS truth, rank() OVER (PARTITION BY doc_id % 3 ORDER BY doc_id) AS k FROM labels)
           SELECT a.label, a.k, id, truth FROM a JOIN t ON a.label = t.label AND a.k = t.k""",
    ),
    "side_hysteresis": (
        _fold(folds.side_hysteresis(), "at double, side string", "CASE WHEN seq % 13 > 0 THEN seq % 29 / 28 END AS x"),
        f"""WITH RECURSIVE {_D_STEPS}, x AS (SELECT *, CASE WHEN seq % 13 > 0 THEN seq % 29 / 28 END AS x FROM z), w(u, i, t, state, side) AS (SELECT u, 0, 0::DOUBLE, 'centre', 'none' FROM z WHERE i = 1 UNION ALL
            SELECT x.u, x.i, x.t, CASE WHEN x.x IS NULL THEN w.state WHEN x.x < CASE w.state WHEN 'left' THEN 0.38 ELSE 0.32 END THEN 'left' WHEN x.x > CASE w.state WHEN 'right' THEN 0.62 ELSE 0.68 END THEN 'right' ELSE 'centre' END,
              CASE WHEN x.x IS NULL THEN 'unknown' WHEN x.x < CASE w.state WHEN 'left' THEN 0.38 ELSE 0.32 END THEN 'left' WHEN x.x > CASE w.state WHEN 'right' THEN 0.62 ELSE 0.68 END THEN 'right' ELSE 'centre' END FROM w JOIN x ON x.u = w.u AND x.i = w.i + 1)
            SELECT u AS user_id, t AS "at", side FROM w WHERE i > 0""",
    ),
    "heartbeat_change_feed": (
        _fold(folds.change_feed(3600.0), "at double, kind string, revision long", "to_json(named_struct('t', CASE WHEN capture % 2 = 0 THEN label ELSE 'same' END, 'age', seq)) AS payload"),
        f"""WITH RECURSIVE {_D_STEPS}, x AS (SELECT *, CASE WHEN u % 2 = 0 THEN label ELSE 'same' END AS p FROM z), w(u, i, t, p, sent, rev, kind) AS (SELECT u, i, t, p, t, 1, 'change' FROM x WHERE i = 1 UNION ALL
            SELECT x.u, x.i, x.t, x.p, CASE WHEN x.p <> w.p OR x.t - w.sent >= 3600 THEN x.t ELSE w.sent END, w.rev + (x.p <> w.p)::INT, CASE WHEN x.p <> w.p THEN 'change' WHEN x.t - w.sent >= 3600 THEN 'heartbeat' END FROM w JOIN x ON x.u = w.u AND x.i = w.i + 1)
            SELECT u AS user_id, t AS "at", kind, rev::BIGINT AS revision FROM w WHERE kind IS NOT NULL""",
    ),
    "frame_gate_state": (
        _fold(folds.frame_gate(3600.0, 7200.0), "at double, ran boolean, found boolean", "CASE WHEN label <> 'error' THEN label = 'view' END AS found"),
        f"""WITH RECURSIVE {_D_STEPS}, w(u, i, t, ran_at, f, f_at, ran) AS (SELECT u, 0, 0::DOUBLE, NULL::DOUBLE, NULL::BOOLEAN, NULL::DOUBLE, false FROM z WHERE i = 1 UNION ALL
            SELECT z.u, z.i, z.t, CASE WHEN w.ran_at IS NULL OR z.t - w.ran_at >= 3600 THEN z.t ELSE w.ran_at END, CASE WHEN (w.ran_at IS NULL OR z.t - w.ran_at >= 3600) AND z.label <> 'error' THEN z.label = 'view' ELSE w.f END,
              CASE WHEN (w.ran_at IS NULL OR z.t - w.ran_at >= 3600) AND z.label <> 'error' THEN z.t ELSE w.f_at END, w.ran_at IS NULL OR z.t - w.ran_at >= 3600 FROM w JOIN z ON z.u = w.u AND z.i = w.i + 1)
            SELECT u AS user_id, t AS "at", ran, CASE WHEN t - f_at <= 7200 THEN f END AS found FROM w WHERE i > 0""",
    ),
    "keyframe_selector": (
        _fold(folds.keyframe_gates(), "seq long, decision string, segment long", "seq % 21 / 20 AS sharp", "seq % 7 / 6 AS survival", "CASE WHEN seq % 31 > 0 THEN seq % 50 / 700 END AS moved", "seq % 9 / 8 AS overlap"),
        f"""WITH RECURSIVE {_D_STEPS}, x AS (SELECT u, i, seq, seq % 21 / 20 AS sharp, seq % 7 / 6 AS sv, CASE WHEN seq % 31 > 0 THEN seq % 50 / 700 END AS m, seq % 9 / 8 AS ov FROM z),
            w(u, i, seq, has, losses, since, seg, d) AS (SELECT u, 0, 0::BIGINT, false, 0, 0, 0, '' FROM z WHERE i = 1 UNION ALL
              SELECT u, i, seq, CASE WHEN d = 'lost:tracking_lost' THEN false ELSE has OR d LIKE 'accept%' END, CASE WHEN d IN ('reject:blurred', 'accept:session_seed') THEN losses WHEN d = 'reject:tracking_held' THEN losses + 1 ELSE 0 END,
                CASE WHEN d LIKE 'accept%' THEN 0 ELSE since + 1 END, nseg, d FROM (
                SELECT x.u, x.i, x.seq, w.has, w.losses, w.since, w.seg + (w.d = 'lost:tracking_lost')::INT AS nseg, CASE WHEN sharp < 0.25 THEN 'reject:blurred' WHEN NOT w.has THEN 'accept:session_seed' WHEN sv < 0.2 THEN CASE WHEN w.losses >= 2 THEN 'lost:tracking_lost' ELSE 'reject:tracking_held' END
                  WHEN sv < 0.4 THEN 'reject:tracking_degraded' WHEN m IS NULL THEN 'skip:no_motion_evidence' WHEN w.since < 3 THEN 'skip:rate_limited' WHEN ov < 0.75 THEN 'accept:overlap_floor' WHEN m >= 0.05 THEN 'accept:parallax' ELSE 'skip:insufficient_motion' END AS d FROM w JOIN x ON x.u = w.u AND x.i = w.i + 1) q)
            SELECT u AS user_id, seq, d AS decision, seg::BIGINT AS segment FROM w WHERE i > 0""",
    ),
    "dwell_tracker": (
        _fold(folds.dwell_tracker(gap=86400.0, missing=43200.0, misses=2, longest=400000.0), folds.DWELLS, "label <> 'error' AS visible", "floor(seq / 1500) * 0.1D AS x", "0.5D AS y", "CASE WHEN seq % 401 = 0 THEN 3D ELSE 1D END AS area"),
        f"""WITH RECURSIVE {_D_STEPS}, x AS (SELECT u, i, t, label <> 'error' AS vis, floor(seq / 1500) * 0.1::DOUBLE AS x, CASE WHEN seq % 401 = 0 THEN 3.0 ELSE 1.0 END::DOUBLE AS a, max(i) OVER (PARTITION BY u) AS n FROM z),
            w(u, i, n, f, l, k, x, a, m, o) AS (SELECT u, 0, n, NULL::DOUBLE, NULL::DOUBLE, 0, NULL::DOUBLE, NULL::DOUBLE, 0, NULL::STRUCT(f DOUBLE, l DOUBLE, k INT, r VARCHAR) FROM x WHERE i = 1 UNION ALL
              SELECT u, i, n, CASE WHEN fresh THEN t WHEN out_ IS NOT NULL AND NOT vis THEN NULL ELSE f END, CASE WHEN vis THEN t ELSE CASE WHEN out_ IS NULL THEN l END END, CASE WHEN fresh THEN 1 WHEN vis THEN k + 1 WHEN out_ IS NULL THEN k ELSE 0 END, CASE WHEN fresh THEN nx ELSE x END, CASE WHEN fresh THEN na ELSE a END, CASE WHEN vis THEN 0 ELSE m + 1 END,
                CASE WHEN out_ IS NOT NULL THEN struct_pack(f := f, l := l, k := k, r := out_) END FROM (
                SELECT *, vis AND (f IS NULL OR out_ IS NOT NULL) AS fresh FROM (
                  SELECT x.u, x.i, w.n, w.f, w.l, w.k, w.x, w.a, w.m, x.t, x.vis, x.x AS nx, x.a AS na, CASE WHEN w.f IS NULL THEN NULL WHEN x.t - w.l > 86400 THEN 'gap' WHEN NOT x.vis THEN CASE WHEN w.m + 1 > 2 OR x.t - w.l > 43200 THEN 'region_lost' END WHEN abs(x.x - w.x) > 0.18 OR x.a < 0.5 * w.a OR x.a > 2 * w.a THEN 'region_moved' WHEN x.t - w.f > 400000 THEN 'max_duration' END AS out_
                  FROM w JOIN x ON x.u = w.u AND x.i = w.i + 1) q) r)
            SELECT user_id, started, ended, frames, reason FROM (SELECT u AS user_id, o.f AS started, o.l AS ended, o.k::BIGINT AS frames, o.r AS reason FROM w WHERE o IS NOT NULL UNION ALL SELECT u, f, l, k, 'stream_stopped' FROM w WHERE i = n AND f IS NOT NULL) y WHERE frames >= 4 AND ended - started >= 1""",
    ),
}
