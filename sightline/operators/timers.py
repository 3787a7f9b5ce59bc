"""Queries of folds with timers over the driver's events, and of what needs no fold: graces and runs as windows; oracles are texts of their own."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.streaming import timed
from sightline.streaming.feeds import late_verdicts

from .tables import events, table


def grace_windows(rows: DataFrame, grace: float = 90.0) -> DataFrame:
    """rows (key, seq, at, kind: start, end or disconnect) -> key, at, walk of each start: it continues the walk if the row before is a disconnect at most `grace` before."""
    w = "PARTITION BY key ORDER BY seq"
    r = rows.selectExpr("*", f"lag(kind) OVER ({w}) AS _kind", f"lag(at) OVER ({w}) AS _at").where("kind = 'start'")
    new = "CASE WHEN _kind = 'disconnect' AND at - _at <= {} THEN 0 ELSE 1 END".format(float(grace))
    return r.selectExpr("key", "at", f"sum({new}) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS walk")


def lab_runs(rows: DataFrame, most: int = 64) -> DataFrame:
    """rows (key, seq, kind: sample or stop, metric, value) -> key, metric, n, total, lowest, highest of the samples before the first stop: `most` metrics
    by name, in order of their first value, the rest together as '(other)'. Samples without a value count for nothing; a missing name is ''."""
    first_stop = "min(CASE WHEN kind = 'stop' THEN seq END) OVER (PARTITION BY key)"
    r = rows.selectExpr("*", f"{first_stop} AS _stop").where("kind <> 'stop' AND value IS NOT NULL AND (_stop IS NULL OR seq < _stop)").withColumn("metric", F.coalesce("metric", F.lit("")))
    per = r.groupBy("key", "metric").agg(F.min("seq").alias("_first"), F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("lowest"), F.max("value").alias("highest"))
    per = per.selectExpr("*", "row_number() OVER (PARTITION BY key ORDER BY _first, metric) AS _place")
    name = F.when(F.col("_place") <= most, F.col("metric")).otherwise("(other)")
    return per.groupBy("key", name.alias("metric")).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("lowest").alias("lowest"), F.max("highest").alias("highest"))


# ---- bindings


def _timed(fold, order, *columns):
    return lambda s, d: timed.fold_table(events(s, d).selectExpr("seq", "t / 1000000 AS at", *columns), "key", order, fold)


_Z = "z AS (SELECT {key} AS u, row_number() OVER (PARTITION BY {key} ORDER BY epoch_us(ts), event_id) AS i, epoch_us(ts) / 1000000 AS t, event_type AS label, value / 500 AS v, event_id AS seq FROM events), u AS (SELECT max(t) AS until FROM z), n AS (SELECT u, max(i) AS n FROM z GROUP BY u)"
_ZC = _Z.format(key="user_id")


def _beats(s, d):
    return _timed(timed.Feed(7200.0, 86400.0), ["seq"], "capture AS key", "CASE WHEN capture % 2 = 0 THEN label ELSE CAST(seq DIV 300 AS STRING) END AS body")(s, d).selectExpr("key", "kind", "round(at, 3) AS at", "revision")


OPS = {
    "sighting_closures": (
        lambda s, d: _timed(timed.Sightings(86400.0, 3, 43200.0), ["seq"], "concat(capture, ':', label) AS key", "score")(s, d),
        f"""WITH RECURSIVE {_Z.format(key="user_id || ':' || event_type")},
            w(u, i, t, f, l, k, best, said, kind, p) AS (SELECT u, i, t, t, t, 1, v, NULL::DOUBLE, '', NULL::STRUCT(f DOUBLE, l DOUBLE, k INT, best DOUBLE) FROM z WHERE i = 1 UNION ALL
              SELECT z.u, z.i, z.t, CASE WHEN z.t - w.l > 86400 THEN z.t ELSE w.f END, z.t, CASE WHEN z.t - w.l > 86400 THEN 1 ELSE w.k + 1 END, CASE WHEN z.t - w.l > 86400 OR z.v > w.best THEN z.v ELSE w.best END,
                CASE WHEN z.t - w.l > 86400 THEN NULL WHEN w.k = 2 OR w.k > 2 AND (z.v > w.best OR z.t - w.said >= 43200) THEN z.t ELSE w.said END, CASE WHEN z.t - w.l > 86400 THEN '' WHEN w.k = 2 THEN 'record' WHEN w.k > 2 AND (z.v > w.best OR z.t - w.said >= 43200) THEN 'update' ELSE '' END,
                CASE WHEN z.t - w.l > 86400 AND w.k >= 3 THEN struct_pack(f := w.f, l := w.l, k := w.k, best := w.best) END FROM w JOIN z ON z.u = w.u AND z.i = w.i + 1)
            SELECT u AS key, kind, t AS "at", f AS first_at, l AS last_at, k::BIGINT AS frames, best FROM w WHERE kind <> '' UNION ALL SELECT u, 'close', p.l + 86400, p.f, p.l, p.k, p.best FROM w WHERE p IS NOT NULL
            UNION ALL SELECT w.u, 'close', l + 86400, f, l, k, best FROM w JOIN n ON n.u = w.u AND n.n = w.i, u WHERE k >= 3 AND l + 86400 < until""",
    ),
    "feed_heartbeats": (
        _beats,
        f"""WITH {_ZC}, b AS (SELECT u, i, t, CASE WHEN u % 2 = 0 THEN label ELSE (seq // 300)::VARCHAR END AS body FROM z), l AS (SELECT *, lag(t) OVER w AS pt, lag(body) OVER w AS pb FROM b WINDOW w AS (PARTITION BY u ORDER BY i)),
            s AS (SELECT *, count(*) FILTER (pt IS NULL OR t - pt > 86400) OVER (PARTITION BY u ORDER BY i) AS island FROM l), g AS (SELECT u, island, max(t) AS last FROM s GROUP BY ALL),
            c AS (SELECT s.u, s.island, t, last, row_number() OVER w AS rev, lead(t) OVER w AS nt FROM s JOIN g USING (u, island) WHERE pt IS NULL OR t - pt > 86400 OR body <> pb WINDOW w AS (PARTITION BY s.u, s.island ORDER BY i))
            SELECT u AS key, 'change' AS kind, round(t, 3) AS "at", rev AS revision FROM c UNION ALL
            SELECT u, 'heartbeat', round(t + 7200 * k, 3), rev FROM (SELECT c.*, until, unnest(range(1, 2 + floor((least(coalesce(nt, last + 86400), until) - t) / 7200)::BIGINT)) AS k FROM c, u) x WHERE t + 7200 * k < coalesce(nt, last + 86400) AND t + 7200 * k < until UNION ALL
            SELECT u, 'gone', round(last + 86400, 3), max(rev) FROM c, u WHERE last + 86400 < until GROUP BY u, island, last""",
    ),
    "carried_regions": (
        lambda s, d: _timed(timed.Carry(3600.0, 14400.0), ["seq"], "capture AS key", "label <> 'error' AS steady", "CASE WHEN label = 'view' THEN CAST(seq AS STRING) END AS region")(s, d),
        f"""WITH RECURSIVE {_ZC}, w(u, i, t, ran, reg, said, out_) AS (SELECT u, 0, NULL::DOUBLE, NULL::DOUBLE, NULL::VARCHAR, NULL::BOOLEAN, NULL::DOUBLE FROM z WHERE i = 1 UNION ALL
              SELECT u, i, t, CASE WHEN NOT steady THEN live_ran WHEN run THEN t ELSE live_ran END, CASE WHEN NOT steady THEN live_reg WHEN run THEN nreg ELSE live_reg END, CASE WHEN steady THEN run END, out_ FROM (
                SELECT *, live_ran IS NULL OR t - live_ran >= 3600 AS run FROM (SELECT z.u, z.i, z.t, z.label <> 'error' AS steady, CASE WHEN z.label = 'view' THEN z.seq::VARCHAR END AS nreg, CASE WHEN w.ran + 14400 >= z.t THEN w.ran END AS live_ran, CASE WHEN w.ran + 14400 >= z.t THEN w.reg END AS live_reg,
                  CASE WHEN w.ran + 14400 < z.t AND w.reg IS NOT NULL THEN w.ran + 14400 END AS out_ FROM w JOIN z ON z.u = w.u AND z.i = w.i + 1) q) r)
            SELECT u AS key, t AS "at", said AS ran, reg AS region, false AS expired FROM w WHERE said IS NOT NULL UNION ALL SELECT u, out_, false, NULL, true FROM w WHERE out_ IS NOT NULL
            UNION ALL SELECT w.u, ran + 14400, false, NULL, true FROM w JOIN n ON n.u = w.u AND n.n = w.i, u WHERE reg IS NOT NULL AND ran + 14400 < until""",
    ),
    "walk_events": (
        lambda s, d: _timed(timed.Walks(7200.0, 1e9), ["seq"], "capture AS key", "CASE WHEN label = 'view' THEN 'start' WHEN label = 'click' THEN 'end' ELSE 'disconnect' END AS kind")(s, d),
        f"""WITH RECURSIVE {_ZC}, w(u, i, t, walk, gone, live, over, ev) AS (SELECT u, 0, NULL::DOUBLE, -1, NULL::DOUBLE, false, NULL::DOUBLE, []::STRUCT(walk INT, e VARCHAR)[] FROM z WHERE i = 1 UNION ALL
              SELECT u, i, t, CASE WHEN label = 'view' AND (NOT alive OR gone IS NULL) THEN walk + 1 ELSE walk END, CASE WHEN label = 'view' THEN NULL ELSE t END, CASE WHEN label = 'view' THEN true WHEN label = 'click' THEN false ELSE alive END, over,
                CASE WHEN label = 'view' THEN CASE WHEN NOT alive THEN [struct_pack(walk := walk + 1, e := 'begun')] WHEN gone IS NULL THEN [struct_pack(walk := walk, e := 'over'), struct_pack(walk := walk + 1, e := 'begun')] ELSE [struct_pack(walk := walk, e := 'resumed')] END
                     WHEN label = 'click' AND alive THEN [struct_pack(walk := walk, e := 'over')] ELSE [] END FROM (
                SELECT z.u, z.i, z.t, z.label, w.walk, w.gone, w.live AND (w.gone IS NULL OR w.gone + 7200 >= z.t) AS alive, CASE WHEN w.live AND w.gone + 7200 < z.t THEN w.gone + 7200 END AS over FROM w JOIN z ON z.u = w.u AND z.i = w.i + 1) q),
            x AS (SELECT u, t, unnest(ev) AS ev FROM w)
            SELECT u AS key, t AS "at", ev.walk::BIGINT AS walk, ev.e AS event FROM x UNION ALL SELECT w.u, w.over, p.walk, 'over' FROM w JOIN w p ON p.u = w.u AND p.i = w.i - 1 WHERE w.over IS NOT NULL
            UNION ALL SELECT w.u, gone + 7200, walk, 'over' FROM w JOIN n ON n.u = w.u AND n.n = w.i, u WHERE live AND gone + 7200 < until""",
    ),
    "late_verdict_settle": (
        lambda s, d: _timed(timed.Verdicts(43200.0), ["seq"], "seq % 400 AS key", "CASE WHEN label IN ('view', 'click') THEN 'closed' ELSE 'verdict' END AS kind", "label AS verdict")(s, d).withColumnRenamed("key", "item"),
        f"""WITH RECURSIVE {_Z.format(key="event_id % 400")}, w(u, i, t, parked, came, early, due, said) AS (SELECT u, 0, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::VARCHAR, NULL::DOUBLE, NULL::VARCHAR FROM z WHERE i = 1 UNION ALL
              SELECT u, i, t, CASE WHEN closed AND c IS NULL THEN coalesce(p, t) END, CASE WHEN NOT closed AND p IS NULL THEN t END, CASE WHEN NOT closed AND p IS NULL THEN label END, due, CASE WHEN closed AND c IS NOT NULL THEN early WHEN NOT closed AND p IS NOT NULL THEN label END FROM (
                SELECT z.u, z.i, z.t, z.label, z.label IN ('view', 'click') AS closed, CASE WHEN w.parked + 43200 >= z.t THEN w.parked END AS p, CASE WHEN w.came + 43200 >= z.t THEN w.came END AS c, w.early, CASE WHEN w.parked + 43200 < z.t THEN w.parked + 43200 END AS due FROM w JOIN z ON z.u = w.u AND z.i = w.i + 1) q)
            SELECT u AS item, t AS "at", said AS verdict FROM w WHERE said IS NOT NULL UNION ALL SELECT u, due, 'unverified' FROM w WHERE due IS NOT NULL UNION ALL SELECT w.u, parked + 43200, 'unverified' FROM w JOIN n ON n.u = w.u AND n.n = w.i, u WHERE parked + 43200 < until""",
    ),
    "late_verdict_enrich": (
        lambda s, d: late_verdicts(events(s, d).where("label IN ('view', 'click')").selectExpr("seq AS item", "timestamp_micros(t) AS closed_at"), events(s, d).where("label IN ('purchase', 'error')").selectExpr("explode(array(seq - 1, seq - 2)) AS verdict_of", "label AS verdict", "timestamp_micros(t) AS at"), "2 hours", "6 hours").selectExpr("item", "verdict", "unix_micros(verdict_at) - unix_micros(closed_at) AS waited"),
        """WITH v AS (SELECT event_id - k AS of_, event_type AS verdict, epoch_us(ts) AS t FROM events, (VALUES (1), (2)) x(k) WHERE event_type IN ('purchase', 'error')), f AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY of_ ORDER BY t, verdict) = 1)
           SELECT e.event_id AS item, coalesce(f.verdict, 'unverified') AS verdict, f.t - epoch_us(e.ts) AS waited FROM events e LEFT JOIN f ON of_ = e.event_id AND f.t BETWEEN epoch_us(e.ts) - 7200000000 AND epoch_us(e.ts) + 21600000000 WHERE e.event_type IN ('view', 'click')""",
    ),
    "grace_windows": (
        lambda s, d: grace_windows(events(s, d).selectExpr("capture AS key", "seq", "t / 1000000 AS at", "CASE WHEN label = 'view' THEN 'start' WHEN label = 'click' THEN 'end' ELSE 'disconnect' END AS kind"), 7200.0).withColumnRenamed("key", "user_id"),
        """WITH RECURSIVE z AS (SELECT user_id AS u, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, epoch_us(ts) / 1000000 AS t, event_type AS label FROM events), w(u, i, t, walk, gone, is_start) AS (SELECT u, 0, 0::DOUBLE, -1, NULL::DOUBLE, false FROM z WHERE i = 1 UNION ALL
             SELECT z.u, z.i, z.t, CASE WHEN z.label = 'view' AND (w.gone IS NULL OR z.t - w.gone > 7200) THEN w.walk + 1 ELSE w.walk END, CASE WHEN z.label IN ('view', 'click') THEN NULL ELSE z.t END, z.label = 'view' FROM w JOIN z ON z.u = w.u AND z.i = w.i + 1)
           SELECT u AS user_id, t AS "at", walk::BIGINT AS walk FROM w WHERE is_start""",
    ),
    "lab_run_accumulator": (
        lambda s, d: lab_runs(events(s, d).selectExpr("capture AS key", "seq", "CASE WHEN seq >= 9000 AND label = 'error' THEN 'stop' ELSE 'sample' END AS kind", "CASE WHEN seq % 17 > 0 THEN label END AS metric", "CASE WHEN seq % 5 > 0 THEN score END AS value"), 3).select(F.col("key").alias("user_id"), "metric", "n", F.round("total", 6).alias("total"), "lowest", "highest"),
        """WITH RECURSIVE e AS (SELECT user_id AS u, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, CASE WHEN event_id % 17 > 0 THEN event_type ELSE '' END AS m, CASE WHEN event_id % 5 > 0 THEN value / 500 END AS v, event_id >= 9000 AND event_type = 'error' AS stop FROM events),
           w(u, i, names, halted, name, v) AS (SELECT u, 0, []::VARCHAR[], false, NULL::VARCHAR, NULL::DOUBLE FROM e WHERE i = 1 UNION ALL SELECT e.u, e.i, CASE WHEN e.v IS NOT NULL AND NOT list_contains(w.names, e.m) AND len(w.names) < 3 THEN list_append(w.names, e.m) ELSE w.names END, w.halted OR e.stop,
             CASE WHEN w.halted OR e.stop OR e.v IS NULL THEN NULL WHEN list_contains(w.names, e.m) OR len(w.names) < 3 THEN e.m ELSE '(other)' END, e.v FROM w JOIN e ON e.u = w.u AND e.i = w.i + 1)
           SELECT u AS user_id, name AS metric, count(*) AS n, round(sum(v), 6) AS total, min(v) AS lowest, max(v) AS highest FROM w WHERE name IS NOT NULL GROUP BY u, name""",
    ),
}
