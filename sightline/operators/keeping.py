"""Stores: derived tables with their digest, owned blobs, purges with their report, feeds to subscribers; oracles are texts of their own."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.streaming import folds
from sightline.streaming.keyed import fold_table

from .tables import events, table


def write_derived(tables: dict[str, DataFrame], path: str, manifest: DataFrame) -> None:
    """Each table by session_id, then the manifest (session_id, input_digest): a reader that finds the manifest finds the tables."""
    for name, df in tables.items():
        df.write.mode("overwrite").partitionBy("session_id").parquet(f"{path}/{name}")
    manifest.write.mode("overwrite").parquet(f"{path}/manifest")


def read_derived(spark: SparkSession, path: str, name: str, wanted: DataFrame) -> DataFrame:
    """Rows of a derived table for the sessions whose manifest has the wanted digest (session_id, input_digest); others are absent."""
    fit = spark.read.parquet(f"{path}/manifest").join(wanted, ["session_id", "input_digest"], "left_semi")
    return spark.read.parquet(f"{path}/{name}").join(fit, "session_id", "left_semi")


def derived_currency(manifests: DataFrame, inputs: DataFrame) -> DataFrame:
    """manifests (session_id, input_digest), inputs (session_id, now) -> current: true, false, or null where one side isn't known."""
    j = manifests.join(inputs, "session_id", "full")
    return j.select("session_id", (F.col("input_digest") == F.col("now")).alias("current"))


def owned_keyframe_store(writes: DataFrame, most_bytes: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """writes (id, seq, image) -> (the blob of each id, its first good write), (reason, n of refusals).

    An id is 8 to 64 hex digits; an image is a JPEG of at most that size; an id that has a blob keeps it.
    """
    n = F.octet_length("image")
    reason = F.when(~F.coalesce(F.col("id").rlike("^[0-9a-f]{8,64}$"), F.lit(False)), "bad-id").when(F.col("image").isNull() | (n == 0), "no-image").when(n > most_bytes, "too-large").when(F.hex(F.substring("image", 1, 3)) != "FFD8FF", "not-an-image")
    w = writes.withColumn("reason", reason)
    w = w.withColumn("k", F.when(F.col("reason").isNull(), F.expr("row_number() OVER (PARTITION BY id, reason IS NULL ORDER BY seq)")))
    w = w.withColumn("reason", F.when(F.col("k") > 1, "already-there").otherwise(F.col("reason")))
    return w.where("reason IS NULL").select("id", "image"), w.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


def prune_purge(observations: DataFrame, blobs: DataFrame, cutoff: float | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """observations (id, recorded_at), blobs (id, length) -> (kept observations, kept blobs, one row: removed, retained, blobs_removed, bytes_removed, complete).

    What readers wouldn't see goes: the same predicate, negated. Blobs go with their observation, and those nobody owns too.
    complete: no blob is left without an observation.
    """
    live = F.lit(True) if cutoff is None else F.coalesce((F.col("recorded_at") >= cutoff) & ~F.isnan("recorded_at"), F.lit(False))
    kept = observations.where(live)
    own = blobs.join(kept.select("id").distinct(), "id", "left_semi")
    report = observations.agg(F.count_if(~live).alias("removed"), F.count_if(live).alias("retained"))
    gone = blobs.join(kept.select("id").distinct(), "id", "left_anti").agg(F.count("*").alias("blobs_removed"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes_removed"))
    left = own.join(kept, "id", "left_anti").agg((F.count("*") == 0).alias("complete"))
    return kept, own, report.crossJoin(gone).crossJoin(left)  # one row each


# ---- bindings


def _fold(fold, out, *columns):
    step, close = fold if isinstance(fold, tuple) else (fold, None)
    return lambda s, d: fold_table(events(s, d).selectExpr("capture AS user_id", "seq", "t / 1000000 AS at", *columns), "user_id", ["seq"], step, f"user_id long, {out}", close)


def _sightings(s, d):
    rows = events(s, d).selectExpr("concat(capture, ':', label) AS key", "seq", "t / 1000000 AS at", "score")
    step, close = folds.sighting_updates(gap=86400.0, every=43200.0)
    return fold_table(rows, "key", ["at", "seq"], step, "key string, " + folds.UPDATES, close)


def _blobs(s, d):
    return table(s, d, "events").selectExpr("CASE WHEN event_id % 9 = 0 THEN 'NOT HEX' ELSE substr(md5(CAST(event_id DIV 3 AS STRING)), 1, 12) END AS id", "event_id AS seq", "CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN X'00' WHEN 2 THEN unhex(concat('FFD8FF', repeat('00', 100))) ELSE X'FFD8FFE0' END AS image")


_Z = "z AS (SELECT user_id AS u, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, epoch_us(ts) / 1000000 AS t, event_type AS label, value / 500 AS v, event_id AS seq FROM events)"

OPS = {
    "derived_currency": (
        lambda s, d: derived_currency(table(s, d, "customer").where("c_custkey % 4 > 0").selectExpr("c_custkey AS session_id", "sha2(CAST(c_custkey % 100 AS STRING), 256) AS input_digest"), table(s, d, "customer").where("c_custkey % 5 > 0").selectExpr("c_custkey AS session_id", "sha2(CAST(c_custkey % 100 + CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS STRING), 256) AS now")),
        "SELECT c_custkey AS session_id, CASE WHEN c_custkey % 4 > 0 AND c_custkey % 5 > 0 THEN c_custkey % 3 > 0 END AS current FROM customer WHERE c_custkey % 20 > 0",
    ),
    "owned_keyframe_store": (
        lambda s, d: owned_keyframe_store(_blobs(s, d), 50)[1],
        """WITH b AS (SELECT event_id AS k, event_id // 3 AS o, CASE WHEN event_id % 9 = 0 THEN 'bad-id' WHEN event_id % 7 = 0 THEN 'no-image' WHEN event_id % 7 = 2 THEN 'too-large' WHEN event_id % 7 = 1 THEN 'not-an-image' END AS r FROM events),
           g AS (SELECT *, CASE WHEN r IS NULL AND k > min(k) FILTER (r IS NULL) OVER (PARTITION BY o) THEN 'already-there' ELSE r END AS reason FROM b) SELECT reason, count(*) AS n FROM g WHERE reason IS NOT NULL GROUP BY reason""",
    ),
    "prune_purge": (
        lambda s, d: prune_purge(table(s, d, "events").selectExpr("event_id AS id", "CASE WHEN event_id % 11 > 0 THEN value END AS recorded_at"), table(s, d, "events").where("event_id % 2 = 0").selectExpr("CASE WHEN event_id % 10 = 0 THEN -1 - event_id ELSE event_id END AS id", "event_id AS length"), 60.0)[2],
        """WITH e AS (SELECT event_id AS k, event_id % 11 > 0 AND value >= 60 AS live FROM events) SELECT count(*) FILTER (NOT live) AS removed, count(*) FILTER (live) AS retained, count(*) FILTER (k % 2 = 0 AND (NOT live OR k % 10 = 0)) AS blobs_removed, (sum(k) FILTER (k % 2 = 0 AND (NOT live OR k % 10 = 0)))::BIGINT AS bytes_removed, true AS complete FROM e""",
    ),
    "sighting_tracker": (
        _sightings,
        """WITH RECURSIVE o AS (SELECT user_id || ':' || event_type AS key, event_id AS seq, epoch_us(ts) / 1000000 AS t, value / 500 AS v, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
           w(key, i, n, f, l, k, best, said, kind, p) AS (SELECT key, i, n, t, t, 1, v, NULL::DOUBLE, '', NULL::STRUCT(f DOUBLE, l DOUBLE, k INT, best DOUBLE) FROM o WHERE i = 1 UNION ALL
             SELECT o.key, o.i, o.n, CASE WHEN o.t - w.l > 86400 THEN o.t ELSE w.f END, o.t, CASE WHEN o.t - w.l > 86400 THEN 1 ELSE w.k + 1 END, CASE WHEN o.t - w.l > 86400 OR o.v > w.best THEN o.v ELSE w.best END,
               CASE WHEN o.t - w.l > 86400 THEN NULL WHEN w.k = 2 OR w.k > 2 AND (o.v > w.best OR o.t - w.said >= 43200) THEN o.t ELSE w.said END,
               CASE WHEN o.t - w.l > 86400 THEN '' WHEN w.k = 2 THEN 'record' WHEN w.k > 2 AND (o.v > w.best OR o.t - w.said >= 43200) THEN 'update' ELSE '' END,
               CASE WHEN o.t - w.l > 86400 AND w.k >= 3 THEN struct_pack(f := w.f, l := w.l, k := w.k, best := w.best) END FROM w JOIN o ON o.key = w.key AND o.i = w.i + 1)
           SELECT key, kind, f AS first_at, l AS last_at, k::BIGINT AS frames, best FROM w WHERE kind <> '' UNION ALL SELECT key, 'close', p.f, p.l, p.k, p.best FROM w WHERE p IS NOT NULL UNION ALL SELECT key, 'close', f, l, k, best FROM w WHERE i = n AND k >= 3""",
    ),
    "result_publish": (
        _fold(folds.publish_slot(7200.0), "at double, kind string, revision long, coalesced long", "CASE WHEN label = 'view' THEN 'take' ELSE 'offer' END AS what", "seq DIV 200 % 3 AS revision"),
        f"""WITH RECURSIVE {_Z}, w(u, i, t, pend, co, sent, sent_at, kind, rev, shown) AS (SELECT u, 0, 0::DOUBLE, NULL::BIGINT, 0, NULL::BIGINT, NULL::DOUBLE, '', NULL::BIGINT, 0 FROM z WHERE i = 1 UNION ALL
            SELECT z.u, z.i, z.t, CASE WHEN z.label = 'view' THEN NULL WHEN z.seq // 200 % 3 IS NOT DISTINCT FROM coalesce(w.pend, w.sent) THEN w.pend ELSE z.seq // 200 % 3 END,
              CASE WHEN z.label = 'view' THEN 0 WHEN w.pend IS NOT NULL AND z.seq // 200 % 3 <> w.pend THEN w.co + 1 ELSE w.co END, CASE WHEN z.label = 'view' AND w.pend IS NOT NULL THEN w.pend ELSE w.sent END,
              CASE WHEN z.label = 'view' AND (w.pend IS NOT NULL OR w.sent IS NOT NULL AND z.t - w.sent_at >= 7200) THEN z.t ELSE w.sent_at END,
              CASE WHEN z.label <> 'view' THEN '' WHEN w.pend IS NOT NULL THEN 'change' WHEN w.sent IS NOT NULL AND z.t - w.sent_at >= 7200 THEN 'heartbeat' ELSE '' END, coalesce(w.pend, w.sent), w.co FROM w JOIN z ON z.u = w.u AND z.i = w.i + 1)
            SELECT u AS user_id, t AS "at", kind, rev AS revision, CASE WHEN kind = 'change' THEN shown ELSE 0 END::BIGINT AS coalesced FROM w WHERE kind <> ''""",
    ),
    "session_summaries": (
        lambda s, d: events(s, d).where("label <> 'error'").selectExpr("capture", "score", "row_number() OVER (PARTITION BY capture ORDER BY seq) AS k").groupBy("capture", F.floor((F.col("k") - 1) / 15).alias("part")).agg(F.max("k").alias("frames"), F.round(F.avg("score"), 6).alias("mean"), F.count("*").alias("n")).where("n = 15").select("capture", "frames", "mean"),
        "WITH e AS (SELECT user_id AS capture, value / 500 AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_type <> 'error') SELECT a.capture, a.k AS frames, round(avg(b.v), 6) AS mean FROM e a JOIN e b ON a.capture = b.capture AND b.k > a.k - 15 AND b.k <= a.k WHERE a.k % 15 = 0 GROUP BY ALL",
    ),
    "bounded_queue_drop_oldest": (
        _fold(folds.bounded_queue(3), "item long, dropped long", "CASE WHEN label = 'view' THEN 'take' ELSE 'offer' END AS kind", "seq AS item"),
        f"""WITH RECURSIVE {_Z}, w(u, i, q, dropped, item, took) AS (SELECT u, 0, []::BIGINT[], 0, NULL::BIGINT, false FROM z WHERE i = 1 UNION ALL
            SELECT z.u, z.i, CASE WHEN z.label = 'view' THEN w.q[2:] ELSE list_append(w.q, z.seq)[greatest(1, len(w.q) - 1):] END, w.dropped + (z.label <> 'view' AND len(w.q) = 3)::INT, CASE WHEN z.label = 'view' THEN w.q[1] END, z.label = 'view' FROM w JOIN z ON z.u = w.u AND z.i = w.i + 1)
            SELECT u AS user_id, item, dropped::BIGINT AS dropped FROM w WHERE took""",
    ),
    "segment_index": (
        _fold(folds.segment_index(), "seq long, segment long", "label = 'error' AS lost", "label = 'purchase' AS broken", "label IN ('view', 'purchase') AS keyframe"),
        f"""WITH RECURSIVE {_Z}, w(u, i, seq, seg, bare, spent, due) AS (SELECT u, 0, 0::BIGINT, 0, true, 0, false FROM z WHERE i = 1 UNION ALL
            SELECT u, i, seq, seg + opens::INT, CASE WHEN opens THEN NOT key ELSE bare AND NOT key END, CASE WHEN opens THEN CASE WHEN bare THEN spent + 1 ELSE 0 END ELSE spent END, label = 'purchase' FROM (
              SELECT z.u, z.i, z.seq, z.label, z.label IN ('view', 'purchase') AS key, w.seg, w.bare, w.spent, (z.label = 'error' OR w.due) AND (NOT w.bare OR w.spent < 1) AS opens FROM w JOIN z ON z.u = w.u AND z.i = w.i + 1) q)
            SELECT u AS user_id, seq, seg::BIGINT AS segment FROM w WHERE i > 0""",
    ),
    "content_segments": (
        _fold(folds.content_segments(), folds.CONTENT, "CASE WHEN seq % 6 > 0 THEN seq % 10 / 9 + CASE WHEN seq % 500 < 200 THEN -1 ELSE 0 END END AS alike"),
        f"""WITH RECURSIVE {_Z}, x AS (SELECT u, i, seq, CASE WHEN seq % 6 > 0 THEN seq % 10 / 9 - (seq % 500 < 200)::INT END AS a, count(*) OVER (PARTITION BY u) AS n FROM z),
            w(u, i, n, seg, f, k, pk, pf, o) AS (SELECT u, i, n, 0, seq, 1, 0, 0::BIGINT, NULL::STRUCT(s INT, f BIGINT, k INT) FROM x WHERE i = 1 UNION ALL
              SELECT x.u, x.i, w.n, CASE WHEN x.a < 0.45 AND w.pk = 2 THEN w.seg + 1 ELSE w.seg END, CASE WHEN x.a < 0.45 AND w.pk = 2 THEN w.pf ELSE w.f END, CASE WHEN x.a IS NULL THEN w.k + 1 WHEN x.a >= 0.45 THEN w.k + 1 + w.pk WHEN w.pk = 2 THEN 3 ELSE w.k END,
                CASE WHEN x.a IS NULL THEN w.pk WHEN x.a >= 0.45 OR w.pk = 2 THEN 0 ELSE w.pk + 1 END, CASE WHEN x.a < 0.45 AND w.pk = 0 THEN x.seq ELSE w.pf END, CASE WHEN x.a < 0.45 AND w.pk = 2 THEN struct_pack(s := w.seg, f := w.f, k := w.k) END FROM w JOIN x ON x.u = w.u AND x.i = w.i + 1),
            s AS (SELECT u, o.s AS s, o.f AS f, o.k AS k FROM w WHERE o IS NOT NULL UNION ALL SELECT u, seg, f, k + pk FROM w WHERE i = n)
            SELECT u AS user_id, s::BIGINT AS segment, f AS first_seq, k::BIGINT AS frames FROM s QUALIFY row_number() OVER (PARTITION BY u ORDER BY s DESC) <= 6""",
    ),
}
