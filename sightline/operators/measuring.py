"""Aggregates, reports and fits over their own columns, bound to the driver's tables; oracles are texts of their own."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import DUCK_EVENTS, events, table


def _div(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0))


# ---- transport and lab metrics


def session_metrics(frames: DataFrame, stages: DataFrame) -> DataFrame:
    """frames (session, arrival, seq, tx_seq, at, bytes, latency, accepted), stages (session, stage, ms) -> a row a session.

    Gaps in seq count accepted rows, gaps in tx_seq all that carry one; with none they are null, not 0. A session lasts from
    its first row to its last, refused ones too, at least a nanosecond; fps are accepted frames and bandwidth is bytes, each
    over that time. Means and maxima of nothing are 0.
    """
    w = "PARTITION BY session ORDER BY arrival"
    seq = f"CASE WHEN accepted THEN greatest(seq - lag(CASE WHEN accepted THEN seq END) IGNORE NULLS OVER ({w}) - 1, 0) END AS seq_gap"
    tx = f"CASE WHEN tx_seq IS NOT NULL THEN greatest(tx_seq - lag(tx_seq) IGNORE NULLS OVER ({w}) - 1, 0) END AS tx_gap"
    ok = lambda c: F.when(F.col("accepted"), c)
    f = frames.selectExpr("*", seq, tx).groupBy("session").agg(
        F.count_if("accepted").alias("frames"), F.count_if(~F.col("accepted")).alias("rejected"), F.coalesce(F.sum(ok(F.col("bytes"))), F.lit(0)).alias("total_bytes"), F.coalesce(F.sum("seq_gap"), F.lit(0)).alias("seq_gaps"),
        F.when(F.count("tx_seq") > 0, F.coalesce(F.sum("tx_gap"), F.lit(0))).alias("tx_gaps"), F.coalesce(F.avg(ok(F.col("latency"))), F.lit(0.0)).alias("latency_mean"), F.coalesce(F.max(ok(F.col("latency"))), F.lit(0.0)).alias("latency_max"), (F.max("at") - F.min("at")).alias("span"),
    )
    span = F.greatest(F.coalesce("span", F.lit(0.0)), F.lit(1e-9))
    f = f.withColumn("fps", F.col("frames") / span).withColumn("bandwidth", F.col("total_bytes") / span).drop("span")
    per = stages.groupBy("session", "stage").agg(F.coalesce(F.avg("ms"), F.lit(0.0)).alias("mean"), F.coalesce(F.max("ms"), F.lit(0.0)).alias("max"))
    return f.join(per.groupBy("session").agg(F.sort_array(F.collect_list(F.struct("stage", "mean", "max"))).alias("stages")), "session", "left")


def typed_metrics(rows: DataFrame, kinds: DataFrame) -> DataFrame:
    """rows (run, metric, value), kinds (metric, kind) -> run, metric, kind, value, varied, frames; an undeclared metric raises.

    rate: mean; count: sum; constant: the value, or null and varied if it isn't one; unaggregated: frames only.
    """
    known = rows.join(kinds, "metric", "left").withColumn("kind", F.coalesce("kind", F.raise_error(F.concat(F.lit("undeclared metric "), F.coalesce("metric", F.lit("null"))))))
    out = known.groupBy("run", "metric", "kind").agg(F.avg("value").alias("mean"), F.sum("value").alias("total"), F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("frames"))
    varied = (F.col("kind") == "constant") & F.coalesce(F.col("low") < F.col("high"), F.lit(False))
    value = F.when(F.col("kind") == "rate", F.col("mean")).when(F.col("kind") == "count", F.col("total")).when((F.col("kind") == "constant") & ~varied, F.col("low"))
    return out.select("run", "metric", "kind", value.alias("value"), varied.alias("varied"), "frames")


def corpus_metrics(rows: DataFrame, kinds: DataFrame, most: int = 16) -> DataFrame:
    """rows (metric, value, failed), kinds (metric, kind) -> metric, kind, value, frames over a corpus; failed frames count for nothing, an undeclared metric raises.

    rate: its mean; count: its sum; constant: a row a distinct value, with its frames, and more than `most` of them raise; unaggregated: frames only.
    """
    known = rows.where(~F.col("failed")).join(kinds, "metric", "left").withColumn("kind", F.coalesce("kind", F.raise_error(F.concat(F.lit("undeclared metric "), F.coalesce("metric", F.lit("null"))))))
    per = known.groupBy("metric", "kind", F.when(F.col("kind") == "constant", F.col("value")).alias("own")).agg(F.count("*").alias("frames"), F.avg("value").alias("mean"), F.sum("value").alias("total"))
    per = per.selectExpr("*", "count(own) OVER (PARTITION BY metric) AS distinct_values")
    checked = F.when((F.col("kind") == "constant") & (F.col("distinct_values") > most), F.raise_error(F.concat(F.col("metric"), F.lit(f" is declared constant but has more than {most} values"))))
    value = F.when(F.col("kind") == "rate", F.col("mean")).when(F.col("kind") == "count", F.col("total")).when(F.col("kind") == "constant", F.coalesce(checked.cast("double"), F.col("own")))
    return per.select("metric", "kind", value.alias("value"), "frames")


def corpus_benchmark(rows: DataFrame) -> DataFrame:
    """rows (capture, ms, failed) -> a row a capture and one for the corpus (capture null): frames, failed, mean and p95 of those that didn't fail."""
    good = F.when(~F.col("failed"), F.col("ms"))
    ranked = rows.rollup("capture").agg(F.count("*").alias("frames"), F.count_if("failed").alias("failed"), F.avg(good).alias("mean"), F.grouping("capture").alias("whole"))
    # the p95 by counts of distinct values, so that no task holds all rows of a capture
    counts = rows.where(~F.col("failed")).groupBy("capture", "ms").agg(F.count("*").alias("n"))
    counts = counts.unionByName(rows.where(~F.col("failed")).groupBy("ms").agg(F.count("*").alias("n")).selectExpr("CAST(NULL AS BIGINT) AS capture", "ms", "n"))
    p95 = percentile_by_rank(counts, "capture", "ms", low=True)
    return ranked.join(p95, ranked.capture.eqNullSafe(p95.group), "left").select(ranked.capture, (F.col("whole") == 1).alias("corpus"), "frames", "failed", "mean", F.col("value").alias("p95"))


def _blocked(rows: DataFrame, group: Column, order: str, blocks: int = 64) -> DataFrame:
    """rows with _group and _block: ranges of `order` within each group, about even, by approximate bounds; a value lies in one block only."""
    bounds = rows.groupBy(group.alias("_g")).agg(F.percentile_approx(order, F.array(*(F.lit(i / blocks) for i in range(1, blocks))), 10_000).alias("_bounds"))
    tagged = rows.withColumn("_group", group).join(bounds, F.col("_group").eqNullSafe(F.col("_g")))
    return tagged.withColumn("_block", F.size(F.filter("_bounds", lambda x: x < F.col(order)))).drop("_g", "_bounds")


def _ahead(blocked: DataFrame, n: Column) -> DataFrame:
    """(_g, _b, ahead, own, total): of each block the sum of n in the blocks before, in it and in all of its group."""
    per = blocked.groupBy("_group", "_block").agg(F.sum(n).alias("own"))
    w = "PARTITION BY _group ORDER BY _block"
    return per.selectExpr("_group AS _g", "_block AS _b", "own", f"coalesce(sum(own) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead", "sum(own) OVER (PARTITION BY _group) AS total")


def _same(df: DataFrame, per: DataFrame) -> DataFrame:
    return df.join(per, F.col("_group").eqNullSafe(F.col("_g")) & (F.col("_block") == F.col("_b"))).drop("_g", "_b")


def percentile_by_rank(counts: DataFrame, group: str, value: str, low: bool, share: float = 0.95, rank: Callable[[Column], Column] | None = None) -> DataFrame:
    """counts (group, value, n) -> group, value at rank max(1, floor(share n)) (low) or min(n, floor(share n) + 1) of sorted values, or at a rank of its own.

    Sums of blocks of values tell which one holds the rank; only that block's distinct values are put in order.
    """
    c = _blocked(counts.where(F.col(value).isNotNull()).select(F.col(group).alias("group"), F.col(value).alias("value"), "n"), F.col("group"), "value")
    usual = F.greatest(F.lit(1), F.floor(share * F.col("total"))) if low else F.least(F.col("total"), F.floor(share * F.col("total")) + 1)
    per = _ahead(c, F.col("n")).withColumn("rank", rank(F.col("total")) if rank else usual).where((F.col("ahead") < F.col("rank")) & (F.col("rank") <= F.col("ahead") + F.col("own")))
    c = _same(c, per).withColumn("upto", F.expr("ahead + sum(n) OVER (PARTITION BY group ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"))
    return c.where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank"))).select("group", "value")


def _p95(low):
    return lambda s, d: percentile_by_rank(events(s, d).groupBy("label", "score").agg(F.count("*").alias("n")), "label", "score", low).selectExpr("group AS label", "value AS p95")


def refusal_tally(rows: DataFrame, vocabulary: list[str]) -> DataFrame:
    """rows (reason, null: processed; 'failed') -> reason, n over the closed vocabulary, zeros too, with offered = processed + refused + failed beside each."""
    words = rows.sparkSession.createDataFrame([(w,) for w in vocabulary], "reason string")
    n = rows.groupBy("reason").agg(F.count("*").alias("n"))
    sums = n.agg(F.sum("n").alias("offered"), F.coalesce(F.sum(F.when(F.col("reason").isNull(), F.col("n"))), F.lit(0)).alias("processed"), F.coalesce(F.sum(F.when(F.col("reason") == "failed", F.col("n"))), F.lit(0)).alias("failed"))
    return words.join(n, "reason", "left").select("reason", F.coalesce("n", F.lit(0)).alias("n")).crossJoin(F.broadcast(sums))


def sender_metrics(frames: DataFrame) -> DataFrame:
    """frames (session, at, encode_ms, send_ms, delivered, refused) -> counts, rates (null under half a second), means; what is neither delivered nor refused is unaccounted."""
    f = frames.groupBy("session").agg(F.count("*").alias("sent"), F.count_if("delivered").alias("delivered"), F.count_if("refused").alias("refused"), F.avg("encode_ms").alias("encode_mean"), F.max("encode_ms").alias("encode_max"), F.avg("send_ms").alias("send_mean"), F.max("send_ms").alias("send_max"), (F.max("at") - F.min("at")).alias("span"))
    long = F.when(F.col("span") >= 0.5, F.col("span"))
    return f.withColumn("rate", F.col("sent") / long).withColumn("delivered_fraction", _div(F.col("delivered"), F.col("sent"))).withColumn("unaccounted", F.col("sent") - F.col("delivered") - F.col("refused")).drop("span")


def live_load_report(frames: DataFrame) -> DataFrame:
    """frames (session, at, skipped, cpu_s) -> skip_fraction, fps, cpu_per_frame of frames that ran; null where there is nothing to divide by."""
    f = frames.groupBy("session").agg(F.count("*").alias("offered"), F.count_if("skipped").alias("skipped"), F.sum("cpu_s").alias("cpu"), (F.max("at") - F.min("at")).alias("span"))
    return f.select("session", _div(F.col("skipped"), F.col("offered")).alias("skip_fraction"), _div(F.col("offered") - F.col("skipped"), F.col("span")).alias("fps"), _div(F.col("cpu"), F.col("offered") - F.col("skipped")).alias("cpu_per_frame"))


# ---- scenes


def fixed_arity_pivot(tracks: DataFrame, labels: list[str], sides: list[str]) -> DataFrame:
    """tracks (label, side, counted) -> every label of the list with a count for every side, zeros too; only counted tracks count."""
    words = tracks.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    n = tracks.where("counted").groupBy("label").pivot("side", sides).count()
    return words.join(n, "label", "left").fillna(0)


def count_by_label(tracks: DataFrame) -> DataFrame:
    """tracks (label, counted, partial) -> label, n, partial_n: counted tracks; people seen in part apart."""
    return tracks.where("counted").groupBy("label").agg(F.count_if(~((F.col("label") == "person") & F.col("partial"))).alias("n"), F.count_if((F.col("label") == "person") & F.col("partial")).alias("partial_n"))


def people_block(people: DataFrame) -> DataFrame:
    """people (scene, size, facing null or boolean, age) -> counts by size, facing or null with a reason, age of the oldest estimate."""
    known = F.count("facing") > 0
    return people.groupBy("scene").agg(F.count("*").alias("people"), *(F.count_if(F.col("size") == s).alias(s) for s in ("small", "medium", "large")), F.when(known, F.count_if("facing")).alias("facing"), F.when(~known, F.lit("not-established")).alias("reason"), F.max(F.when(F.col("facing").isNotNull(), F.col("age"))).alias("oldest"))


def event_summary(rows: DataFrame, reasons: list[str]) -> DataFrame:
    """rows (world, id, kind, reason; kind null: corrupt) -> counts by kind, rejected ones by reason, the last about tracking, stopped, corrupt."""
    about = F.col("kind").isin("keyframe_accepted", "tracking_lost")
    return rows.groupBy("world").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("keyframe_accepted", "frame_rejected", "tracking_lost")), *(F.count_if((F.col("kind") == "frame_rejected") & (F.col("reason") == r)).alias(f"rejected_{r}") for r in reasons), F.max_by(F.when(about, F.col("kind")), F.when(about, F.col("id"))).alias("last_tracking"), F.bool_or(F.col("kind") == "stopped").alias("stopped"), F.count_if(F.col("kind").isNull()).alias("corrupt"))


def pose_summary(poses: DataFrame) -> DataFrame:
    """poses (world, segment, status) -> solved, anchors, refused, positioned: of a segment the solved and, if there are any, its anchors."""
    seg = poses.groupBy("world", "segment").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("solved", "anchor", "refused")))
    return seg.groupBy("world").agg(F.sum("solved").alias("solved"), F.sum("anchor").alias("anchors"), F.sum("refused").alias("refused"), F.sum(F.col("solved") + F.when(F.col("solved") > 0, F.col("anchor")).otherwise(0)).alias("positioned"))


def status_histogram(poses: DataFrame, points: DataFrame) -> DataFrame:
    """poses (status, degeneracy, segment), points (segment) -> one table of (what, name, n): statuses, degeneracies that aren't empty, segments, points."""
    kind = lambda what, df, name: df.groupBy(name.alias("name")).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "name", "n")
    return kind("status", poses, F.col("status")).union(kind("degeneracy", poses.where("degeneracy <> ''"), F.col("degeneracy"))).union(
        poses.agg(F.count_distinct("segment").alias("n")).selectExpr("'segments'", "NULL", "n")).union(points.agg(F.count("*").alias("n")).selectExpr("'points'", "NULL", "n"))


def segment_manifest(keyframes: DataFrame, points: DataFrame) -> DataFrame:
    """keyframes (segment, id, status), points (segment, x, y) -> counts, bounds, content hash of the ordered ids, state, coverage; a segment of either side."""
    k = keyframes.groupBy("segment").agg(F.count("*").alias("keyframes"), F.count_if(F.col("status") == "solved").alias("solved"), ordered_digest(F.col("id")).alias("hash"))
    p = points.groupBy(F.col("segment").alias("_s")).agg(F.count("*").alias("points"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    out = k.join(p, F.col("segment").eqNullSafe(F.col("_s")), "full").withColumn("segment", F.coalesce("segment", "_s")).drop("_s")
    out = out.fillna(0, ["keyframes", "solved", "points"])
    state = F.when(F.col("points") == 0, "empty").when(F.col("solved") == 0, "unresolved").when(F.col("solved") < F.col("keyframes"), "partial").otherwise("resolved")
    return out.withColumn("state", state).withColumn("coverage", _div(F.col("solved"), F.col("keyframes")))


def ordered_digest(value: Column) -> Column:
    """SHA-256 over all of a group's values in order, 16 hex digits."""
    return F.substring(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(value)), lambda x: x.cast("string")), "\0"), 256), 1, 16)


def coherence_share(points: DataFrame) -> DataFrame:
    """points (segment, component) -> segments with geometry, the largest one's points and share (null if there are none), and of each component its share, rounded to 4."""
    seg = points.groupBy("component", "segment").agg(F.count("*").alias("n"))
    whole = seg.agg(F.count("*").alias("segments"), F.max("n").alias("largest"), F.sum("n").alias("total"))
    comp = seg.groupBy("component").agg(F.sum("n").alias("points"))
    return whole.join(comp, how="left").select("component", "segments", "largest", F.round(_div(F.col("largest"), F.col("total")), 4).alias("largest_share"), F.round(_div(F.col("points"), F.col("total")), 4).alias("share"))


def fragment_counts(points: DataFrame, least_points: int = 20, card: float = 140.0, margin: float = 0.9, legible: float = 20.0) -> DataFrame:
    """points (segment, x, z) -> drawable segments (with enough points), and the legible ones of them: fitted by their whole extent to a card
    `card` wide, with the margin, their core, from the 2nd to the 98th percentile of x or z, is at least `legible` wide."""
    band = lambda c: F.percentile(c, 0.98) - F.percentile(c, 0.02)
    wide = lambda c: F.greatest(F.max(c) - F.min(c), F.lit(1e-6))
    s = points.groupBy("segment").agg(F.count("*").alias("n"), (F.least(card / wide("x"), card / wide("z")) * margin).alias("scale"), F.greatest(band("x"), band("z")).alias("core"))
    drawable = F.col("n") >= least_points
    return s.agg(F.count_if(drawable).alias("drawable"), F.count_if(drawable & (F.col("core") * F.col("scale") >= legible)).alias("legible"))


def corpus_totals(rows: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """rows (largest_share, blowup, wall_seconds, discards map<string, variant>, and `sums`, whole numbers) -> captures; the sum of each of
    `sums`; of each discard key the sum of its numbers (true, text and null are none); the mean share of those that have one (0 if none has);
    wall seconds rounded to 3; the worst blowup, never a mean, and how many can't be measured."""
    value = lambda k: F.element_at("discards", k)
    number = lambda k: F.when(F.schema_of_variant(value(k)).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(value(k), "$", "double"))
    return rows.agg(
        F.count("*").alias("captures"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums), *(F.coalesce(F.sum(number(k)), F.lit(0.0)).alias(f"discard_{k}") for k in keys),
        F.coalesce(F.avg("largest_share"), F.lit(0.0)).alias("mean_share"), F.round(F.coalesce(F.sum("wall_seconds"), F.lit(0.0)), 3).alias("wall_seconds"), F.max("blowup").alias("worst_blowup"), F.count_if(F.col("blowup").isNull()).alias("unmeasurable"),
    )


def voxel_reduce(points: DataFrame, size: float) -> DataFrame:
    """x, y, z, r, g, b, confidence -> a row a cell: mean place, mean colour cut to whole numbers, the highest confidence."""
    cell = [F.floor(F.col(c) / size).alias(f"i{c}") for c in "xyz"]
    return points.groupBy(*cell).agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in "xyz"), *(F.floor(F.avg(c)).cast("int").alias(c) for c in "rgb"), F.max("confidence").alias("confidence"))


def last_seen(rows: DataFrame, recordable: list[str], asked: list[str]) -> DataFrame:
    """rows (label, at, seq, capture) -> of each asked class the latest row (the first of equal times), and whether it was seen and could be recorded."""
    words = rows.sparkSession.createDataFrame([(x,) for x in asked], "label string")
    best = rows.groupBy("label").agg(F.max_by(F.struct("at", "seq", "capture"), F.struct("at", -F.col("seq"))).alias("b"))
    return words.join(best, "label", "left").select("label", "b.at", "b.seq", "b.capture", F.col("b").isNotNull().alias("observed"), F.col("label").isin(recordable).alias("recordable"))


def label_scoring(frames: DataFrame) -> DataFrame:
    """frames (class, truth, got) -> frames, totals of both, exact, under and over rates and mean absolute error, rounded to 3."""
    rate = lambda c: F.round(F.avg(c.cast("int")), 3)
    return frames.groupBy("class").agg(F.count("*").alias("n"), F.sum("truth").alias("labelled_total"), F.sum("got").alias("engine_total"), rate(F.col("got") == F.col("truth")).alias("exact"), rate(F.col("got") < F.col("truth")).alias("under"), rate(F.col("got") > F.col("truth")).alias("over"), F.round(F.avg(F.abs(F.col("got") - F.col("truth"))), 3).alias("mae"))


def wearer_frames(frames: DataFrame) -> DataFrame:
    """frames (wearer_visible, bystanders, people, partial_bottom, raw_people) -> of those that show the wearer and no bystander (null: none):
    how many, with a person counted, with one put down as partial at the bottom edge, with any box of a person."""
    own = frames.where(F.coalesce("wearer_visible", F.lit(False)) & (F.coalesce("bystanders", F.lit(0)) == 0))
    return own.agg(F.count("*").alias("frames"), *(F.count_if(F.col(c) > 0).alias(n) for c, n in (("people", "false_person"), ("partial_bottom", "routed_to_bottom"), ("raw_people", "any_box"))))


def count_stability(frames: DataFrame) -> DataFrame:
    """frames (rate, count, truth) by dropout rate -> modal count (the smallest of equal ones), distinct counts in order, share that is right."""
    n = frames.groupBy("rate", "count").agg(F.count("*").alias("n"), F.count_if(F.col("count") == F.col("truth")).alias("right"))
    return n.groupBy("rate").agg(F.max_by("count", F.struct("n", -F.col("count"))).alias("modal"), F.sort_array(F.collect_list("count")).alias("counts"), (F.sum("right") / F.sum("n")).alias("correct"))


def bytes_by_tier(files: DataFrame) -> DataFrame:
    """files (world, path, length) -> total, images, derived, journals: by file metadata alone."""
    tier = F.when(F.col("path").rlike(r"\.(jpg|png)$"), "images").when(F.col("path").contains("/derived/"), "derived").when(F.endswith(F.col("path"), F.lit(".jsonl")), "journals")
    return files.withColumn("t", tier).groupBy("world").agg(F.sum("length").alias("total"), *(F.coalesce(F.sum(F.when(F.col("t") == k, F.col("length"))), F.lit(0)).alias(k) for k in ("images", "derived", "journals")))


def path_length(poses: DataFrame, manifests: DataFrame) -> DataFrame:
    """poses (world, seq, status, x, y, z), manifests (world, refused, segments, scale_known) -> a row a manifest: length, or null and the
    reason, the first that holds: refused poses (or not known how many), several segments (or not known), unknown scale; then the first pose in
    order that is neither solved nor an anchor, or has no place; no pose at all."""
    w = "PARTITION BY world ORDER BY seq"
    step = poses.selectExpr("*", *(f"{c} - lag({c}) OVER ({w}) AS d{c}" for c in "xyz"))
    fault = F.when(~F.coalesce(F.col("status").isin("solved", "anchor"), F.lit(False)), "a pose isn't solved").when(F.col("x").isNull() | F.col("y").isNull() | F.col("z").isNull(), "a pose without a place")
    out = step.withColumn("_f", fault).groupBy(F.col("world").alias("_w")).agg(F.min_by(F.col("_f"), F.when(F.col("_f").isNotNull(), F.col("seq"))).alias("fault"), F.sum(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz"))).alias("sum"))
    j = manifests.join(out, F.col("world").eqNullSafe(F.col("_w")), "left")
    reason = (
        F.when(F.col("refused").isNull() | (F.col("refused") > 0), "refused poses").when(F.col("segments").isNull() | (F.col("segments") > 1), "several segments").when(~F.coalesce("scale_known", F.lit(False)), "unknown scale")
        .when(F.col("_w").isNull(), "no pose was solved").otherwise(F.col("fault"))
    )
    return j.select("world", F.when(reason.isNull(), F.coalesce("sum", F.lit(0.0))).alias("length"), reason.alias("reason"))


def spatial_coverage(points: DataFrame, cells: int = 8) -> DataFrame:
    """points (frame, x, y of 0 to 1, response, size) -> share of the grid's cells that hold one, mean response and size."""
    at = lambda c: F.greatest(F.lit(0), F.least(F.lit(cells - 1), F.floor(F.col(c) * cells)))
    return points.groupBy("frame").agg((F.count_distinct(at("x") * cells + at("y")) / (cells * cells)).alias("coverage"), F.avg("response").alias("response"), F.avg("size").alias("size"))


def circular_stats(flow: DataFrame, still: float = 0.0) -> DataFrame:
    """flow (frame, dx, dy; null: lost) -> coherence (length of the mean direction), direction in degrees, median, mean and largest magnitude, tracked share."""
    m = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    f = flow.withColumn("m", m).withColumn("a", F.when(m > still, F.atan2("dy", "dx")))
    return f.groupBy("frame").agg(F.sqrt(F.pow(F.avg(F.cos("a")), 2) + F.pow(F.avg(F.sin("a")), 2)).alias("coherence"), F.degrees(F.atan2(F.avg(F.sin("a")), F.avg(F.cos("a")))).alias("direction"), F.median("m").alias("median"), F.avg("m").alias("mean"), F.max("m").alias("largest"), (F.count("m") / F.count("*")).alias("tracked"))


def histogram_stats(levels: DataFrame, dark: int = 10, bright: int = 245) -> DataFrame:
    """levels (frame, level of 0 to 255, n) -> under- and over-exposed shares, entropy in bits, mean, population standard deviation; all from the histogram."""
    t = levels.where("n > 0").withColumn("p", F.expr("n / sum(n) OVER (PARTITION BY frame)"))
    mean = F.sum(F.col("p") * F.col("level"))
    return t.groupBy("frame").agg(F.sum(F.when(F.col("level") <= dark, F.col("p")).otherwise(0.0)).alias("under"), F.sum(F.when(F.col("level") >= bright, F.col("p")).otherwise(0.0)).alias("over"), (-F.sum(F.col("p") * F.log2("p"))).alias("bits"), mean.alias("mean"), F.sqrt(F.greatest(F.sum(F.col("p") * F.col("level") * F.col("level")) - mean * mean, F.lit(0.0))).alias("std"))


def clock_drift_fit(rows: DataFrame) -> DataFrame:
    """rows (session, seq, host, pts) of two clocks -> elapsed host time; mean, least and largest of host - pts; its slope against host time in
    parts per million, 0 if time stands still; mean, population deviation, least and largest of the steps of both clocks and of their difference (pts
    less host). Sessions under three rows are left out."""
    w = "PARTITION BY session ORDER BY seq"
    d = rows.selectExpr("*", "host - pts AS offset", f"host - first(host) OVER ({w}) AS t", f"pts - lag(pts) OVER ({w}) AS step_pts", f"host - lag(host) OVER ({w}) AS step_host").withColumn("step_both", F.col("step_pts") - F.col("step_host"))
    stats = [x for k in ("pts", "host", "both") for x in (F.avg(f"step_{k}").alias(f"{k}_mean"), F.stddev_pop(f"step_{k}").alias(f"{k}_std"), F.min(f"step_{k}").alias(f"{k}_low"), F.max(f"step_{k}").alias(f"{k}_high"))]
    out = d.groupBy("session").agg(F.count("*").alias("n"), F.max_by("t", "seq").alias("elapsed"), F.avg("offset").alias("mean"), F.min("offset").alias("low"), F.max("offset").alias("high"), F.coalesce(F.regr_slope("offset", "t") * 1e6, F.lit(0.0)).alias("ppm"), *stats)
    return out.where(F.col("n") >= 3)


def flicker_metrics(pixels: DataFrame) -> DataFrame:
    """pixels (pixel, frame, value) -> one row: mean and largest over frames of the mean absolute step, mean of the frames' p95, mean deviation of full windows of five."""
    w = "PARTITION BY pixel ORDER BY frame"
    d = pixels.selectExpr("*", f"abs(value - lag(value) OVER ({w})) AS step", f"CASE WHEN count(value) OVER ({w} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) = 5 THEN stddev_pop(value) OVER ({w} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END AS std5")
    per = d.groupBy("frame").agg(F.avg("step").alias("m"), F.percentile("step", 0.95).alias("p"), F.sum("std5").alias("s"), F.count("std5").alias("k"))
    return per.agg(F.avg("m").alias("mean_step"), F.max("m").alias("largest_step"), F.avg("p").alias("mean_p95"), _div(F.sum("s"), F.sum("k")).alias("mean_std5"))


def area_weighted_mean(faces: DataFrame) -> DataFrame:
    """faces (a, b, c, area, value) -> vertex, value: over the faces around it, weighted by area; null where they have none."""
    return faces.select(F.explode(F.array("a", "b", "c")).alias("vertex"), "area", "value").groupBy("vertex").agg(_div(F.sum(F.col("area") * F.col("value")), F.sum("area")).alias("value"))


def power_fit(rows: DataFrame) -> DataFrame:
    """rows (g, x, y) -> y = a x^b in logarithms: a, b, r2, n, dropped; rows that aren't above 0 are dropped and counted, under 3 left nothing is fitted."""
    ok = F.coalesce((F.col("x") > 0) & (F.col("y") > 0), F.lit(False))
    x, y = F.when(ok, F.log(F.when(ok, F.col("x")))), F.when(ok, F.log(F.when(ok, F.col("y"))))
    f = rows.groupBy("g").agg(F.count_if(ok).alias("n"), F.count_if(~ok).alias("dropped"), F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("i"), F.regr_r2(y, x).alias("r2"))
    enough = F.col("n") >= 3
    return f.select("g", "n", "dropped", F.when(enough, F.exp("i")).alias("a"), F.when(enough, F.col("b")).alias("b"), F.when(enough, F.col("r2")).alias("r2"))


def ranked(rows: DataFrame, order: str) -> DataFrame:
    """rows with k, their place from 1 in `order` (a number without ties), and n: counts of blocks add up to what lies before each, so no task holds all rows."""
    b = _blocked(rows, F.lit(0), order)
    inside = _same(b, _ahead(b, F.lit(1))).withColumn("k", F.expr(f"ahead + row_number() OVER (PARTITION BY _block ORDER BY {order})"))
    return inside.withColumn("n", F.col("total")).drop("_group", "_block", "own", "ahead", "total")


def decile_means(rows: DataFrame) -> DataFrame:
    """rows (pos unique, value) -> ten parts by place, the last with the remainder: mean, median, p95; nothing under 10 rows."""
    r = ranked(rows, "pos").where("n >= 10").withColumn("decile", F.least(F.lit(10), F.floor((F.col("k") - 1) / F.floor(F.col("n") / 10)) + 1))
    return r.groupBy("decile").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.median("value").alias("median"), F.percentile("value", 0.95).alias("p95"))


def growth_verdict(rows: DataFrame, tolerance: float) -> DataFrame:
    """rows (measure, pos, value, defect) -> growth: mean of the last third less that of the first; verdict: DEFECT before REFUSED (under 3 rows) before GROWS before STEADY."""
    r = rows.selectExpr("*", "row_number() OVER (PARTITION BY measure ORDER BY pos) AS k", "count(*) OVER (PARTITION BY measure) AS n").withColumn("third", F.floor(F.col("n") / 3))
    out = r.groupBy("measure").agg(F.max("n").alias("n"), F.bool_or("defect").alias("defect"), (F.avg(F.when(F.col("k") > F.col("n") - F.col("third"), F.col("value"))) - F.avg(F.when(F.col("k") <= F.col("third"), F.col("value")))).alias("growth"))
    verdict = F.when(F.col("defect"), "DEFECT").when(F.col("n") < 3, "REFUSED").when(F.col("growth") > tolerance, "GROWS").otherwise("STEADY")
    return out.select("measure", F.when(F.col("n") >= 3, F.col("growth")).alias("growth"), verdict.alias("verdict"))


def auc_rank(rows: DataFrame) -> DataFrame:
    """rows (positive, score) -> auc by ranks, ties in the middle; scores that aren't finite are dropped; null if there is one class.

    Counts by distinct score, and running sums over blocks of scores: no task holds all rows.
    """
    good = rows.where(~F.isnan("score") & (F.abs("score") < float("inf")))
    by = good.groupBy("score").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("q"))
    by = _blocked(by, F.lit(0), "score")
    by = _same(by, _ahead(by, F.col("q"))).withColumn("q_below", F.expr("ahead + coalesce(sum(q) OVER (PARTITION BY _block ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"))
    return by.agg(_div(F.sum(F.col("p") * (F.col("q_below") + F.col("q") / 2)), F.sum("p") * F.sum("q")).alias("auc"))


def degree_distribution(support: DataFrame, nodes: DataFrame, strong: int) -> DataFrame:
    """support (frame, point), nodes (frame) -> frame, degree, strong_degree (partners with at least that many shared points), weight; frames without partners have zeros."""
    from .views import shared_counts

    d = shared_counts(support).withColumnRenamed("shared", "w").groupBy("frame").agg(F.count("*").alias("degree"), F.count_if(F.col("w") >= strong).alias("strong_degree"), F.sum("w").alias("weight"))
    return nodes.select("frame").distinct().join(d, "frame", "left").fillna(0)


def support_distribution(points: DataFrame, rows: DataFrame) -> DataFrame:
    """points (segment, point), rows (segment, point, frame, feature) -> views, points: distinct frames of each, those without too; duplicates, orphans and features that several points claim beside. Frames, points and features are numbered within their segment."""
    seen = rows.groupBy("segment", "point").agg(F.count_distinct("frame").alias("views"), (F.count("*") - F.count_distinct("frame")).alias("duplicates"))
    full = points.join(seen, ["segment", "point"], "left").select(F.coalesce("views", F.lit(0)).alias("views"), F.coalesce("duplicates", F.lit(0)).alias("duplicates"))
    claimed = rows.groupBy("segment", "frame", "feature").agg(F.count_distinct("point").alias("c")).agg(F.count_if(F.col("c") > 1).alias("contested"))
    orphans = rows.join(points, ["segment", "point"], "left_anti").agg(F.count("*").alias("orphans"))
    hist = full.groupBy("views").agg(F.count("*").alias("points"), F.sum("duplicates").alias("duplicates"))
    return hist.crossJoin(F.broadcast(claimed)).crossJoin(F.broadcast(orphans))  # one row each


def accept_reject_rates(rows: DataFrame) -> DataFrame:
    """rows (truth, agreed) -> accept (of the true), reject (of the false), balanced: their mean, null if one is."""
    out = rows.agg(F.avg(F.when(F.col("truth"), F.col("agreed").cast("int"))).alias("accept"), F.avg(F.when(~F.col("truth"), (~F.col("agreed")).cast("int"))).alias("reject"))
    return out.withColumn("balanced", (F.col("accept") + F.col("reject")) / 2)


def determinism_check(runs: DataFrame) -> DataFrame:
    """runs (key, run, id) -> whether all runs of a key agree on how many ids they have and on the digest of all of them."""
    per = runs.groupBy("key", "run").agg(F.count("*").alias("n"), ordered_digest(F.col("id")).alias("d"))
    return per.groupBy("key").agg(F.count("*").alias("runs"), (F.count_distinct("n", "d") == 1).alias("same"))


def refusal_root_vs_cascade(poses: DataFrame) -> DataFrame:
    """poses (segment, pos, refused, degeneracy) -> of each segment its first refused pose as root, later ones as cascade, those behind the root as abandoned, and whether one of them was solved."""
    p = poses.selectExpr("*", "row_number() OVER (PARTITION BY segment ORDER BY pos) AS k").selectExpr("*", "min(CASE WHEN refused THEN k END) OVER (PARTITION BY segment) AS root")
    return p.where("root IS NOT NULL").groupBy("segment").agg(F.max("root").alias("root"), F.max(F.when(F.col("k") == F.col("root"), F.col("degeneracy"))).alias("degeneracy"), F.count_if(F.col("refused") & (F.col("k") > F.col("root"))).alias("cascaded"), (F.count("*") - F.max("root")).alias("abandoned"), F.bool_or((F.col("k") > F.col("root")) & ~F.col("refused")).alias("recovered"))


def group_medians(values: DataFrame) -> DataFrame:
    """values (g, v) -> g, median of those that aren't null: exact, from counts of distinct values by blocks, so that no task holds a group."""
    c = _blocked(values.where(F.col("v").isNotNull()).groupBy(F.col("g").alias("group"), F.col("v").alias("value")).agg(F.count("*").alias("n")), F.col("group"), "value")
    half = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1  # the same place twice for an odd number
    per = _ahead(c, F.col("n")).withColumn("p", half[0]).withColumn("q", half[1])
    holds = lambda r: (F.col("ahead") < F.col(r)) & (F.col(r) <= F.col("ahead") + F.col("own"))
    c = _same(c, per.where(holds("p") | holds("q"))).withColumn("upto", F.expr("ahead + sum(n) OVER (PARTITION BY group, _block ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"))
    at = lambda r: F.max(F.when((F.col("upto") >= F.col(r)) & (F.col("upto") - F.col("n") < F.col(r)), F.col("value")))
    return c.groupBy("group").agg(((at("p") + at("q")) / 2).alias("median")).withColumnRenamed("group", "g")


def robust_affine_fit(rows: DataFrame, rounds: int = 12) -> DataFrame:
    """rows (g, pos, x, y) -> slope, offset, held_out: Huber weights (1.5 deviations by the median of residuals about their
    median) in `rounds` weighted fits on even places, where both sides of each equation are weighed, so that squares carry the
    weight squared; the median relative residual of odd places; null under 2 even rows. Rows of a null group or without x or y are left out.

    A round is sums and two exact medians a group, both added up before they are exchanged: a group may be of any size.
    """
    from .graphs import cut, drop

    r = rows.where("g IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL").selectExpr("g", "CAST(x AS DOUBLE) AS x", "CAST(y AS DOUBLE) AS y", "(row_number() OVER (PARTITION BY g ORDER BY pos) - 1) % 2 AS odd")
    middle = r.where("odd = 0").groupBy("g").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.count("*").alias("n"))  # sums about the means lose no digits
    r = cut(r.join(middle, "g").where("n > 1").select("g", "odd", (F.col("x") - F.col("mx")).alias("x"), (F.col("y") - F.col("my")).alias("y"), "mx", "my"), "fit")
    fit = None
    for _ in range(rounds):
        even = r.where("odd = 0").select("g", "x", "y")
        if fit is None:
            even = even.withColumn("w", F.lit(1.0))
        else:
            left = F.abs(F.col("y") - F.col("slope") * F.col("x") - F.col("offset"))
            even = even.join(fit, "g").withColumn("w", F.pow(F.when(left <= F.col("far"), 1.0).otherwise(F.col("far") / (left + 1e-12)), 2))
        s = even.groupBy("g").agg(F.sum("w").alias("s"), F.sum(F.col("w") * F.col("x")).alias("sx"), F.sum(F.col("w") * F.col("y")).alias("sy"), F.sum(F.col("w") * F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("w") * F.col("x") * F.col("y")).alias("sxy"))
        xx = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("s")
        line = s.withColumn("slope", F.when(xx > 0, (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("s")) / F.when(xx > 0, xx)).otherwise(0.0))
        line = cut(line.select("g", "slope", ((F.col("sy") - F.col("slope") * F.col("sx")) / F.col("s")).alias("offset")), "line")
        left = cut(r.where("odd = 0").join(line, "g").select("g", (F.col("y") - F.col("slope") * F.col("x") - F.col("offset")).alias("v")), "left")
        off = left.join(group_medians(left), "g").select("g", F.abs(F.col("v") - F.col("median")).alias("v"))
        new = cut(line.join(group_medians(off), "g").select("g", "slope", "offset", (1.5 * (1.4826 * F.col("median") + 1e-12)).alias("far")), "far")
        drop(line, left, *([] if fit is None else [fit]))
        fit = new
    y = F.col("y") + F.col("my")
    held = r.where("odd = 1").join(fit, "g").select("g", (F.abs(F.col("y") - F.col("slope") * F.col("x") - F.col("offset")) / F.greatest(F.abs(y), F.lit(1e-9))).alias("v"))
    ends = r.groupBy("g").agg(F.first("mx").alias("mx"), F.first("my").alias("my"))
    out = fit.join(ends, "g").join(group_medians(held).withColumnRenamed("median", "held_out"), "g", "left")
    out = out.select("g", "slope", (F.col("offset") + F.col("my") - F.col("slope") * F.col("mx")).alias("offset"), "held_out")
    return rows.select("g").distinct().join(out, "g", "left").select("g", "slope", "offset", "held_out")


def rotation_mean(rows: DataFrame) -> DataFrame:
    """rows (g, r array of nine) -> the rotation nearest to each group's sum; sums are built-in aggregates, only nine numbers a group reach numpy."""
    import numpy as np
    import pandas as pd

    def nearest(batches):
        for t in batches:
            out = []
            for m in t["m"]:
                u, _, v = np.linalg.svd(np.asarray(m, float).reshape(3, 3))
                out.append((u @ np.diag([1, 1, np.sign(np.linalg.det(u @ v)) or 1]) @ v).ravel().tolist())
            yield pd.DataFrame({"g": t["g"], "r": out})

    sums = rows.groupBy("g").agg(F.array(*(F.sum(F.get("r", i)) for i in range(9))).alias("m"))
    return sums.mapInPandas(nearest, f"g {rows.schema['g'].dataType.simpleString()}, r array<double>")


# ---- bindings

_R6 = lambda df, *cs: df.select(*(F.round(c, 6).alias(c) if c in cs else F.col(c) for c in df.columns))


def _lines(s, d):
    return table(s, d, "lineitem").selectExpr("l_orderkey AS session", "l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey AS arrival", "l_partkey AS seq", "CASE WHEN l_orderkey % 3 > 0 THEN l_suppkey END AS tx_seq", "CAST(datediff(l_shipdate, DATE'1992-01-01') AS DOUBLE) AS at", "CAST(l_quantity AS BIGINT) AS bytes", "CAST(l_extendedprice AS DOUBLE) AS latency", "l_returnflag <> 'R' AS accepted", "l_linestatus AS stage", "CAST(l_discount AS DOUBLE) AS ms")


def _poses(s, d):
    e = "CAST(embedding[{}] AS DOUBLE)"
    return table(s, d, "embeddings").selectExpr("vec_id % 23 AS world", "vec_id AS seq", "label AS segment", "element_at(array('solved', 'anchor', 'refused', 'solved', 'lost'), CAST(vec_id % 5 + 1 AS INT)) AS status", "element_at(array('', 'flat', 'far'), CAST(vec_id % 3 + 1 AS INT)) AS degeneracy", *(f"{e.format(i)} AS {c}" for i, c in enumerate("xyz")))


_D_POSES = "ps AS (SELECT vec_id % 23 AS world, vec_id AS seq, label AS segment, ['solved', 'anchor', 'refused', 'solved', 'lost'][vec_id % 5 + 1] AS status, ['', 'flat', 'far'][vec_id % 3 + 1] AS degeneracy, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"
_D_LINES = "li AS (SELECT l_orderkey AS session, l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey AS arrival, l_partkey AS seq, CASE WHEN l_orderkey % 3 > 0 THEN l_suppkey END AS tx, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) AS d, l_quantity::BIGINT AS b, l_extendedprice::DOUBLE AS lat, l_returnflag <> 'R' AS ok, l_linestatus AS stage, l_discount::DOUBLE AS ms FROM lineitem)"



def _fit_sql(rounds: int) -> str:
    """Each round: the weighted line, the residuals' median and its deviation, the weights."""
    steps = ["w0 AS (SELECT g, i, x, y, 1.0::DOUBLE AS w FROM ev2)"]
    for k in range(1, rounds + 1):
        steps.append(f"m{k} AS (SELECT g, sum(w * w * x) / sum(w * w) AS mx, sum(w * w * y) / sum(w * w) AS my FROM w{k - 1} GROUP BY g)")
        steps.append(f"l{k} AS MATERIALIZED (SELECT g, b, my - b * mx AS a FROM (SELECT w.g, any_value(mx) AS mx, any_value(my) AS my, CASE WHEN sum(w * w * (x - mx) ** 2) > 0 THEN sum(w * w * (x - mx) * (y - my)) / sum(w * w * (x - mx) ** 2) ELSE 0 END AS b FROM w{k - 1} w JOIN m{k} USING (g) GROUP BY w.g))")
        steps.append(f"r{k} AS (SELECT w.g, i, x, y, y - b * x - a AS r FROM w{k - 1} w JOIN l{k} USING (g))")
        steps.append(f"d{k} AS (SELECT r.g, 1.5 * (1.4826::DOUBLE * median(abs(r - md)) + 1e-12) AS far FROM r{k} r JOIN (SELECT g, median(r) AS md FROM r{k} GROUP BY g) q USING (g) GROUP BY r.g)")
        steps.append(f"w{k} AS MATERIALIZED (SELECT r.g, i, x, y, CASE WHEN abs(r) <= far THEN 1.0 ELSE far / (abs(r) + 1e-12) END::DOUBLE AS w FROM r{k} r JOIN d{k} USING (g))")
    return f"""WITH e AS (SELECT user_id AS g, event_id::DOUBLE / 1000 AS x, value / 500 + CASE WHEN event_id % 23 = 0 THEN 3 ELSE 0 END AS y, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events), ev2 AS (SELECT * FROM e WHERE i % 2 = 0 AND g IN (SELECT g FROM e WHERE i % 2 = 0 GROUP BY g HAVING count(*) > 1)), {", ".join(steps)},
h AS (SELECT e.g, median(abs(y - b * x - a) / greatest(abs(y), 1e-9)) AS held FROM e JOIN l{rounds} USING (g) WHERE i % 2 = 1 GROUP BY e.g)
SELECT u.g, round(b, 6) AS slope, round(a, 6) AS "offset", round(held, 6) AS held_out FROM (SELECT DISTINCT g FROM e) u LEFT JOIN l{rounds} USING (g) LEFT JOIN h USING (g)"""


OPS = {
    "p95_low_rank": (_p95(True), "SELECT event_type AS label, (list_sort(list(value / 500)))[greatest(1, floor(count(*) * 0.95)::INT)] AS p95 FROM events GROUP BY 1"),
    "p95_high_rank": (_p95(False), "SELECT event_type AS label, (list_sort(list(value / 500)))[least(count(*), floor(count(*) * 0.95)::INT + 1)] AS p95 FROM events GROUP BY 1"),
    "session_metrics": (
        lambda s, d: _R6(session_metrics(_lines(s, d), _lines(s, d)).selectExpr("session", "frames", "rejected", "total_bytes", "seq_gaps", "tx_gaps", "latency_mean", "latency_max", "fps", "bandwidth", "stages[0].stage AS stage", "stages[0].mean AS stage_mean", "stages[0].max AS stage_max"), "latency_mean", "fps", "bandwidth", "stage_mean"),
        f"""WITH {_D_LINES}, g AS (SELECT session, sum(greatest(seq - was - 1, 0)) AS gaps FROM (SELECT session, seq, lag(seq) OVER (PARTITION BY session ORDER BY arrival) AS was FROM li WHERE ok) x GROUP BY 1),
            x AS (SELECT session, sum(greatest(tx - was - 1, 0)) AS gaps FROM (SELECT session, tx, lag(tx) OVER (PARTITION BY session ORDER BY arrival) AS was FROM li WHERE tx IS NOT NULL) y GROUP BY 1),
            m AS (SELECT session, count_if(ok) AS frames, count_if(NOT ok) AS rejected, sum(CASE WHEN ok THEN b ELSE 0 END)::BIGINT AS total_bytes, coalesce(avg(lat) FILTER (ok), 0) AS lm, coalesce(max(lat) FILTER (ok), 0) AS latency_max, CASE WHEN max(d) = min(d) THEN 1e-9::DOUBLE ELSE max(d) - min(d) END AS span, min(stage) AS stage FROM li GROUP BY 1)
            SELECT m.session, frames, rejected, total_bytes, coalesce(g.gaps, 0)::BIGINT AS seq_gaps, CASE WHEN m.session % 3 > 0 THEN coalesce(x.gaps, 0)::BIGINT END AS tx_gaps, round(lm, 6) AS latency_mean, latency_max, round(frames / span, 6) AS fps, round(total_bytes / span, 6) AS bandwidth,
              m.stage, round(avg(ms), 6) AS stage_mean, max(ms) AS stage_max FROM m LEFT JOIN g USING (session) LEFT JOIN x USING (session) JOIN li ON li.session = m.session AND li.stage = m.stage GROUP BY ALL""",
    ),
    "typed_metric_rollup": (
        lambda s, d: _R6(typed_metrics(events(s, d).selectExpr("capture AS run", "label AS metric", "CASE WHEN label = 'purchase' THEN CAST(floor(capture / 3) AS DOUBLE) + CASE WHEN seq % 97 = 0 THEN 1 ELSE 0 END ELSE score END AS value"), s.createDataFrame([("click", "rate"), ("view", "count"), ("purchase", "constant"), ("error", "unaggregated"), ("signup", "rate")], "metric string, kind string")), "value"),
        """SELECT user_id AS run, event_type AS metric, CASE event_type WHEN 'view' THEN 'count' WHEN 'purchase' THEN 'constant' WHEN 'error' THEN 'unaggregated' ELSE 'rate' END AS kind,
             round(CASE event_type WHEN 'view' THEN sum(value / 500) WHEN 'purchase' THEN CASE WHEN count(DISTINCT event_id % 97 = 0) = 1 THEN any_value(user_id // 3 + (event_id % 97 = 0)::INT) END WHEN 'error' THEN NULL ELSE avg(value / 500) END, 6) AS value,
             event_type = 'purchase' AND count(DISTINCT event_id % 97 = 0) > 1 AS varied, count(*) AS frames FROM events GROUP BY user_id, event_type""",
    ),
    "corpus_benchmark": (
        lambda s, d: _R6(corpus_benchmark(events(s, d).selectExpr("CAST(capture AS BIGINT) AS capture", "score * 500 AS ms", "label = 'error' AS failed")), "mean", "p95"),
        """WITH e AS (SELECT user_id AS capture, value AS ms, event_type = 'error' AS bad FROM events UNION ALL SELECT NULL, value, event_type = 'error' FROM events)
           SELECT capture, capture IS NULL AS corpus, count(*) AS frames, count_if(bad) AS failed, round(avg(ms) FILTER (NOT bad), 6) AS mean, round((list_sort(list(ms) FILTER (NOT bad)))[greatest(1, floor(count_if(NOT bad) * 0.95)::INT)], 6) AS p95 FROM e GROUP BY capture""",
    ),
    "corpus_metric_values": (
        lambda s, d: _R6(corpus_metrics(events(s, d).selectExpr("label AS metric", "CASE WHEN label = 'purchase' THEN CAST(seq % 5 AS DOUBLE) ELSE score END AS value", "seq % 11 = 0 AS failed"), s.createDataFrame([("click", "rate"), ("view", "count"), ("purchase", "constant"), ("error", "unaggregated"), ("signup", "rate")], "metric string, kind string")), "value"),
        """WITH e AS (SELECT event_type AS m, event_id, value / 500 AS v FROM events WHERE event_id % 11 > 0) SELECT m AS metric, 'rate' AS kind, round(avg(v), 6) AS value, count(*) AS frames FROM e WHERE m IN ('click', 'signup') GROUP BY m UNION ALL SELECT m, 'count', round(sum(v), 6), count(*) FROM e WHERE m = 'view' GROUP BY m
           UNION ALL SELECT m, 'constant', (event_id % 5)::DOUBLE, count(*) FROM e WHERE m = 'purchase' GROUP BY m, event_id % 5 UNION ALL SELECT m, 'unaggregated', NULL, count(*) FROM e WHERE m = 'error' GROUP BY m""",
    ),
    "refusal_tally": (
        lambda s, d: refusal_tally(events(s, d).selectExpr("CASE label WHEN 'view' THEN NULL WHEN 'error' THEN 'failed' ELSE label END AS reason"), ["click", "purchase", "signup", "never"]),
        "SELECT reason, (SELECT count(*) FROM events WHERE event_type = reason) AS n, (SELECT count(*) FROM events) AS offered, (SELECT count(*) FROM events WHERE event_type = 'view') AS processed, (SELECT count(*) FROM events WHERE event_type = 'error') AS failed FROM (VALUES ('click'), ('purchase'), ('signup'), ('never')) v(reason)",
    ),
    "sender_metrics": (
        lambda s, d: _R6(sender_metrics(events(s, d).selectExpr("capture AS session", "t / 1000000 AS at", "score AS encode_ms", "score * 2 AS send_ms", "label IN ('view', 'click') AS delivered", "label = 'error' AS refused")), "encode_mean", "send_mean", "rate", "delivered_fraction"),
        """SELECT user_id AS session, count(*) AS sent, sum((event_type IN ('view', 'click'))::INT)::BIGINT AS delivered, sum((event_type = 'error')::INT)::BIGINT AS refused, round(avg(value / 500), 6) AS encode_mean, max(value / 500) AS encode_max, round(avg(value / 500 * 2), 6) AS send_mean, max(value / 500 * 2) AS send_max,
             CASE WHEN max(epoch_us(ts)) - min(epoch_us(ts)) >= 500000 THEN round(count(*) / (max(epoch_us(ts) / 1000000) - min(epoch_us(ts) / 1000000)), 6) END AS rate, round(count(*) FILTER (event_type IN ('view', 'click')) / count(*), 6) AS delivered_fraction, count(*) FILTER (event_type NOT IN ('view', 'click', 'error')) AS unaccounted FROM events GROUP BY user_id""",
    ),
    "live_load_report": (
        lambda s, d: _R6(live_load_report(events(s, d).selectExpr("capture AS session", "t / 1000000 AS at", "label = 'error' AS skipped", "score AS cpu_s")), "skip_fraction", "fps", "cpu_per_frame"),
        "SELECT user_id AS session, round(avg((event_type = 'error')::INT), 6) AS skip_fraction, round(count(*) FILTER (event_type <> 'error') / nullif(max(epoch_us(ts) / 1000000) - min(epoch_us(ts) / 1000000), 0), 6) AS fps, round(sum(value / 500) / nullif(count(*) FILTER (event_type <> 'error'), 0), 6) AS cpu_per_frame FROM events GROUP BY user_id",
    ),
    "fixed_arity_pivot": (
        lambda s, d: fixed_arity_pivot(events(s, d).selectExpr("label", "element_at(array('left', 'centre', 'right', 'unknown'), CAST(seq % 4 + 1 AS INT)) AS side", "score > 0.01 AS counted"), ["view", "click", "unicorn"], ["left", "centre", "right", "unknown"]),
        "SELECT label, count(*) FILTER (k = 0) AS \"left\", count(*) FILTER (k = 1) AS centre, count(*) FILTER (k = 2) AS \"right\", count(*) FILTER (k = 3) AS unknown FROM (VALUES ('view'), ('click'), ('unicorn')) v(label) LEFT JOIN (SELECT event_type, event_id % 4 AS k FROM events WHERE value / 500 > 0.01) e ON event_type = label GROUP BY label",
    ),
    "count_by_label": (
        lambda s, d: count_by_label(events(s, d).selectExpr("CASE label WHEN 'view' THEN 'person' ELSE label END AS label", "score > 0.02 AS counted", "seq % 3 = 0 AS partial")),
        "SELECT CASE event_type WHEN 'view' THEN 'person' ELSE event_type END AS label, count(*) FILTER (event_type <> 'view' OR event_id % 3 > 0) AS n, count(*) FILTER (event_type = 'view' AND event_id % 3 = 0) AS partial_n FROM events WHERE value / 500 > 0.02 GROUP BY 1",
    ),
    "people_block": (
        lambda s, d: people_block(events(s, d).selectExpr("capture AS scene", "element_at(array('small', 'medium', 'large', 'unknown'), CAST(seq % 4 + 1 AS INT)) AS size", "CASE WHEN label = 'view' AND capture % 5 > 0 THEN seq % 2 = 0 END AS facing", "score AS age")),
        """SELECT user_id AS scene, count(*) AS people, count(*) FILTER (event_id % 4 = 0) AS small, count(*) FILTER (event_id % 4 = 1) AS medium, count(*) FILTER (event_id % 4 = 2) AS large, CASE WHEN user_id % 5 > 0 AND count(*) FILTER (event_type = 'view') > 0 THEN count(*) FILTER (event_type = 'view' AND event_id % 2 = 0) END AS facing,
             CASE WHEN user_id % 5 = 0 OR count(*) FILTER (event_type = 'view') = 0 THEN 'not-established' END AS reason, CASE WHEN user_id % 5 > 0 THEN max(value / 500) FILTER (event_type = 'view') END AS oldest FROM events GROUP BY user_id""",
    ),
    "event_summary": (
        lambda s, d: event_summary(events(s, d).selectExpr("capture AS world", "seq AS id", "CASE label WHEN 'view' THEN 'keyframe_accepted' WHEN 'error' THEN 'tracking_lost' WHEN 'click' THEN 'frame_rejected' WHEN 'purchase' THEN 'stopped' END AS kind", "CASE WHEN seq % 2 = 0 THEN 'blurred' ELSE 'held' END AS reason"), ["blurred", "held"]),
        """SELECT user_id AS world, count_if(event_type = 'view') AS keyframe_accepted, count_if(event_type = 'click') AS frame_rejected, count_if(event_type = 'error') AS tracking_lost, count_if(event_type = 'click' AND event_id % 2 = 0) AS rejected_blurred, count_if(event_type = 'click' AND event_id % 2 = 1) AS rejected_held,
             CASE arg_max(event_type, event_id) FILTER (event_type IN ('view', 'error')) WHEN 'view' THEN 'keyframe_accepted' WHEN 'error' THEN 'tracking_lost' END AS last_tracking, bool_or(event_type = 'purchase') FILTER (event_type <> 'signup') AS stopped, count_if(event_type = 'signup') AS corrupt FROM events GROUP BY user_id""",
    ),
    "pose_summary": (
        lambda s, d: pose_summary(_poses(s, d)),
        f"WITH {_D_POSES}, g AS (SELECT world, segment, count_if(status = 'solved') AS s, count_if(status = 'anchor') AS a, count_if(status = 'refused') AS r FROM ps GROUP BY ALL) SELECT world, sum(s)::BIGINT AS solved, sum(a)::BIGINT AS anchors, sum(r)::BIGINT AS refused, sum(CASE WHEN s = 0 THEN 0 ELSE s + a END)::BIGINT AS positioned FROM g GROUP BY world",
    ),
    "status_histogram": (
        lambda s, d: status_histogram(_poses(s, d), table(s, d, "lineitem").selectExpr("l_partkey AS segment")),
        f"WITH {_D_POSES} SELECT 'status' AS what, status AS name, count(*) AS n FROM ps GROUP BY 2 UNION ALL SELECT 'degeneracy', degeneracy, count(*) FROM ps WHERE length(degeneracy) > 0 GROUP BY 2 UNION ALL SELECT 'segments', NULL, count(DISTINCT segment) FROM ps UNION ALL SELECT 'points', NULL, count(*) FROM lineitem",
    ),
    "segment_manifest": (
        lambda s, d: _R6(segment_manifest(table(s, d, "orders").where("o_custkey % 10 < 9").selectExpr("o_custkey AS segment", "o_orderkey AS id", "CASE WHEN o_orderstatus = 'F' THEN 'solved' ELSE 'refused' END AS status"), table(s, d, "customer").where("c_custkey % 10 > 0").selectExpr("c_custkey AS segment", "CAST(c_acctbal AS DOUBLE) AS x", "CAST(c_nationkey AS DOUBLE) AS y")), "coverage"),
        """WITH k AS (SELECT o_custkey AS segment, count(*) AS keyframes, count_if(o_orderstatus = 'F') AS solved, left(sha256(string_agg(o_orderkey::VARCHAR, chr(0) ORDER BY o_orderkey)), 16) AS hash FROM orders WHERE o_custkey % 10 <> 9 GROUP BY 1),
           p AS (SELECT c_custkey AS segment, c_acctbal::DOUBLE AS x, c_nationkey::DOUBLE AS y FROM customer WHERE c_custkey % 10 <> 0)
           SELECT coalesce(k.segment, p.segment) AS segment, coalesce(keyframes, 0) AS keyframes, coalesce(solved, 0) AS solved, hash, CASE WHEN p.segment IS NULL THEN 0 ELSE 1 END AS points, x AS x0, x AS x1, y AS y0, y AS y1,
             CASE WHEN p.segment IS NULL THEN 'empty' WHEN coalesce(solved, 0) = 0 THEN 'unresolved' WHEN solved < keyframes THEN 'partial' ELSE 'resolved' END AS state, round(solved / keyframes, 6) AS coverage FROM k FULL JOIN p ON k.segment = p.segment""",
    ),
    "ordered_digest": (
        lambda s, d: table(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), ordered_digest(F.col("o_orderkey")).alias("digest")),
        "SELECT o_custkey, count(*) AS n, left(sha256(string_agg(o_orderkey::VARCHAR, chr(0) ORDER BY o_orderkey)), 16) AS digest FROM orders GROUP BY 1",
    ),
    "coherence_share": (
        lambda s, d: coherence_share(_poses(s, d).selectExpr("segment", "segment % 3 AS component")),
        "WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) SELECT label % 3 AS component, (SELECT count(*) FROM n) AS segments, (SELECT max(n) FROM n) AS largest, (SELECT round(max(n) / sum(n), 4) FROM n) AS largest_share, round(sum(n) / (SELECT sum(n) FROM n), 4) AS share FROM n GROUP BY 1",
    ),
    "fragment_counts": (
        lambda s, d: fragment_counts(_poses(s, d).selectExpr("segment", "x", "z * z AS z"), 20, legible=110.0),
        f"""WITH {_D_POSES}, g AS (SELECT segment, count(*) AS n, 126 / greatest(max(x) - min(x), max(z * z) - min(z * z), 1e-6) AS s, quantile_cont(x, 0.98) - quantile_cont(x, 0.02) AS cx, quantile_cont(z * z, 0.98) - quantile_cont(z * z, 0.02) AS cz FROM ps GROUP BY ALL)
            SELECT count(*) FILTER (n > 19) AS drawable, count(*) FILTER (n > 19 AND (cx * s >= 110 OR cz * s >= 110)) AS legible FROM g""",
    ),
    "corpus_totals": (
        lambda s, d: _R6(corpus_totals(table(s, d, "customer").selectExpr("c_custkey AS points", "c_nationkey AS segments", "c_custkey % 9 AS keyframes", "c_custkey % 5 AS poses_solved", "c_custkey % 4 AS poses_refused", "1 AS legible", "c_custkey % 3 AS drawable", "2 AS segments_with_geometry", "c_custkey % 50 AS largest_points", "CASE WHEN c_custkey % 4 > 0 THEN CAST(c_acctbal AS DOUBLE) END AS largest_share", "c_custkey / 8 AS wall_seconds", "CASE WHEN c_custkey % 7 > 0 THEN CAST(c_nationkey AS DOUBLE) END AS blowup", "map('low', parse_json(CAST(c_custkey % 5 AS STRING)), 'high', parse_json(CASE c_custkey % 4 WHEN 0 THEN 'true' WHEN 1 THEN '3' WHEN 2 THEN '0.25' ELSE '\"7\"' END)) AS discards"), ["low", "high", "absent"], ["points", "segments", "keyframes", "poses_solved", "poses_refused", "legible", "drawable", "segments_with_geometry", "largest_points"]), "mean_share"),
        """SELECT count(*) AS captures, sum(c_custkey)::BIGINT AS points, sum(c_nationkey)::BIGINT AS segments, sum(c_custkey % 9)::BIGINT AS keyframes, sum(c_custkey % 5)::BIGINT AS poses_solved, sum(c_custkey % 4)::BIGINT AS poses_refused, count(*) AS legible, sum(c_custkey % 3)::BIGINT AS drawable, 2 * count(*) AS segments_with_geometry, sum(c_custkey % 50)::BIGINT AS largest_points,
             sum(c_custkey % 5)::DOUBLE AS discard_low, 3.0::DOUBLE * count_if(c_custkey % 4 = 1) + 0.25::DOUBLE * count_if(c_custkey % 4 = 2) AS discard_high, 0.0::DOUBLE AS discard_absent, round(avg(c_acctbal::DOUBLE) FILTER (c_custkey % 4 > 0), 6) AS mean_share, round(sum(c_custkey) / 8, 3) AS wall_seconds, max(c_nationkey) FILTER (c_custkey % 7 > 0)::DOUBLE AS worst_blowup, count_if(c_custkey % 7 = 0) AS unmeasurable FROM customer""",
    ),
    "voxel_reduce": (
        lambda s, d: _R6(voxel_reduce(_poses(s, d).selectExpr("x", "y", "z", "CAST(seq % 256 AS INT) AS r", "CAST(seq % 13 AS INT) AS g", "CAST(seq % 7 AS INT) AS b", "CAST(seq % 101 AS INT) AS confidence"), 0.1), "x", "y", "z"),
        f"WITH {_D_POSES} SELECT floor(x / 0.1)::BIGINT AS ix, floor(y / 0.1)::BIGINT AS iy, floor(z / 0.1)::BIGINT AS iz, count(*) AS n, round(sum(x) / count(*), 6) AS x, round(sum(y) / count(*), 6) AS y, round(sum(z) / count(*), 6) AS z, (sum(seq % 256) // count(*))::INT AS r, (sum(seq % 13) // count(*))::INT AS g, (sum(seq % 7) // count(*))::INT AS b, max(seq % 101)::INT AS confidence FROM ps GROUP BY 1, 2, 3",
    ),
    "last_seen_by_label": (
        lambda s, d: last_seen(events(s, d).selectExpr("label", "floor(t / 3600000000) AS at", "seq", "capture"), ["purchase", "view"], ["purchase", "view", "click", "unicorn"]),
        """WITH e AS (SELECT event_type, epoch_us(ts) // 3600000000 AS h, event_id, user_id, row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 3600000000 DESC, event_id) AS k FROM events)
           SELECT label, h AS "at", event_id AS seq, user_id AS capture, event_id IS NOT NULL AS observed, label IN ('purchase', 'view') AS recordable FROM (VALUES ('purchase'), ('view'), ('click'), ('unicorn')) v(label) LEFT JOIN e ON event_type = label AND k = 1""",
    ),
    "label_scoring": (
        lambda s, d: label_scoring(table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id").selectExpr("lang AS class", "CAST(doc_id % 4 AS INT) AS truth", "CAST(n_chars % 4 AS INT) AS got")),
        "SELECT lang AS class, count(*) AS n, sum(a)::BIGINT AS labelled_total, sum(b)::BIGINT AS engine_total, round(count_if(a = b) / count(*), 3) AS exact, round(count_if(b < a) / count(*), 3) AS under, round(count_if(b > a) / count(*), 3) AS over, round(sum(abs(a - b)) / count(*), 3) AS mae FROM (SELECT lang, d.doc_id % 4 AS a, n_chars % 4 AS b FROM documents d JOIN labels l ON d.doc_id = l.doc_id) x GROUP BY 1",
    ),
    "wearer_frame_counts": (
        lambda s, d: wearer_frames(table(s, d, "documents").selectExpr("CASE WHEN doc_id % 5 > 0 THEN doc_id % 3 = 0 END AS wearer_visible", "CASE WHEN doc_id % 7 > 0 THEN doc_id % 4 END AS bystanders", "n_chars % 3 AS people", "n_chars % 4 AS partial_bottom", "n_chars % 5 AS raw_people")),
        "SELECT count(*) AS frames, count(*) FILTER (n_chars % 3 > 0) AS false_person, count(*) FILTER (n_chars % 4 > 0) AS routed_to_bottom, count(*) FILTER (n_chars % 5 > 0) AS any_box FROM documents WHERE doc_id % 5 > 0 AND doc_id % 3 = 0 AND (doc_id % 7 = 0 OR doc_id % 4 = 0)",
    ),
    "count_stability": (
        lambda s, d: _R6(count_stability(events(s, d).selectExpr("capture % 8 / 10 AS rate", "seq % 5 % 4 AS count", "2 AS truth")), "correct").withColumn("counts", F.concat_ws(",", F.transform("counts", lambda x: x.cast("string")))),
        """WITH n AS (SELECT user_id % 8 AS r, event_id % 5 % 4 AS c, count(*) AS n FROM events GROUP BY ALL) SELECT r / 10 AS rate, (SELECT c FROM n m WHERE m.r = n.r ORDER BY n DESC, c LIMIT 1) AS modal, string_agg(c::VARCHAR, ',' ORDER BY c) AS counts, round(sum(CASE WHEN c = 2 THEN n ELSE 0 END) / sum(n), 6) AS correct FROM n GROUP BY r""",
    ),
    "bytes_by_tier": (
        lambda s, d: bytes_by_tier(table(s, d, "part").selectExpr("p_size AS world", "element_at(array('w/a.jpg', 'w/derived/points.bin', 'w/events.jsonl', 'w/world.json', 'w/derived/x.png'), CAST(p_partkey % 5 + 1 AS INT)) AS path", "CAST(p_partkey AS BIGINT) AS length")),
        "SELECT p_size AS world, sum(p_partkey)::BIGINT AS total, coalesce(sum(p_partkey) FILTER (p_partkey % 5 IN (0, 4)), 0)::BIGINT AS images, coalesce(sum(p_partkey) FILTER (p_partkey % 5 = 1), 0)::BIGINT AS derived, coalesce(sum(p_partkey) FILTER (p_partkey % 5 = 2), 0)::BIGINT AS journals FROM part GROUP BY 1",
    ),
    "path_length": (
        lambda s, d: (lambda p: _R6(path_length(
            p.where("world % 4 > 0").selectExpr("world", "seq", "CASE WHEN world % 5 = 0 AND seq % 3 > 0 THEN status ELSE 'solved' END AS status", "CASE WHEN seq % 97 > 0 THEN x END AS x", "y", "z"),
            p.groupBy("world").agg(F.count_distinct("segment").alias("k")).selectExpr("world", "CASE WHEN world % 11 > 0 THEN world % 13 DIV 12 END AS refused", "CASE WHEN world % 3 = 0 THEN k WHEN world <> 7 THEN 1 END AS segments", "CASE WHEN world % 10 > 1 THEN world % 6 > 0 END AS scale_known")), "length"))(_poses(s, d)),
        f"""WITH {_D_POSES}, q AS (SELECT *, CASE WHEN world % 5 = 0 AND seq % 3 > 0 AND status NOT IN ('solved', 'anchor') THEN 'a pose isn''t solved' WHEN seq % 97 = 0 THEN 'a pose without a place' END AS bad, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz FROM ps WHERE world % 4 > 0 WINDOW w AS (PARTITION BY world ORDER BY seq)),
            g AS (SELECT world, arg_min(bad, seq) FILTER (bad IS NOT NULL) AS bad, sum(sqrt((x - px) ** 2 + (y - py) ** 2 + (z - pz) ** 2)) AS s FROM q GROUP BY world), k AS (SELECT world, count(DISTINCT segment) AS k FROM ps GROUP BY world),
            r AS (SELECT k.world, s, CASE WHEN k.world % 11 = 0 OR k.world % 13 = 12 THEN 'refused poses' WHEN k.world = 7 OR k.world % 3 = 0 AND k > 1 THEN 'several segments' WHEN k.world % 10 < 2 OR k.world % 6 = 0 THEN 'unknown scale' WHEN g.world IS NULL THEN 'no pose was solved' ELSE bad END AS reason FROM k LEFT JOIN g ON g.world = k.world)
            SELECT world, CASE WHEN reason IS NULL THEN round(coalesce(s, 0), 6) END AS length, reason FROM r""",
    ),
    "spatial_coverage": (
        lambda s, d: _R6(spatial_coverage(_poses(s, d).selectExpr("world AS frame", "x + 0.5 AS x", "y + 0.5 AS y", "z AS response", "abs(z) * 30 AS size")), "coverage", "response", "size"),
        f"WITH {_D_POSES} SELECT world AS frame, round(len(list_distinct(list(struct_pack(a := greatest(0, least(7, floor((x + 0.5) * 8))), b := greatest(0, least(7, floor((y + 0.5) * 8))))))) / 64, 6) AS coverage, round(avg(z), 6) AS response, round(avg(abs(z) * 30), 6) AS size FROM ps GROUP BY 1",
    ),
    "circular_stats": (
        lambda s, d: _R6(circular_stats(_poses(s, d).selectExpr("world AS frame", "CASE WHEN seq % 9 > 0 THEN x END AS dx", "CASE WHEN seq % 9 > 0 THEN y END AS dy")), "coherence", "direction", "median", "mean", "largest", "tracked"),
        f"""WITH {_D_POSES}, f AS (SELECT world, x, y, sqrt(x * x + y * y) AS m FROM ps WHERE seq % 9 > 0), u AS (SELECT world, avg(x / m) AS c, avg(y / m) AS s, median(m) AS md, avg(m) AS mn, max(m) AS mx, count(*) AS k FROM f GROUP BY 1)
            SELECT world AS frame, round(sqrt(c * c + s * s), 6) AS coherence, round(degrees(atan2(s, c)), 6) AS direction, round(md, 6) AS median, round(mn, 6) AS mean, round(mx, 6) AS largest, round(k / (SELECT count(*) FROM ps WHERE ps.world = u.world), 6) AS tracked FROM u""",
    ),
    "histogram_stats": (
        lambda s, d: _R6(histogram_stats(events(s, d).selectExpr("capture AS frame", "least(255, CAST(floor(score * 500) AS INT)) AS level").groupBy("frame", "level").agg(F.count("*").alias("n"))), "under", "over", "bits", "mean", "std"),
        """WITH l AS (SELECT user_id AS frame, least(255, floor(value / 500 * 500))::INT AS level FROM events), p AS (SELECT frame, level, count(*) / sum(count(*)) OVER (PARTITION BY frame) AS p FROM l GROUP BY frame, level)
           SELECT frame, round(avg((level <= 10)::INT), 6) AS under, round(avg((level >= 245)::INT), 6) AS over, (SELECT round(sum(p * log2(1 / p)), 6) FROM p WHERE p.frame = l.frame) AS bits, round(avg(level), 6) AS mean, round(stddev_pop(level), 6) AS std FROM l GROUP BY frame""",
    ),
    "clock_drift_slope": (
        lambda s, d: (lambda c: _R6(c, *(x for x in c.columns if x not in ("session", "n"))))(clock_drift_fit(events(s, d).selectExpr("capture AS session", "seq", "CAST(seq AS DOUBLE) AS host", "seq * 0.9987D + score / 3 AS pts"))),
        """WITH e AS (SELECT user_id AS s, event_id AS h, event_id * 0.9987::DOUBLE + value / 500 / 3 AS p, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), f AS (SELECT s, regr_slope(h - p, h) AS b FROM e GROUP BY s), d AS (SELECT a.s, a.p - b.p AS dp, a.h - b.h AS dh FROM e a JOIN e b ON a.s = b.s AND a.i = b.i + 1),
           g AS (SELECT s, avg(dp) AS a1, stddev_pop(dp) AS a2, min(dp) AS a3, max(dp) AS a4, avg(dh) AS b1, stddev_pop(dh) AS b2, min(dh)::DOUBLE AS b3, max(dh)::DOUBLE AS b4, avg(dp - dh) AS c1, stddev_pop(dp - dh) AS c2, min(dp - dh) AS c3, max(dp - dh) AS c4 FROM d GROUP BY s)
           SELECT s AS session, count(*) AS n, (max(h) - min(h))::DOUBLE AS elapsed, round(avg(h - p), 6) AS mean, round(min(h - p), 6) AS low, round(max(h - p), 6) AS high, round(1000000 * any_value(b), 6) AS ppm, round(any_value(a1), 6) AS pts_mean, round(any_value(a2), 6) AS pts_std, round(any_value(a3), 6) AS pts_low, round(any_value(a4), 6) AS pts_high,
             round(any_value(b1), 6) AS host_mean, round(any_value(b2), 6) AS host_std, any_value(b3) AS host_low, any_value(b4) AS host_high, round(any_value(c1), 6) AS both_mean, round(any_value(c2), 6) AS both_std, round(any_value(c3), 6) AS both_low, round(any_value(c4), 6) AS both_high FROM e JOIN f USING (s) JOIN g USING (s) GROUP BY s HAVING count(*) > 2""",
    ),
    "flicker_metrics": (
        lambda s, d: _R6(flicker_metrics(events(s, d).selectExpr("capture AS pixel", "seq % 97 AS frame0", "seq", "score").selectExpr("pixel", "row_number() OVER (PARTITION BY pixel ORDER BY seq) AS frame", "score AS value")), "mean_step", "largest_step", "mean_p95", "mean_std5"),
        """WITH e AS (SELECT user_id AS p, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS f, value / 500 AS v FROM events), d AS (SELECT a.f, abs(a.v - b.v) AS step FROM e a LEFT JOIN e b ON a.p = b.p AND b.f = a.f - 1), m AS (SELECT f, avg(step) AS m, quantile_cont(step, 0.95) AS p FROM d GROUP BY f),
           w AS (SELECT a.p, a.f, stddev_pop(b.v) AS s FROM e a JOIN e b ON a.p = b.p AND b.f BETWEEN a.f - 4 AND a.f WHERE a.f >= 5 GROUP BY ALL) SELECT round(avg(m), 6) AS mean_step, round(max(m), 6) AS largest_step, round(avg(p), 6) AS mean_p95, (SELECT round(avg(s), 6) FROM w) AS mean_std5 FROM m""",
    ),
    "area_weighted_mean": (
        lambda s, d: _R6(area_weighted_mean(table(s, d, "lineitem").selectExpr("l_partkey AS a", "l_suppkey AS b", "l_linenumber AS c", "CAST(l_quantity AS DOUBLE) AS area", "CAST(l_discount AS DOUBLE) AS value")), "value"),
        "WITH f AS (SELECT l_partkey AS v, l_quantity::DOUBLE AS w, l_discount::DOUBLE AS x FROM lineitem UNION ALL SELECT l_suppkey, l_quantity, l_discount FROM lineitem UNION ALL SELECT l_linenumber, l_quantity, l_discount FROM lineitem) SELECT v AS vertex, round(sum(w * x) / sum(w), 6) AS value FROM f GROUP BY v",
    ),
    "power_fit": (
        lambda s, d: _R6(power_fit(table(s, d, "lineitem").selectExpr("l_returnflag AS g", "CAST(l_quantity AS DOUBLE) - 3 AS x", "CAST(l_extendedprice AS DOUBLE) AS y")), "a", "b", "r2"),
        """WITH l AS (SELECT l_returnflag AS g, CASE WHEN l_quantity > 3 THEN ln(l_quantity::DOUBLE - 3) END AS x, ln(l_extendedprice::DOUBLE) AS y FROM lineitem), m AS (SELECT g, avg(x) AS mx, avg(y) AS my, count(*) AS n FROM l WHERE x IS NOT NULL GROUP BY g),
           c AS (SELECT l.g, n, sum((x - mx) * (y - my)) AS xy, sum((x - mx) ** 2) AS xx, sum((y - my) ** 2) AS yy, any_value(mx) AS mx, any_value(my) AS my FROM l JOIN m USING (g) WHERE x IS NOT NULL GROUP BY l.g, n)
           SELECT g, n, (SELECT count(*) FROM l WHERE l.g = c.g AND x IS NULL) AS dropped, round(exp(my - xy / xx * mx), 6) AS a, round(xy / xx, 6) AS b, round(xy * xy / xx / yy, 6) AS r2 FROM c""",
    ),
    "decile_means": (
        lambda s, d: _R6(decile_means(events(s, d).selectExpr("seq AS pos", "score AS value")), "mean", "median", "p95"),
        """WITH c AS (SELECT count(*) AS n, count(*) // 10 AS w FROM events), e AS (SELECT value / 500 AS v, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events)
           SELECT CASE WHEN i >= 9 * w THEN 10 ELSE i // w + 1 END AS decile, count(*) AS n, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.95), 6) AS p95 FROM e, c WHERE n >= 10 GROUP BY 1""",
    ),
    "growth_verdict": (
        lambda s, d: _R6(growth_verdict(events(s, d).selectExpr("capture AS measure", "seq AS pos", "sqrt(score) AS value", "seq % 2999 = 0 AS defect"), 0.001), "growth"),
        """WITH e AS (SELECT user_id AS m, sqrt(value / 500) AS v, event_id % 2999 = 0 AS bad, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS a, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS z, count(*) OVER (PARTITION BY user_id) // 3 AS k FROM events),
           g AS (SELECT m, count(*) AS n, bool_or(bad) AS bad, avg(v) FILTER (z <= k) - avg(v) FILTER (a <= k) AS g FROM e GROUP BY m) SELECT m AS measure, CASE WHEN n > 2 THEN round(g, 6) END AS growth, CASE WHEN bad THEN 'DEFECT' WHEN n < 3 THEN 'REFUSED' WHEN g > 0.001 THEN 'GROWS' ELSE 'STEADY' END AS verdict FROM g""",
    ),
    "auc_rank": (
        lambda s, d: _R6(auc_rank(table(s, d, "labels").join(table(s, d, "documents"), "doc_id").selectExpr("quality = 1 AS positive", "CASE WHEN n_chars % 11 = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(n_chars % 97 AS DOUBLE) END AS score")), "auc"),
        "WITH r AS (SELECT quality = 1 AS p, n_chars % 97 AS s FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE n_chars % 11 > 0) SELECT round(avg(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0 END), 6) AS auc FROM r a, r b WHERE a.p AND NOT b.p",
    ),
    "degree_distribution": (
        lambda s, d: degree_distribution(table(s, d, "lineitem").selectExpr("l_suppkey AS frame", "l_partkey AS point"), table(s, d, "supplier").selectExpr("s_suppkey AS frame").union(s.range(1).selectExpr("-1")), 2),
        """WITH u AS (SELECT DISTINCT l_suppkey AS f, l_partkey AS p FROM lineitem), w AS (SELECT a.f, b.f AS o, count(*) AS w FROM u a JOIN u b ON a.p = b.p WHERE a.f <> b.f GROUP BY ALL), n AS (SELECT s_suppkey AS f FROM supplier UNION ALL SELECT -1)
           SELECT n.f AS frame, count(o) AS degree, count(o) FILTER (w > 1) AS strong_degree, coalesce(sum(w), 0)::BIGINT AS weight FROM n LEFT JOIN w ON w.f = n.f GROUP BY n.f""",
    ),
    "support_distribution": (
        lambda s, d: support_distribution(table(s, d, "part").where("p_partkey % 9 > 0").selectExpr("p_partkey % 3 AS segment", "p_partkey AS point"), table(s, d, "lineitem").selectExpr("l_partkey % 3 AS segment", "l_partkey AS point", "l_suppkey AS frame", "l_partkey % 50 AS feature")),
        """WITH r AS (SELECT l_partkey AS p, l_suppkey AS f FROM lineitem), v AS (SELECT p_partkey, count(DISTINCT f) AS views, count(f) - count(DISTINCT f) AS dup FROM part LEFT JOIN r ON p = p_partkey WHERE p_partkey % 9 > 0 GROUP BY 1)
           SELECT views, count(*) AS points, sum(dup)::BIGINT AS duplicates, (SELECT count(*) FROM (SELECT p % 3, f, p % 50 FROM r GROUP BY ALL HAVING count(DISTINCT p) > 1) c) AS contested, (SELECT count(*) FROM r WHERE p % 9 = 0) AS orphans FROM v GROUP BY views""",
    ),
    "accept_reject_rates": (
        lambda s, d: _R6(accept_reject_rates(table(s, d, "labels").selectExpr("quality = 1 AS truth", "doc_id % 3 > 0 AS agreed")), "accept", "reject", "balanced"),
        "WITH r AS (SELECT count(*) FILTER (quality = 1 AND doc_id % 3 > 0) / count(*) FILTER (quality = 1) AS a, count(*) FILTER (quality = 0 AND doc_id % 3 = 0) / count(*) FILTER (quality = 0) AS b FROM labels) SELECT round(a, 6) AS accept, round(b, 6) AS reject, round((a + b) / 2, 6) AS balanced FROM r",
    ),
    "determinism_check": (
        lambda s, d: determinism_check(table(s, d, "orders").selectExpr("o_custkey AS key", "1 AS run", "o_orderkey AS id").union(table(s, d, "orders").where("o_orderkey % 31 > 0").selectExpr("o_custkey", "2", "o_orderkey")).union(table(s, d, "orders").selectExpr("o_custkey", "3", "o_orderkey + CASE WHEN o_orderkey % 37 = 0 THEN 1 ELSE 0 END"))),
        "SELECT o_custkey AS key, 2 + CASE WHEN count_if(o_orderkey % 31 > 0) > 0 THEN 1 ELSE 0 END AS runs, count_if(o_orderkey % 37 = 0) = 0 AND count_if(o_orderkey % 31 = 0) IN (0, count(*)) AS same FROM orders GROUP BY 1",
    ),
    "refusal_root_vs_cascade": (
        lambda s, d: refusal_root_vs_cascade(events(s, d).selectExpr("capture AS segment", "seq AS pos", "label = 'error' AS refused", "CASE WHEN seq % 2 = 0 THEN 'flat' ELSE 'far' END AS degeneracy")),
        """WITH e AS (SELECT user_id AS g, event_id AS i, event_type = 'error' AS bad, (SELECT min(event_id) FROM events x WHERE x.user_id = e.user_id AND event_type = 'error') AS r FROM events e)
           SELECT g AS segment, count_if(i <= r) AS root, CASE WHEN any_value(r) % 2 = 0 THEN 'flat' ELSE 'far' END AS degeneracy, count_if(bad AND i > r) AS cascaded, count_if(i > r) AS abandoned, count_if(NOT bad AND i > r) > 0 AS recovered FROM e WHERE r IS NOT NULL GROUP BY g""",
    ),
    "robust_affine_fit": (lambda s, d: _R6(robust_affine_fit(events(s, d).selectExpr("capture AS g", "seq AS pos", "CAST(seq AS DOUBLE) / 1000 AS x", "score + CASE WHEN seq % 23 = 0 THEN 3 ELSE 0 END AS y"), 6), "slope", "offset", "held_out"), _fit_sql(6)),
    "rotation_mean": (lambda s, d: rotation_mean(table(s, d, "embeddings").selectExpr("label AS g", "transform(slice(embedding, 1, 9), v -> CAST(v AS DOUBLE)) AS r")), None),
}
