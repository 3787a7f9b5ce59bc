"""Gates in their order, guards and views: functions over their own columns, bound to the driver's tables.

Each entry of OPS is (query, oracle). The oracle is SQL of its own, written against the operator's
definition, and shares no text with the query.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import DUCK_EVENTS, events, table


# ---- retention


def retention_clamp(df: DataFrame, default_days: int = 30) -> DataFrame:
    """persisted, requested (null: unbounded), manifest ('ok', 'bad', 'absent'), has_data -> effective_days.

    A bad manifest, and an absent one beside data, stand for default_days; of both limits the smaller holds.
    """
    promised = F.when(F.col("manifest") == "ok", F.col("persisted")).when((F.col("manifest") == "bad") | F.col("has_data"), F.lit(default_days))
    return df.withColumn("effective_days", F.least(promised, F.col("requested")))


def retention_view(df: DataFrame) -> DataFrame:
    """persisted, requested -> effective_days and clamped: whether more was asked for than is given. 0 or less asks for no limit."""
    asked = F.when(F.col("requested") > 0, F.col("requested"))
    effective = F.least("persisted", asked)
    clamped = F.col("requested").isNotNull() & effective.isNotNull() & (asked.isNull() | (asked > effective))
    return df.withColumn("effective_days", effective).withColumn("clamped", clamped)


def observations_query(df: DataFrame, label: str | None = None, since: float | None = None, cutoff: float | None = None) -> DataFrame:
    """Rows of the class recorded from `since` and within retention, newest observation first: place from 1, total beside each row."""
    keep = F.lit(True)
    if label is not None:
        keep &= F.col("label") == label
    for least in (since, cutoff):
        if least is not None:
            keep &= F.coalesce(F.col("recorded_at") >= least, F.lit(False))
    kept = df.where(keep)
    # numbering needs one order over all rows served, as the answer does; counts go ahead by day, so no task holds more than a day
    day = F.floor(F.col("observed_at") / 86400)
    days = kept.groupBy(day.alias("day")).agg(F.count("*").alias("n"))
    ahead = days.selectExpr("day AS _day", "coalesce(sum(n) OVER (ORDER BY day DESC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead", "sum(n) OVER () AS total")
    inside = "row_number() OVER (PARTITION BY _own ORDER BY observed_at DESC NULLS LAST, id)"
    return kept.withColumn("_own", day).withColumn("_k", F.expr(inside)).join(ahead, F.col("_own").eqNullSafe(F.col("_day"))).select(*df.columns, (F.col("_k") + F.col("ahead")).alias("place"), "total")


def detection_threshold(df: DataFrame, least: float, classes: list[str] | None) -> DataFrame:
    """Detections of at least that score; classes None takes all, an empty list none. Null scores and labels are out."""
    keep = F.col("score") >= least
    return df.where(keep if classes is None else keep & F.col("label").isin(classes) if classes else F.lit(False))


# ---- gates


def sighting_gate(df: DataFrame, least_score: float, least_frames: int = 3) -> DataFrame:
    """recorded, excluded, tier, allowed, best_score, frame_count, part_of_another, agrees -> verdict, the first clause that holds."""
    clauses = [
        (F.col("recorded"), "already-recorded"), (F.col("excluded"), "excluded"), (F.col("tier") == "context", "context-only"),
        ((F.col("tier") == "ignored") | ~F.col("allowed"), "not-whitelisted"), (~F.coalesce(F.col("best_score") >= least_score, F.lit(False)), "below-min-score"),
        (F.col("frame_count") < least_frames, "too-brief"), (F.col("part_of_another"), "part-of-another"),
        ((F.col("tier") == "verify") & ~F.coalesce(F.col("agrees"), F.lit(False)), "unverified"),
    ]
    verdict = F.lit("record")
    for condition, name in reversed(clauses):
        verdict = F.when(F.coalesce(condition, F.lit(False)), name).otherwise(verdict)
    return df.withColumn("verdict", verdict)


def part_of_suppression(frames: DataFrame, wholes: dict[str, list[str]], gap: int, least_frames: int = 3) -> DataFrame:
    """frames (capture, label, t, seq) of parts and wholes -> capture, label, first_at, recorded_at of each sighting of a part.

    Live, not latched: a part is recorded at its first frame, from the least_frames-th on, at which no whole of the
    capture is open; null if there is none. A whole is open from a frame of its own until gap after it.
    """
    names = [w for ws in wholes.values() for w in ws]
    parts = frames.where(F.col("label").isin(list(wholes))).selectExpr("*", f"CASE WHEN t - lag(t) OVER (PARTITION BY capture, label ORDER BY t, seq) <= {gap} THEN 0 ELSE 1 END AS fresh")
    parts = parts.withColumn("session", F.expr("sum(fresh) OVER (PARTITION BY capture, label ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"))
    parts = parts.withColumn("k", F.expr("row_number() OVER (PARTITION BY capture, label, session ORDER BY t, seq)"))
    pairs = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for kv in wholes.items() for x in kv))
    # the last frame of any of a part's wholes before each frame of the part: one union and a running maximum, no range join
    marks = frames.where(F.col("label").isin(names)).select("capture", "t", F.col("label").alias("whole"))
    asks = parts.where(F.col("k") >= least_frames).select("capture", "label", "session", "t", "seq", F.explode(F.element_at(pairs, F.col("label"))).alias("whole"))
    both = asks.withColumn("mark", F.lit(None).cast("long")).unionByName(marks.withColumn("mark", F.col("t")), allowMissingColumns=True)
    both = both.withColumn("open_at", F.expr("max(mark) OVER (PARTITION BY capture, whole ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"))
    free = both.where("label IS NOT NULL").groupBy("capture", "label", "session", "t", "seq").agg(F.bool_and(F.coalesce(F.col("t") - F.col("open_at") > gap, F.lit(True))).alias("free"))
    when = free.where("free").groupBy("capture", "label", "session").agg(F.min("t").alias("recorded_at"))
    runs = parts.groupBy("capture", "label", "session").agg(F.min("t").alias("first_at"), F.count("*").alias("frames"))
    return runs.where(F.col("frames") >= least_frames).join(when, ["capture", "label", "session"], "left").select("capture", "label", "first_at", "recorded_at")


def readable_page(df: DataFrame, least: float = 0.15) -> DataFrame:
    """regions, confidence, text -> readable: regions, mean confidence of at least that, and a token of two characters or more."""
    word = F.exists(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) >= 2)
    return df.withColumn("readable", F.coalesce((F.col("regions") > 0) & (F.col("confidence") >= least) & word, F.lit(False)))


def frame_stability(df: DataFrame, max_shift: float = 0.02, least_response: float = 0.2, least_sharp: float = 25.0, least_ratio: float = 0.5, changed_under: float = 0.1) -> DataFrame:
    """capture, seq, width, height, sharpness, shift, response -> ratio, stable, content_changed.

    ratio: to the median of the up to 30 frames before of the same run of equal frame sizes, 1 where there is none or
    it isn't above 0.
    """
    run = "sum(CASE WHEN width = lag_w AND height = lag_h THEN 0 ELSE 1 END) OVER (PARTITION BY capture ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    df = df.selectExpr("*", "lag(width) OVER (PARTITION BY capture ORDER BY seq) AS lag_w", "lag(height) OVER (PARTITION BY capture ORDER BY seq) AS lag_h").withColumn("_run", F.expr(run)).drop("lag_w", "lag_h")
    df = df.withColumn("_base", F.expr("percentile(sharpness, 0.5) OVER (PARTITION BY capture, _run ORDER BY seq ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)"))
    df = df.withColumn("ratio", F.when(F.coalesce("_base", "sharpness") > 0, F.col("sharpness") / F.coalesce("_base", "sharpness")).otherwise(1.0))
    sharp = (F.col("sharpness") >= least_sharp) & (F.col("ratio") >= least_ratio)
    near = F.col("shift") < max_shift * F.sqrt(F.col("width") * F.col("width") + F.col("height") * F.col("height"))
    return df.withColumn("stable", near & (F.col("response") >= least_response) & sharp).withColumn("content_changed", (F.col("response") < changed_under) & sharp).drop("_run", "_base")


#: Of a keyframe's state and frame: the clauses in their order.
_KEYFRAME = [
    ("sharp_ratio < 0.25", "reject:blurred"), ("NOT tracking OR NOT has_keyframe", "accept:session_seed"),
    ("survival < 0.2 AND losses + 1 >= 3", "lost:tracking_lost"), ("survival < 0.2", "reject:tracking_held"), ("survival < 0.4", "reject:tracking_degraded"),
    ("displacement IS NULL", "skip:no_motion_evidence"), ("frames_since < 3", "skip:rate_limited"), ("overlap < 0.75", "accept:overlap_floor"),
    ("displacement / diagonal < 0.02", "skip:insufficient_motion"), ("displacement / diagonal >= 0.05", "accept:parallax"),
]


def keyframe_decision(df: DataFrame) -> DataFrame:
    """sharp_ratio, tracking, has_keyframe, survival, losses, displacement, frames_since, overlap, diagonal -> decision ('what:why')."""
    out = F.lit("skip:insufficient_motion")
    for condition, name in reversed(_KEYFRAME):
        out = F.when(F.expr(f"coalesce({condition}, false)"), name).otherwise(out)
    return df.withColumn("decision", out)


def person_view(df: DataFrame) -> DataFrame:
    """Box x0, y0, x1, y1 in a frame of w x h -> size, partial, side, offset; an unknown frame gives unknown, false, unknown, null."""
    known = F.coalesce((F.col("w") > 0) & (F.col("h") > 0), F.lit(False))
    w, h = F.nullif("w", F.lit(0)), F.nullif("h", F.lit(0))
    tall, top, bottom, wide = (F.col("y1") - F.col("y0")) / h, F.col("y0") / h, F.col("y1") / h, (F.col("x1") - F.col("x0")) / w
    x = (F.col("x0") + F.col("x1")) / 2 / w
    return df.select(
        "*", F.when(~known, "unknown").when(tall >= 0.6, "large").when(tall < 0.3, "small").otherwise("medium").alias("size"),
        (known & ((top >= 0.45) | ((top >= 0.25) & (bottom >= 0.97) & (wide >= 0.8)))).alias("partial"),
        F.when(~known | x.isNull(), "unknown").when(x < 0.35, "left").when(x > 0.65, "right").otherwise("centre").alias("side"),
        F.when(known, F.round((x - 0.5) * 2, 4)).alias("offset"),
    )


def timestamp_guard(df: DataFrame, column: str, key: str) -> DataFrame:
    """place in descending time within a group `g`: what isn't a finite number sorts last, by key."""
    good = F.when(~F.isnan(column) & (F.abs(column) < float("inf")), F.col(column))
    return df.withColumn("at", good).withColumn("place", F.expr(f"row_number() OVER (PARTITION BY g ORDER BY at DESC NULLS LAST, {key})"))


def json_safe(df: DataFrame) -> DataFrame:
    """Every number of every column, however deep, that isn't finite becomes null."""

    def safe(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: safe(x, kind.elementType))
        if isinstance(kind, T.MapType):
            return F.transform_values(c, lambda _, v: safe(v, kind.valueType))
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*(safe(c[f.name], f.dataType).alias(f.name) for f in kind.fields)))
        return c

    return df.select(*(safe(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields))


def answer_kind(df: DataFrame) -> DataFrame:
    """documents, found, pages, characters -> answer and text_state."""
    answer = F.when(F.col("documents") == 0, "no_observation").when(F.col("found") > 0, "matched").otherwise("not_found")
    state = F.when(F.col("pages") == 0, "unknown").when(F.col("characters") == 0, "not_readable").otherwise("extracted")
    return df.withColumn("answer", answer).withColumn("text_state", state)


#: Bands of the ratios between a face's five landmarks.
FACE_BANDS = {"eye_separation": (0.15, 0.62), "nose_offset": (0.0, 0.80), "eye_to_nose": (0.25, 1.60), "nose_to_mouth": (0.20, 1.90), "mouth_to_eye": (0.40, 1.25)}


def face_box_gate(df: DataFrame) -> DataFrame:
    """Box bw, bh and landmarks (right eye, left eye, nose, right and left mouth corner: px0, py0 ... px4, py4) -> facelike.

    True or false by the bands; null where it can't be judged: eyes in one place, an empty box, a number missing.
    Heights are measured across the line of the eyes, so a tilted head scores as an upright one.
    """
    p = [(F.col(f"px{i}"), F.col(f"py{i}")) for i in range(5)]
    ex, ey = p[1][0] - p[0][0], p[1][1] - p[0][1]
    eyes = F.sqrt(ex * ex + ey * ey)
    sep = F.when((eyes > 1e-6) & (F.col("bw") > 0) & (F.col("bh") > 0), eyes)
    ax, ay = ex / sep, ey / sep
    flip = F.when(ax < 0, -1.0).otherwise(1.0)
    dx, dy = -ay * flip, ax * flip
    mx, my = (p[0][0] + p[1][0]) / 2, (p[0][1] + p[1][1]) / 2
    ox, oy = (p[3][0] + p[4][0]) / 2, (p[3][1] + p[4][1]) / 2
    wx, wy = p[4][0] - p[3][0], p[4][1] - p[3][1]
    ratios = {
        "eye_separation": sep / F.col("bw"), "nose_offset": F.abs((p[2][0] - mx) * ax + (p[2][1] - my) * ay) / sep, "eye_to_nose": ((p[2][0] - mx) * dx + (p[2][1] - my) * dy) / sep,
        "nose_to_mouth": ((ox - p[2][0]) * dx + (oy - p[2][1]) * dy) / sep, "mouth_to_eye": F.sqrt(wx * wx + wy * wy) / sep,
    }
    ok = F.lit(True)
    for name, (low, high) in FACE_BANDS.items():
        ok = ok & ratios[name].between(low, high)
    return df.withColumn("facelike", ok)


def manifest_validation(df: DataFrame, version: int = 1) -> DataFrame:
    """JSON manifest, session, rotation (array), scale -> problem, the first found, or null.

    Numbers must be whole numbers and not true or false; a rotation has four finite parts and length 1 to within 1e-3.
    """
    v = F.try_parse_json("manifest")
    number = lambda k: F.schema_of_variant(F.variant_get(v, f"$.{k}", "variant")) == "BIGINT"
    text = lambda k: F.schema_of_variant(F.variant_get(v, f"$.{k}", "variant")) == "STRING"
    r = [F.get("rotation", i) for i in range(4)]
    finite = F.lit(True)
    for x in [*r, F.col("scale")]:
        finite = finite & F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    length = F.sqrt(sum(x * x for x in r))
    problem = (
        F.when(v.isNull() | ~F.startswith(F.ltrim("manifest"), F.lit("{")), "not an object").when(~F.coalesce(number("schema_version") & (F.variant_get(v, "$.schema_version", "bigint") == version), F.lit(False)), "schema")
        .when(~F.coalesce(text("session_id") & (F.variant_get(v, "$.session_id", "string") == F.col("session")), F.lit(False)), "session")
        .when(~F.coalesce(number("poses"), F.lit(False)) | ~F.coalesce(number("points"), F.lit(False)), "missing figures")
        .when((F.size("rotation") != 4) | ~finite, "not finite").when(F.abs(length - 1) > 1e-3, "not a rotation").when(F.col("scale") <= 0, "scale")
    )
    return df.withColumn("problem", problem)


def session_state(df: DataFrame) -> DataFrame:
    """live, ended_at, end_reason, final_state, final_solve (both null: no finalization), has_geometry, ran (a build ran) -> state."""
    stopped, nothing = F.col("ended_at").isNotNull(), F.when(F.col("ran"), "no_geometry").otherwise("unbuilt")
    done = F.coalesce(F.col("final_state") == "complete", F.lit(False))
    state = (
        F.when(F.col("live") & ~stopped, "receiving").when(F.col("live"), "finalizing").when(~stopped, "interrupted")
        .when(done & F.coalesce(F.col("final_solve") == "solved", F.lit(False)) & F.col("has_geometry"), "complete")
        .when(F.coalesce(F.col("end_reason").isin("error", "interrupted"), F.lit(False)), "interrupted").when(done & F.col("has_geometry"), "complete")
        .when(F.col("final_state").isNotNull() & ~done, "interrupted").when(done, nothing).when(F.col("has_geometry"), "complete").otherwise(nothing)
    )
    return df.withColumn("state", state)


def cursor_class(df: DataFrame) -> DataFrame:
    """since, current (strings) -> cursor: absent, unrecognised (empty), matched or stale."""
    return df.withColumn("cursor", F.when(F.col("since").isNull(), "absent").when(F.col("since") == "", "unrecognised").when(F.col("since") == F.col("current"), "matched").otherwise("stale"))


def tracking_state(events_: DataFrame, now: float) -> DataFrame:
    """capture, seq, kind, at -> last kind of those about tracking, state, elapsed (null where the clock went back)."""
    about = F.col("kind").isin("keyframe_accepted", "tracking_lost")
    out = events_.groupBy("capture").agg(F.max_by(F.when(about, F.col("kind")), F.when(about, F.col("seq"))).alias("last_kind"), F.max("at").alias("_at"))
    state = F.when(F.col("last_kind") == "tracking_lost", "lost").when(F.col("last_kind") == "keyframe_accepted", "good").otherwise("unknown")
    return out.select("capture", "last_kind", state.alias("state"), F.when(F.lit(now) >= F.col("_at"), F.lit(now) - F.col("_at")).alias("elapsed"))


def transient_mask_filter(df: DataFrame, max_area: float = 0.5, max_filled: float = 0.6, hand_score: float = 0.3, phone_score: float = 0.4) -> DataFrame:
    """frame, label, score, area (share of the frame), filled (share of the mask that is filled already) -> kind: hand or phone; others go."""
    fits = (F.col("area") > 0) & (F.col("area") <= max_area) & (F.col("filled") <= max_filled)
    low = F.lower("label")
    hand = low.contains("hand") | low.contains("finger") | low.contains("arm")
    kind = F.when(hand & (F.col("score") >= hand_score), "hand").when(low.contains("phone") & (F.col("score") >= phone_score), "phone")
    return df.where(fits).withColumn("kind", kind).where("kind IS NOT NULL")


def capability_table(declared: DataFrame, inputs: DataFrame) -> DataFrame:
    """declared (feature, result, contract, needs), inputs (input, state) -> one row each with available and reason.

    An input that isn't given makes unavailable, as does one that isn't ready.
    """
    out = declared.join(inputs, declared.needs == inputs.input, "left")
    reason = F.when(F.col("needs").isNull(), None).when(F.col("input").isNull(), "input-omitted").when(F.col("state") != "ready", F.concat(F.lit("input-"), F.col("state")))
    return out.select("feature", "result", "contract", reason.isNull().alias("available"), reason.alias("reason"))


def observation_view(df: DataFrame) -> DataFrame:
    """Projection with a nested frame reference; where a place in space would be is null, never guessed."""
    where = F.struct(F.col("session_id"), F.col("frame_seq"), F.col("box").alias("bounding_box"), F.lit(None).cast("string").alias("spatial_ref"))
    return df.select("observation_id", "label", "score", "observed_at", where.alias("where"))


def frame_decode_validate(df: DataFrame) -> DataFrame:
    """wire (JSON) -> reject_reason of the first broken rule, seq, source_seq (default seq), tx_seq (default null), bytes.

    Five fields are needed; whole numbers must not be true or false; format is jpeg; data is strict base64 of a JPEG.
    """
    v = F.try_parse_json("wire")
    kind = lambda k: F.coalesce(F.schema_of_variant(F.variant_get(v, f"$.{k}", "variant")), F.lit("absent"))
    number = lambda k: F.when(kind(k) == "BIGINT", F.variant_get(v, f"$.{k}", "bigint"))
    data = F.try_variant_get(v, "$.data", "string")
    raw = F.try_to_binary(F.when(data.rlike("^([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"), data), F.lit("base64"))
    reason = F.when(v.isNull() | ~F.startswith(F.ltrim("wire"), F.lit("{")), "not an object")
    for k in ("seq", "width", "height", "format", "data"):
        reason = reason.when(kind(k).isin("absent", "VOID"), f"missing {k}")
    for k in ("seq", "width", "height", "source_seq", "tx_seq"):
        reason = reason.when(~kind(k).isin("BIGINT", "absent", "VOID"), f"{k} is not a whole number")
    reason = reason.when(F.try_variant_get(v, "$.format", "string") != "jpeg", "format").when(raw.isNull(), "data is not base64").when(F.hex(F.substring(raw, 1, 3)) != "FFD8FF", "not an image")
    return df.select("*", reason.alias("reject_reason"), number("seq").alias("seq"), F.coalesce(number("source_seq"), number("seq")).alias("source_seq"), number("tx_seq").alias("tx_seq"), F.octet_length(raw).cast("long").alias("bytes"))


def bounded_frame_sink(df: DataFrame, max_seconds: float = 2400.0, max_bytes: int = 2 << 30) -> DataFrame:
    """capture, seq, at, byte_count -> the frames inside both bounds, with the running total; the frame that would pass one closes the capture."""
    w = "PARTITION BY capture ORDER BY at, seq"
    out = df.selectExpr("*", f"sum(byte_count) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total", "at - min(at) OVER (PARTITION BY capture) AS seconds")
    out = out.withColumn("_over", (F.col("total") > max_bytes) | (F.col("seconds") >= max_seconds))
    return out.withColumn("_closed", F.expr(f"max(_over) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")).where("NOT _closed").drop("_over", "_closed")


def region_from_boxes(boxes: DataFrame, least: int = 3, least_height: float = 7.0, pad: float = 0.08, least_area: float = 0.03) -> DataFrame:
    """boxes (frame, w, h, x0, y0, x1, y1) -> a region a frame: from `least` boxes with an area on whose upper-middle height reaches the limit.

    The union is padded by 8 % of its sides and cut to the frame; it must cover 3 % of it. coverage: boxes' areas over its own, at most 1.
    """
    b = boxes.withColumn("bh", F.col("y1") - F.col("y0")).withColumn("a", (F.col("x1") - F.col("x0")) * F.col("bh")).where("bh > 0 AND a > 0")
    r = b.groupBy("frame", "w", "h").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("bh")).alias("hs"), *(f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))), F.sum("a").alias("area"))
    r = r.withColumn("median_height", F.get("hs", F.floor(F.col("n") / 2).cast("int"))).where((F.col("n") >= least) & (F.col("median_height") >= least_height))
    px, py = (F.col("x1") - F.col("x0")) * pad, (F.col("y1") - F.col("y0")) * pad
    r = r.select("frame", "w", "h", "n", "median_height", "area", F.greatest(F.lit(0.0), F.col("x0") - px).alias("x0"), F.greatest(F.lit(0.0), F.col("y0") - py).alias("y0"), F.least(F.col("w").cast("double"), F.col("x1") + px).alias("x1"), F.least(F.col("h").cast("double"), F.col("y1") + py).alias("y1"))
    union = F.greatest(F.col("x1") - F.col("x0"), F.lit(1.0)) * F.greatest(F.col("y1") - F.col("y0"), F.lit(1.0))
    r = r.withColumn("area_fraction", union / (F.col("w") * F.col("h"))).withColumn("coverage", F.least(F.lit(1.0), F.col("area") / union))
    return r.where(F.col("area_fraction") >= least_area).select("frame", "x0", "y0", "x1", "y1", "median_height", "area_fraction", "coverage")


def depth_validity(pixels: DataFrame, focal: float, cx: float, cy: float, edge: float = 0.1, grazing: float = 75.0, far: float = 1e9) -> DataFrame:
    """pixels (frame, u, v, z) -> usable: in front of the camera and not beyond `far`, its depth steps under `edge` of it to both sides, and its
    surface not seen from the side. Slopes are those of the neighbours on both sides, at a border of the one there is."""
    d = pixels
    for axis, other in (("u", "v"), ("v", "u")):
        w = f"PARTITION BY frame, {other} ORDER BY {axis}"
        d = d.selectExpr("*", f"lag(z) OVER ({w}) AS _a", f"lead(z) OVER ({w}) AS _b")
        step = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 2.0).otherwise(1.0)
        d = d.withColumn(f"g{axis}", (F.coalesce("_b", "z") - F.coalesce("_a", "z")) / step)
        d = d.withColumn(f"m{axis}", (F.coalesce("_b", "z") * F.when(F.col("_b").isNotNull(), F.col(axis) + 1).otherwise(F.col(axis)) - F.coalesce("_a", "z") * F.when(F.col("_a").isNotNull(), F.col(axis) - 1).otherwise(F.col(axis))) / step).drop("_a", "_b")
    # tangents along u and v of the point (x z, y z, z) with x, y the ray
    x, y = (F.col("u") - cx) / focal, (F.col("v") - cy) / focal
    tu = [(F.col("mu") - cx * F.col("gu")) / focal, y * F.col("gu"), F.col("gu")]
    tv = [x * F.col("gv"), (F.col("mv") - cy * F.col("gv")) / focal, F.col("gv")]
    n = [tu[1] * tv[2] - tu[2] * tv[1], tu[2] * tv[0] - tu[0] * tv[2], tu[0] * tv[1] - tu[1] * tv[0]]
    size = F.sqrt(sum(c * c for c in n)) * F.sqrt(x * x + y * y + 1)
    cosine = F.abs(n[0] * x + n[1] * y + n[2]) / F.nullif(size, F.lit(0.0))
    flat = (F.abs("gu") + F.abs("gv")) / F.greatest("z", F.lit(1e-6)) < edge
    ok = ~F.isnan("z") & (F.col("z") > 1e-3) & (F.col("z") <= far) & flat & (F.degrees(F.acos(F.least(cosine, F.lit(1.0)))) < grazing)
    return d.select("frame", "u", "v", F.coalesce(ok, F.lit(False)).alias("usable"))


def privacy_tags(df: DataFrame) -> DataFrame:
    """session, frame -> tags, an array: what an observation can be traced to."""
    return df.withColumn("tags", F.filter(F.array(F.when(F.col("session").isNotNull(), "session"), F.when(F.col("frame").isNotNull(), "frame")), lambda x: x.isNotNull()))


# ---- bindings

_BOX = [x for x in ("vec_id", "abs(CAST(embedding[0] AS DOUBLE)) * 500 AS x0", "abs(CAST(embedding[1] AS DOUBLE)) * 1200 AS y0", "abs(CAST(embedding[0] AS DOUBLE)) * 500 + abs(CAST(embedding[2] AS DOUBLE)) * 2400 AS x1",
                                "abs(CAST(embedding[1] AS DOUBLE)) * 1200 + abs(CAST(embedding[3] AS DOUBLE)) * 2400 AS y1", "CASE WHEN vec_id % 11 = 0 THEN 0 ELSE 360 END AS w", "640 AS h")]


def _sighting_rows(spark, sf):
    e = events(spark, sf).selectExpr("*", "CASE WHEN t - lag(t) OVER (PARTITION BY capture, label ORDER BY t, seq) <= 21600000000 THEN 0 ELSE 1 END AS fresh")
    e = e.withColumn("session", F.expr("sum(fresh) OVER (PARTITION BY capture, label ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"))
    s = e.groupBy("capture", "label", "session").agg(F.count("*").alias("frame_count"), F.max("score").alias("best_score"), F.max("seq").alias("last_seq"))
    tier = F.when(F.col("label") == "view", "verify").when(F.col("label") == "click", "context").when(F.col("label") == "error", "ignored").otherwise("remembered")
    s = s.select("*", tier.alias("tier"), (F.col("label") == "error").alias("excluded"), (F.col("label") != "signup").alias("allowed"), (F.col("last_seq") % 17 == 0).alias("recorded"), (F.col("last_seq") % 5 == 0).alias("part_of_another"), F.when(F.col("last_seq") % 3 > 0, F.col("last_seq") % 3 == 1).alias("agrees"))
    return sighting_gate(s, 0.02).select("capture", "label", F.col("session").cast("long").alias("session"), "verdict")


def _variants(spark, sf):
    """Wire messages of events, some of them broken by their number."""
    good = "'{\"seq\": ' || event_id || ', \"width\": 640, \"height\": 360, \"format\": \"jpeg\", \"data\": \"/9j/4AAQ\"'"
    more = "CASE event_id % 8 WHEN 1 THEN ', \"tx_seq\": true}' WHEN 2 THEN ', \"source_seq\": ' || (event_id * 2) || '}' WHEN 3 THEN ', \"tx_seq\": null}' WHEN 7 THEN ', \"tx_seq\": ' || (event_id + 1) || '}' ELSE '}' END"
    wire = f"CASE event_id % 13 WHEN 4 THEN '[1]' WHEN 5 THEN '{{\"seq\": 1}}' WHEN 6 THEN 'torn' WHEN 7 THEN replace({good}, '/9j/4AAQ', 'iVBORw0K') || {more} WHEN 8 THEN replace({good}, '/9j/4AAQ', '/9j/4A*') || {more} WHEN 9 THEN replace({good}, 'jpeg', 'png') || {more} WHEN 10 THEN replace({good}, ' 640,', ' 6.5,') || {more} ELSE {good} || {more} END"
    return frame_decode_validate(table(spark, sf, "events").selectExpr("event_id", f"{wire} AS wire")).drop("wire")


def _manifests(spark, sf):
    m = "CASE vec_id % 7 WHEN 0 THEN 'x' WHEN 1 THEN '{\"schema_version\": 2}' WHEN 2 THEN '{\"schema_version\": 1, \"session_id\": \"other\"}' WHEN 3 THEN '{\"schema_version\": 1, \"session_id\": \"s\", \"poses\": true, \"points\": 3}' ELSE '{\"schema_version\": 1, \"session_id\": \"s\", \"poses\": 2, \"points\": 3}' END"
    n = "sqrt(" + " + ".join(f"CAST(embedding[{i}] AS DOUBLE) * embedding[{i}]" for i in range(4)) + ")"
    df = table(spark, sf, "embeddings").selectExpr("vec_id", f"{m} AS manifest", "'s' AS session", f"CASE WHEN vec_id % 5 = 0 THEN array(CAST(1 AS DOUBLE)) ELSE transform(slice(embedding, 1, 4), x -> CAST(x AS DOUBLE) / CASE WHEN vec_id % 3 = 0 THEN 1 ELSE {n} END) END AS rotation", "CAST(vec_id % 6 - 1 AS DOUBLE) AS scale")
    return manifest_validation(df).select("vec_id", "problem")


def _faces(spark, sf):
    at = lambda i, a, b: f"CAST(embedding[{i}] AS DOUBLE) * {a} + {b}"
    base = [(30, 40), (70, 40), (50, 60), (35, 80), (65, 80)]
    cols = [f"{at(2 * i, 60, x)} AS px{i}" for i, (x, _) in enumerate(base)] + [f"{at(2 * i + 1, 60, y)} AS py{i}" for i, (_, y) in enumerate(base)]
    df = table(spark, sf, "embeddings").selectExpr("vec_id", "CASE WHEN vec_id % 9 = 0 THEN 0D ELSE 100D END AS bw", "120D AS bh", *cols)
    return face_box_gate(df).select("vec_id", "facelike")


_FACE_SQL = f"""
WITH p AS (SELECT vec_id, CASE WHEN vec_id % 9 = 0 THEN 0.0 ELSE 100.0 END::DOUBLE AS bw, [{', '.join(f'embedding[{2 * i + 1}]::DOUBLE * 60 + {x}' for i, x in enumerate((30, 70, 50, 35, 65)))}] AS xs, [{', '.join(f'embedding[{2 * i + 2}]::DOUBLE * 60 + {y}' for i, y in enumerate((40, 40, 60, 80, 80)))}] AS ys FROM embeddings),
e AS (SELECT *, xs[2] - xs[1] AS ex, ys[2] - ys[1] AS ey, sqrt((xs[2] - xs[1]) ** 2 + (ys[2] - ys[1]) ** 2) AS sep FROM p),
r AS (SELECT *, CASE WHEN ex < 0 THEN -1 ELSE 1 END AS s, xs[3] - (xs[1] + xs[2]) / 2 AS nx, ys[3] - (ys[1] + ys[2]) / 2 AS ny, (xs[4] + xs[5]) / 2 - xs[3] AS ox, (ys[4] + ys[5]) / 2 - ys[3] AS oy FROM e)
SELECT vec_id, CASE WHEN bw = 0 OR sep <= 1e-6 THEN NULL ELSE sep / bw >= 0.15 AND sep / bw <= 0.62 AND abs(nx * ex + ny * ey) / sep / sep <= 0.8
  AND s * (ny * ex - nx * ey) / sep / sep BETWEEN 0.25 AND 1.6 AND s * (oy * ex - ox * ey) / sep / sep BETWEEN 0.2 AND 1.9 AND sqrt((xs[5] - xs[4]) ** 2 + (ys[5] - ys[4]) ** 2) / sep BETWEEN 0.4 AND 1.25 END AS facelike FROM r
"""

OPS = {
    "retention_clamp": (
        lambda s, d: retention_clamp(table(s, d, "customer").selectExpr("c_custkey", "nullif(c_nationkey, 0) AS persisted", "nullif(c_custkey % 40, 0) AS requested", "element_at(array('ok', 'bad', 'absent'), CAST(c_custkey % 3 + 1 AS INT)) AS manifest", "c_acctbal > 0 AS has_data")).select("c_custkey", "effective_days"),
        """SELECT c_custkey, CASE WHEN p IS NULL THEN r WHEN r IS NULL THEN p WHEN p < r THEN p ELSE r END AS effective_days FROM (SELECT c_custkey, CASE WHEN c_custkey % 40 <> 0 THEN c_custkey % 40 END AS r,
           CASE WHEN c_custkey % 3 = 1 THEN 30 WHEN c_custkey % 3 = 2 THEN CASE WHEN c_acctbal > 0 THEN 30 END WHEN c_nationkey <> 0 THEN c_nationkey END AS p FROM customer) x""",
    ),
    "retention_view": (
        lambda s, d: retention_view(table(s, d, "customer").selectExpr("c_custkey", "nullif(c_nationkey, 0) AS persisted", "nullif(c_custkey % 30 - 5, 7) AS requested")),
        """WITH c AS (SELECT c_custkey, CASE WHEN c_nationkey > 0 THEN c_nationkey END AS persisted, CASE WHEN c_custkey % 30 <> 12 THEN c_custkey % 30 - 5 END AS requested FROM customer),
           e AS (SELECT *, CASE WHEN requested IS NULL OR requested <= 0 THEN persisted WHEN persisted IS NULL THEN requested WHEN requested < persisted THEN requested ELSE persisted END AS effective_days FROM c)
           SELECT *, CASE WHEN requested IS NULL OR effective_days IS NULL THEN false WHEN requested <= 0 THEN true ELSE requested > effective_days END AS clamped FROM e""",
    ),
    "observations_query": (
        lambda s, d: observations_query(events(s, d).selectExpr("seq AS id", "label", "score", "t / 1000000 AS observed_at", "t / 1000000 AS recorded_at"), "purchase", 1704153600.0, 1704200000.0).select("id", "place", "total"),
        "SELECT event_id AS id, rank() OVER (ORDER BY ts DESC, event_id) AS place, count(*) OVER () AS total FROM events WHERE event_type = 'purchase' AND epoch_us(ts) >= 1704200000000000",
    ),
    "detection_threshold": (
        lambda s, d: (lambda e: detection_threshold(e, 0.05, None).selectExpr("'all' AS setting", "seq").union(detection_threshold(e, 0.05, ["view", "click"]).selectExpr("'some'", "seq")).union(detection_threshold(e, 0.05, []).selectExpr("'none'", "seq")))(events(s, d)),
        "SELECT 'all' AS setting, event_id AS seq FROM events WHERE NOT value / 500 < 0.05 UNION ALL SELECT 'some', event_id FROM events WHERE NOT value / 500 < 0.05 AND (event_type = 'view' OR event_type = 'click')",
    ),
    "sighting_gate": (
        _sighting_rows,
        f"""WITH {DUCK_EVENTS}, g AS (SELECT *, CASE WHEN t - lag(t) OVER w > 21600000000 OR lag(t) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM ev WINDOW w AS (PARTITION BY capture, label ORDER BY t, seq)),
            i AS (SELECT *, sum(fresh) OVER (PARTITION BY capture, label ORDER BY t, seq) AS session FROM g), f AS (SELECT capture, label, session, count(*) AS n, max(score) AS best, max(seq) AS z FROM i GROUP BY ALL)
            SELECT capture, label, session::BIGINT AS session, CASE WHEN z % 17 = 0 THEN 'already-recorded' WHEN label = 'error' THEN 'excluded' WHEN label = 'click' THEN 'context-only' WHEN label = 'signup' THEN 'not-whitelisted' WHEN best < 0.02 THEN 'below-min-score'
              WHEN n <= 2 THEN 'too-brief' WHEN z % 5 = 0 THEN 'part-of-another' WHEN label = 'view' AND z % 3 <> 1 THEN 'unverified' ELSE 'record' END AS verdict FROM f""",
    ),
    "part_of_suppression": (
        lambda s, d: part_of_suppression(events(s, d), {"click": ["view"], "signup": ["purchase", "view"]}, 21600000000),
        f"""WITH {DUCK_EVENTS}, g AS (SELECT *, t - lag(t) OVER (PARTITION BY capture, label ORDER BY t, seq) AS gap FROM ev WHERE label IN ('click', 'signup')),
            i AS (SELECT *, count_if(gap IS NULL OR gap > 21600000000) OVER (PARTITION BY capture, label ORDER BY t, seq) AS session FROM g), k AS (SELECT *, row_number() OVER (PARTITION BY capture, label, session ORDER BY t, seq) AS k FROM i),
            ok AS (SELECT capture, label, session, min(t) AS recorded_at FROM k WHERE k >= 3 AND NOT EXISTS (SELECT 1 FROM ev w WHERE w.capture = k.capture AND (w.label = 'view' OR w.label = 'purchase' AND k.label = 'signup') AND w.t BETWEEN k.t - 21600000000 AND k.t) GROUP BY ALL)
            SELECT r.capture, r.label, first_at, recorded_at FROM (SELECT capture, label, session, min(t) AS first_at FROM k GROUP BY ALL HAVING count(*) >= 3) r LEFT JOIN ok USING (capture, label, session)""",
    ),
    "readable_page": (
        lambda s, d: readable_page(table(s, d, "documents").selectExpr("doc_id", "doc_id % 4 AS regions", "(doc_id % 10) / 20 AS confidence", "text")).select("doc_id", "readable"),
        "SELECT doc_id, doc_id % 4 > 0 AND doc_id % 10 >= 3 AND coalesce(regexp_matches(lower(text), '[a-z0-9][a-z0-9]'), false) AS readable FROM documents",
    ),
    "frame_stability": (
        lambda s, d: frame_stability(events(s, d).selectExpr("capture", "seq", "CASE WHEN seq % 400 < 200 THEN 640 ELSE 360 END AS width", "360 AS height", "score * 500 AS sharpness", "CAST(seq % 23 AS DOUBLE) AS shift", "seq % 10 / 10 AS response"), least_sharp=5.0).selectExpr("seq", "round(ratio, 6) AS ratio", "stable", "content_changed"),
        """WITH e AS (SELECT user_id, event_id AS seq, value, event_id % 400 < 200 AS big, lag(event_id % 400 < 200) OVER (PARTITION BY user_id ORDER BY event_id) AS was FROM events),
           r AS (SELECT *, count_if(was IS NULL OR was <> big) OVER (PARTITION BY user_id ORDER BY seq) AS run FROM e), b AS (SELECT *, coalesce(median(value) OVER (PARTITION BY user_id, run ORDER BY seq ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), value) AS base FROM r),
           q AS (SELECT *, CASE WHEN base > 0 THEN value / base ELSE 1 END AS ratio FROM b)
           SELECT seq, round(ratio, 6) AS ratio, seq % 23 < 0.02 * CASE WHEN big THEN sqrt(539200) ELSE sqrt(259200) END AND seq % 10 >= 2 AND value >= 5 AND ratio >= 0.5 AS stable, seq % 10 = 0 AND value >= 5 AND ratio >= 0.5 AS content_changed FROM q""",
    ),
    "keyframe_decision": (
        lambda s, d: keyframe_decision(events(s, d).selectExpr("seq", "seq % 21 / 20 AS sharp_ratio", "seq % 19 <> 0 AS tracking", "seq % 29 <> 0 AS has_keyframe", "seq % 11 / 10 AS survival", "seq % 4 AS losses", "CASE WHEN seq % 31 <> 0 THEN CAST(seq % 50 AS DOUBLE) END AS displacement", "seq % 6 AS frames_since", "seq % 9 / 8 AS overlap", "700D AS diagonal")).select("seq", "decision"),
        """SELECT event_id AS seq, CASE WHEN event_id % 21 < 5 THEN 'reject:blurred' WHEN event_id % 19 = 0 OR event_id % 29 = 0 THEN 'accept:session_seed' WHEN event_id % 11 < 2 THEN CASE WHEN event_id % 4 >= 2 THEN 'lost:tracking_lost' ELSE 'reject:tracking_held' END
           WHEN event_id % 11 < 4 THEN 'reject:tracking_degraded' WHEN event_id % 31 = 0 THEN 'skip:no_motion_evidence' WHEN event_id % 6 < 3 THEN 'skip:rate_limited' WHEN event_id % 9 < 6 THEN 'accept:overlap_floor'
           WHEN event_id % 50 >= 35 THEN 'accept:parallax' ELSE 'skip:insufficient_motion' END AS decision FROM events""",
    ),
    "apparent_size": (lambda s, d: person_view(table(s, d, "embeddings").selectExpr(*_BOX)).select("vec_id", "size"), "SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN 'unknown' WHEN abs(embedding[4]::DOUBLE) * 2400 / 640 < 0.3 THEN 'small' WHEN abs(embedding[4]::DOUBLE) * 2400 / 640 < 0.6 THEN 'medium' ELSE 'large' END AS size FROM embeddings"),
    "partial_figure": (
        lambda s, d: person_view(table(s, d, "embeddings").selectExpr(*_BOX)).select("vec_id", "partial"),
        "SELECT vec_id, vec_id % 11 <> 0 AND (t >= 0.45 OR (t >= 0.25 AND t + h >= 0.97 AND w >= 0.8)) AS partial FROM (SELECT vec_id, abs(embedding[2]::DOUBLE) * 1200 / 640 AS t, abs(embedding[4]::DOUBLE) * 2400 / 640 AS h, abs(embedding[3]::DOUBLE) * 2400 / 360 AS w FROM embeddings) x",
    ),
    "view_side": (
        lambda s, d: person_view(table(s, d, "embeddings").selectExpr(*_BOX)).select("vec_id", "side", "offset"),
        "SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN 'unknown' WHEN x < 0.35 THEN 'left' WHEN x <= 0.65 THEN 'centre' ELSE 'right' END AS side, CASE WHEN vec_id % 11 > 0 THEN round(2 * x - 1, 4) END AS \"offset\" FROM (SELECT vec_id, (abs(embedding[1]::DOUBLE) * 500 + abs(embedding[3]::DOUBLE) * 1200) / 360 AS x FROM embeddings) y",
    ),
    "timestamp_guard": (
        lambda s, d: timestamp_guard(table(s, d, "orders").selectExpr("o_custkey AS g", "o_orderkey", "CASE o_orderkey % 10 WHEN 3 THEN CAST('NaN' AS DOUBLE) WHEN 4 THEN CAST('Infinity' AS DOUBLE) WHEN 5 THEN NULL ELSE CAST(o_totalprice AS DOUBLE) END AS stamp"), "stamp", "o_orderkey").select("o_orderkey", "at", "place"),
        """WITH o AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 10 IN (3, 4, 5) THEN NULL ELSE o_totalprice::DOUBLE END AS v FROM orders)
           SELECT o_orderkey, v AS "at", (SELECT 1 + count(*) FROM o p WHERE p.o_custkey = o.o_custkey AND (p.v > o.v OR p.v IS NOT NULL AND o.v IS NULL OR p.v IS NOT DISTINCT FROM o.v AND p.o_orderkey < o.o_orderkey)) AS place FROM o""",
    ),
    "json_safe_values": (
        lambda s, d: json_safe(events(s, d).selectExpr("seq", "CASE seq % 5 WHEN 1 THEN CAST('NaN' AS DOUBLE) WHEN 2 THEN CAST('-Infinity' AS DOUBLE) ELSE score END AS flat", "named_struct('inner', array(score, CASE WHEN seq % 3 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE 1D END), 'm', map('k', CASE WHEN seq % 7 = 0 THEN CAST('NaN' AS DOUBLE) ELSE 2D END)) AS deep")).selectExpr("seq", "flat", "deep.inner[0] AS first", "deep.inner[1] AS second", "deep.m['k'] AS third"),
        "SELECT event_id AS seq, CASE WHEN event_id % 5 IN (1, 2) THEN NULL ELSE value / 500 END AS flat, value / 500 AS first, CASE WHEN event_id % 3 > 0 THEN 1.0::DOUBLE END AS second, CASE WHEN event_id % 7 > 0 THEN 2.0::DOUBLE END AS third FROM events",
    ),
    "answer_kind": (
        lambda s, d: answer_kind(table(s, d, "customer").join(table(s, d, "orders"), F.expr("c_custkey = o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("documents"), F.count_if(F.col("o_totalprice") > 200000).alias("found")).withColumn("pages", F.col("c_custkey") % 3).withColumn("characters", F.col("c_custkey") % 5)).select("c_custkey", "answer", "text_state"),
        """SELECT c_custkey, CASE WHEN n IS NULL THEN 'no_observation' WHEN big THEN 'matched' ELSE 'not_found' END AS answer, CASE WHEN c_custkey % 3 = 0 THEN 'unknown' WHEN c_custkey % 5 = 0 THEN 'not_readable' ELSE 'extracted' END AS text_state
           FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, bool_or(o_totalprice > 200000) AS big FROM orders GROUP BY 1) o ON c_custkey = o_custkey""",
    ),
    "face_box_gate": (_faces, _FACE_SQL),
    "manifest_validation": (
        _manifests,
        """WITH e AS (SELECT vec_id, vec_id % 6 - 1 AS scale, sqrt(list_sum(list_transform(embedding[1:4], lambda x: x::DOUBLE * x))) AS n FROM embeddings)
           SELECT vec_id, CASE vec_id % 7 WHEN 0 THEN 'not an object' WHEN 1 THEN 'schema' WHEN 2 THEN 'session' WHEN 3 THEN 'missing figures' ELSE CASE WHEN vec_id % 5 = 0 THEN 'not finite' WHEN vec_id % 3 = 0 AND abs(n - 1) > 0.001 THEN 'not a rotation' WHEN scale <= 0 THEN 'scale' END END AS problem FROM e""",
    ),
    "session_state": (
        lambda s, d: session_state(table(s, d, "orders").selectExpr("o_orderkey", "o_orderkey % 7 = 0 AS live", "CASE WHEN o_orderkey % 3 > 0 THEN 1.0D END AS ended_at", "element_at(array('stopped', 'error', 'interrupted'), CAST(o_orderkey % 5 % 3 + 1 AS INT)) AS end_reason", "element_at(array('complete', 'running', NULL), CAST(o_orderkey % 11 % 3 + 1 AS INT)) AS final_state", "CASE WHEN o_orderkey % 2 = 0 THEN 'solved' ELSE 'skipped' END AS final_solve", "o_orderkey % 13 < 6 AS has_geometry", "o_orderkey % 17 < 8 AS ran")).select("o_orderkey", "state"),
        """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 5 % 3 AS e, o_orderkey % 11 % 3 AS f, o_orderkey % 13 < 6 AS g, CASE WHEN o_orderkey % 17 < 8 THEN 'no_geometry' ELSE 'unbuilt' END AS none FROM orders)
           SELECT k AS o_orderkey, CASE WHEN k % 7 = 0 THEN CASE WHEN k % 3 = 0 THEN 'receiving' ELSE 'finalizing' END WHEN k % 3 = 0 THEN 'interrupted' WHEN f = 0 AND k % 2 = 0 AND g THEN 'complete' WHEN e IN (1, 2) THEN 'interrupted'
             WHEN f = 0 THEN CASE WHEN g THEN 'complete' ELSE none END WHEN f = 1 THEN 'interrupted' WHEN g THEN 'complete' ELSE none END AS state FROM o""",
    ),
    "cursor_class": (
        lambda s, d: cursor_class(table(s, d, "events").selectExpr("event_id", "CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE props END AS since", "lag(props) OVER (PARTITION BY user_id ORDER BY event_id) AS current")).select("event_id", "cursor"),
        "SELECT event_id, CASE WHEN event_id % 5 = 0 OR event_id % 5 > 1 AND props IS NULL THEN 'absent' WHEN event_id % 5 = 1 THEN 'unrecognised' WHEN props = was THEN 'matched' ELSE 'stale' END AS cursor FROM (SELECT *, lag(props) OVER (PARTITION BY user_id ORDER BY event_id) AS was FROM events) x",
    ),
    "tracking_state": (
        lambda s, d: tracking_state(events(s, d).selectExpr("capture", "seq", "CASE label WHEN 'view' THEN 'keyframe_accepted' WHEN 'error' THEN 'tracking_lost' ELSE label END AS kind", "t / 1000000 AS at"), 1706640000.0).selectExpr("capture", "last_kind", "state", "round(elapsed, 3) AS elapsed"),
        """SELECT user_id AS capture, CASE k WHEN 'view' THEN 'keyframe_accepted' WHEN 'error' THEN 'tracking_lost' END AS last_kind, CASE k WHEN 'view' THEN 'good' WHEN 'error' THEN 'lost' ELSE 'unknown' END AS state, CASE WHEN t <= 1706640000 THEN round(1706640000 - t, 3) END AS elapsed
           FROM (SELECT user_id, last(event_type ORDER BY event_id) FILTER (event_type IN ('view', 'error')) AS k, max(epoch_us(ts) / 1000000) AS t FROM events GROUP BY user_id) x""",
    ),
    "transient_mask_filter": (
        lambda s, d: transient_mask_filter(table(s, d, "embeddings").selectExpr("vec_id", "element_at(array('Left Hand', 'cell phone', 'cup', 'forearm'), CAST(vec_id % 4 + 1 AS INT)) AS label", "abs(CAST(embedding[0] AS DOUBLE)) * 4 AS score", "abs(CAST(embedding[1] AS DOUBLE)) * 5 - 0.02 AS area", "abs(CAST(embedding[2] AS DOUBLE)) * 6 AS filled")).select("vec_id", "kind"),
        """SELECT vec_id, CASE vec_id % 4 WHEN 1 THEN 'phone' ELSE 'hand' END AS kind FROM embeddings WHERE vec_id % 4 <> 2 AND abs(embedding[1]::DOUBLE) * 4 >= CASE vec_id % 4 WHEN 1 THEN 0.4 ELSE 0.3 END
           AND abs(embedding[2]::DOUBLE) * 5 - 0.02 > 0 AND abs(embedding[2]::DOUBLE) * 5 - 0.02 <= 0.5 AND abs(embedding[3]::DOUBLE) * 6 <= 0.6""",
    ),
    "capability_table": (
        lambda s, d: capability_table(table(s, d, "supplier").selectExpr("concat('f', s_suppkey) AS feature", "concat('r', s_nationkey) AS result", "'v1' AS contract", "CASE WHEN s_suppkey % 7 > 0 THEN s_nationkey END AS needs"), table(s, d, "nation").where("n_nationkey % 4 > 0").selectExpr("n_nationkey AS input", "CASE n_regionkey WHEN 1 THEN 'stale' WHEN 2 THEN 'loading' ELSE 'ready' END AS state")),
        """SELECT 'f' || s_suppkey AS feature, 'r' || s_nationkey AS result, 'v1' AS contract, reason IS NULL AS available, reason FROM (SELECT s_suppkey, s_nationkey, CASE WHEN s_suppkey % 7 = 0 THEN NULL WHEN s_nationkey % 4 = 0 THEN 'input-omitted'
           WHEN (SELECT n_regionkey FROM nation WHERE n_nationkey = s_nationkey) = 1 THEN 'input-stale' WHEN (SELECT n_regionkey FROM nation WHERE n_nationkey = s_nationkey) = 2 THEN 'input-loading' END AS reason FROM supplier) x""",
    ),
    "observation_view": (
        lambda s, d: observation_view(events(s, d).selectExpr("seq AS observation_id", "label", "score", "t AS observed_at", "capture AS session_id", "seq AS frame_seq", "CAST(NULL AS array<double>) AS box")).selectExpr("observation_id", "label", "score", "observed_at", "where.session_id", "where.frame_seq", "where.spatial_ref"),
        "SELECT event_id AS observation_id, event_type AS label, value / 500 AS score, epoch_us(ts) AS observed_at, user_id AS session_id, event_id AS frame_seq, NULL::VARCHAR AS spatial_ref FROM events",
    ),
    "frame_decode_validate": (
        _variants,
        """WITH e AS (SELECT event_id AS k, event_id % 13 AS b, event_id % 8 AS m FROM events), r AS (SELECT *, CASE WHEN b IN (4, 6) THEN 'not an object' WHEN b = 5 THEN 'missing width' WHEN b = 10 THEN 'width is not a whole number' WHEN m = 1 THEN 'tx_seq is not a whole number'
             WHEN b = 9 THEN 'format' WHEN b = 8 THEN 'data is not base64' WHEN b = 7 THEN 'not an image' END AS reject_reason FROM e)
           SELECT k AS event_id, reject_reason, CASE WHEN b = 5 THEN 1 WHEN b NOT IN (4, 6) THEN k END AS seq, CASE WHEN b = 5 THEN 1 WHEN b NOT IN (4, 6) THEN CASE m WHEN 2 THEN 2 * k ELSE k END END AS source_seq,
             CASE WHEN b NOT IN (4, 5, 6) AND m = 7 THEN k + 1 END AS tx_seq, CASE WHEN b NOT IN (4, 5, 6, 8) THEN 6 END::BIGINT AS bytes FROM r""",
    ),
    "bounded_frame_sink": (
        lambda s, d: bounded_frame_sink(events(s, d).selectExpr("capture", "seq", "t / 1000000 AS at", "CAST(score * 50000 AS BIGINT) AS byte_count"), 1500000.0, 100000).select("capture", "seq", "total"),
        """WITH e AS (SELECT user_id AS capture, event_id AS seq, epoch_us(ts) / 1000000 AS v, CAST(trunc(value / 500 * 50000) AS BIGINT) AS b FROM events), r AS (SELECT *, sum(b) OVER (PARTITION BY capture ORDER BY v, seq) AS total, v - first(v) OVER (PARTITION BY capture ORDER BY v, seq) AS s FROM e)
           SELECT capture, seq, total::BIGINT AS total FROM r WHERE total <= 100000 AND s < 1500000""",
    ),
    "privacy_tags": (
        lambda s, d: privacy_tags(events(s, d).selectExpr("seq", "nullif(capture % 3, 0) AS session", "nullif(seq % 4, 0) AS frame")).selectExpr("seq", "concat_ws('+', tags) AS tags", "size(tags) AS n"),
        "SELECT event_id AS seq, CASE WHEN user_id % 3 > 0 AND event_id % 4 > 0 THEN 'session+frame' WHEN user_id % 3 > 0 THEN 'session' WHEN event_id % 4 > 0 THEN 'frame' ELSE '' END AS tags, ((user_id % 3 > 0)::INT + (event_id % 4 > 0)::INT)::INT AS n FROM events",
    ),
    "region_from_boxes": (
        lambda s, d: region_from_boxes(table(s, d, "lineitem").selectExpr("l_orderkey AS frame", "199 AS w", "121 AS h", "CAST(l_partkey % 180 AS DOUBLE) AS x0", "CAST(l_suppkey % 100 AS DOUBLE) AS y0", "CAST(l_partkey % 180 + l_quantity AS DOUBLE) AS x1", "CAST(l_suppkey % 100 + l_quantity / 2 AS DOUBLE) AS y1")).selectExpr("frame", "round(x0, 6) AS x0", "round(y0, 6) AS y0", "round(x1, 6) AS x1", "round(y1, 6) AS y1", "median_height", "round(area_fraction, 6) AS area_fraction", "round(coverage, 6) AS coverage"),
        """WITH l AS (SELECT l_orderkey AS f, l_partkey % 180 AS a, l_suppkey % 100 AS b, l_quantity::DOUBLE AS w, l_quantity::DOUBLE / 2 AS h FROM lineitem WHERE l_quantity > 0), u AS (SELECT f, min(a)::DOUBLE AS a, min(b)::DOUBLE AS b, max(a + w) AS c, max(b + h) AS d, (list_sort(list(h)))[count(*) // 2 + 1] AS m, sum(w * h) AS s FROM l GROUP BY f HAVING count(*) > 2),
           p AS (SELECT f, m, s, greatest(0, a - 0.08 * (c - a)) AS x0, greatest(0, b - 0.08 * (d - b)) AS y0, least(199, c + 0.08 * (c - a)) AS x1, least(121, d + 0.08 * (d - b)) AS y1 FROM u WHERE m >= 7)
           SELECT f AS frame, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1, m AS median_height, round((x1 - x0) * (y1 - y0) / 24079, 6) AS area_fraction, round(least(1, s / ((x1 - x0) * (y1 - y0))), 6) AS coverage FROM p WHERE (x1 - x0) * (y1 - y0) / 24079 >= 0.03""",
    ),
    "depth_validity": (
        lambda s, d: depth_validity(table(s, d, "embeddings").selectExpr("vec_id AS frame", "posexplode(slice(embedding, 1, 64)) AS (i, e)").selectExpr("frame", "CAST(i % 8 AS DOUBLE) AS u", "CAST(i DIV 8 AS DOUBLE) AS v", "5D + frame % 3 + CAST(e AS DOUBLE) * CASE WHEN frame % 2 = 0 THEN 0.6D ELSE 3D END AS z"), 20.0, 4.0, 4.0),
        """WITH p AS (SELECT vec_id AS f, unnest(range(64)) AS i, unnest(embedding[1:64])::DOUBLE AS e FROM embeddings), z AS (SELECT f, i % 8 AS u, i // 8 AS v, 5 + f % 3 + e * CASE WHEN f % 2 = 0 THEN 0.6 ELSE 3 END::DOUBLE AS z FROM p), q AS (SELECT *, (u - 4) / 20 AS x, (v - 4) / 20 AS y FROM z),
           n AS (SELECT a.f, a.u, a.v, a.z, a.x, a.y, r.z * r.x - l.z * l.x AS ux, (r.z - l.z) * a.y AS uy, r.z - l.z AS uz, r.u - l.u AS du, (b.z - t.z) * a.x AS vx, b.z * b.y - t.z * t.y AS vy, b.z - t.z AS vz, b.v - t.v AS dv FROM q a JOIN q l ON l.f = a.f AND l.v = a.v AND l.u = greatest(a.u - 1, 0) JOIN q r ON r.f = a.f AND r.v = a.v AND r.u = least(a.u + 1, 7) JOIN q t ON t.f = a.f AND t.u = a.u AND t.v = greatest(a.v - 1, 0) JOIN q b ON b.f = a.f AND b.u = a.u AND b.v = least(a.v + 1, 7)),
           m AS (SELECT *, uy * vz - uz * vy AS nx, uz * vx - ux * vz AS ny, ux * vy - uy * vx AS nz FROM n)
           SELECT f AS frame, u::DOUBLE AS u, v::DOUBLE AS v, coalesce(z > 0.001 AND (abs(uz) / du + abs(vz) / dv) / z < 0.1 AND abs(nx * x + ny * y + nz) > cos(radians(75)) * sqrt((nx * nx + ny * ny + nz * nz) * (x * x + y * y + 1)), false) AS usable FROM m""",
    ),
}
