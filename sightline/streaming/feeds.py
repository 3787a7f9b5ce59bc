"""Event-time plans that run alike over a stream and a table of sightings."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sighting_tracker(frames: DataFrame, gap: str = "3 seconds", late: str = "90 seconds", min_frames: int = 3) -> DataFrame:
    """Sightings of capture_id and label from (capture_id, label, at timestamp, score): runs without a pause over gap.

    State is one row a run; a run closes when the watermark, late behind the newest event, passes it.
    """
    runs = frames.withWatermark("at", late).groupBy(F.session_window("at", gap).alias("run"), "capture_id", "label")
    out = runs.agg(F.count("*").alias("frame_count"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.max("score").alias("best_score"))
    return out.where(F.col("frame_count") >= min_frames).drop("run")


def session_metrics_stream(frames: DataFrame, window: str = "10 seconds", late: str = "90 seconds") -> DataFrame:
    """Frames, distinct labels (approximate) and mean score of each capture in fixed windows."""
    return (
        frames.withWatermark("at", late).groupBy(F.window("at", window).alias("w"), "capture_id")
        .agg(F.count("*").alias("frames"), F.approx_count_distinct("label").alias("labels"), F.avg("score").alias("mean_score"))
        .select("capture_id", F.col("w.start").alias("start"), "frames", "labels", "mean_score")
    )


def newest_wins_slot(offers: DataFrame) -> DataFrame:
    """Per target the newest offer's revision and how many older ones it replaced; equal times: the larger revision."""
    newest = F.max(F.struct("offered_at", "revision"))
    return offers.groupBy("target").agg(newest.alias("n"), (F.count("*") - 1).alias("skipped")).select("target", "n.revision", "n.offered_at", "skipped")


def late_verdicts(sightings: DataFrame, verdicts: DataFrame, early: str = "30 seconds", patience: str = "30 seconds", late: str = "10 seconds") -> DataFrame:
    """sightings (item, closed_at timestamp), verdicts (verdict_of, verdict, at timestamp) -> item, closed_at, verdict, verdict_at.

    A verdict counts from `early` before its sighting closed to `patience` after; without one a sighting is `unverified`. Over streams
    this is an outer join of both with watermarks: state on either side goes once the other can't match it any more, and a
    sighting that stays alone is told when the watermark passes its last moment. Of several verdicts of one item the first counts:
    the earliest in a table, the first that came in within the watermark in a stream.
    """
    if verdicts.isStreaming:
        first = verdicts.withWatermark("at", late).dropDuplicatesWithinWatermark(["verdict_of"])
        sightings = sightings.withWatermark("closed_at", late)
    else:
        first = verdicts.groupBy("verdict_of").agg(F.min_by(F.struct("verdict", "at"), F.struct("at", "verdict")).alias("v")).select("verdict_of", "v.*")
    near = (F.col("at") >= F.col("closed_at") - F.expr(f"INTERVAL {early}")) & (F.col("at") <= F.col("closed_at") + F.expr(f"INTERVAL {patience}"))
    out = sightings.join(first, (F.col("item") == F.col("verdict_of")) & near, "left")
    return out.select("item", "closed_at", F.when(F.col("at").isNull(), "unverified").otherwise(F.col("verdict")).alias("verdict"), F.col("at").alias("verdict_at"))
