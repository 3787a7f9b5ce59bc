"""Stores of observations and points: guarded appends, growing updates, purges, binary buffers."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINT_BYTES = 16


def observation_sink_guarded(df: DataFrame, allowed: list[str], path: str) -> DataFrame:
    """Appends rows whose class is allowed; returns how many of each other class (null included) were refused."""
    ok = F.coalesce(F.col("class").isin(allowed), F.lit(False))
    df.where(ok).write.mode("append").parquet(path)
    return df.where(~ok).groupBy("class").agg(F.count("*").alias("refused"))


def tightest_retention(old: int | None, new: int | None) -> int | None:
    """Days of retention only ever shrink; null is without limit."""
    return min((x for x in (old, new) if x is not None), default=None)


def upsert_monotonic(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row per (class, observed_at): scores, times and counts only grow; confidence and frame go with the best score.

    Columns: class, observed_at, best_score, last_seen_at, frame_count, confidence, frame. Equal scores keep the old row's.
    """
    rows = old.withColumn("_age", F.lit(1)).unionByName(new.withColumn("_age", F.lit(0)))
    best = F.max(F.struct(F.coalesce("best_score", F.lit(float("-inf"))).alias("s"), "_age", "frame", "confidence")).alias("b")
    out = rows.groupBy("class", "observed_at").agg(F.max("best_score").alias("best_score"), F.max("last_seen_at").alias("last_seen_at"), F.max("frame_count").alias("frame_count"), best)
    return out.select("class", "observed_at", "best_score", "last_seen_at", "frame_count", F.col("b.confidence").alias("confidence"), F.col("b.frame").alias("frame"))


def _live(cutoff: float | None):
    return F.lit(True) if cutoff is None else F.coalesce((F.col("recorded_at") >= cutoff) & ~F.isnan("recorded_at"), F.lit(False))


def retained(df: DataFrame, cutoff: float | None) -> DataFrame:
    """Rows recorded at the cutoff or later; without a time they are expired. No cutoff keeps all."""
    return df.where(_live(cutoff))


def prune(df: DataFrame, cutoff: float | None) -> tuple[DataFrame, DataFrame]:
    """(rows kept, one row of removed and retained): the exact negation of what readers see goes."""
    return retained(df, cutoff), df.agg(F.count_if(~_live(cutoff)).alias("removed"), F.count_if(_live(cutoff)).alias("retained"))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """(path, index, x, y, z, r, g, b, confidence) of buffers of 16-byte little-endian records; a buffer of another length raises."""
    blobs = spark.read.format("binaryFile").load(path).select("path", "content")
    whole = F.when(F.octet_length("content") % POINT_BYTES == 0, F.col("content")).otherwise(F.raise_error(F.lit("length isn't a whole number of points")).cast("binary"))

    def run(batches):
        import numpy as np
        import pandas as pd

        kind = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("r", "u1"), ("g", "u1"), ("b", "u1"), ("confidence", "u1")])
        for batch in batches:
            for name, blob in zip(batch["path"], batch["content"]):
                points = np.frombuffer(blob, kind)
                for start in range(0, len(points), 1 << 16):
                    part = points[start : start + (1 << 16)]
                    yield pd.DataFrame({"path": name, "index": np.arange(start, start + len(part)), **{c: part[c] for c in kind.names}})

    return blobs.select("path", whole.alias("content")).mapInPandas(run, "path string, index long, x float, y float, z float, r int, g int, b int, confidence int")
