from datetime import datetime, timedelta

from pyspark.sql import types as T

from sightline.sources.journal import journal_tail, jsonl_append, jsonl_scan
from sightline.streaming.feeds import newest_wins_slot, session_metrics_stream, sighting_tracker

FRAME = T.StructType().add("capture_id", "string").add("label", "string").add("at", "timestamp").add("score", "double")


def frames():
    t = datetime(2024, 1, 1)
    at = [0, 1, 2, 10, 11, 300]
    return [("a", "cup", t + timedelta(seconds=s), s / 100) for s in at] + [("b", "cup", t, None)]


def test_scan_skips_and_counts(spark, tmp_path):
    (tmp_path / "j.jsonl").write_bytes(b'{"a": 1}\n\n  \n{"a": 2, "b": 3}\n[1]\n{"z": 1}\n{"a": "\xff"}\n{"a": 4')
    rows, bad = jsonl_scan(spark, str(tmp_path / "j.jsonl"), T.StructType().add("a", "string"))
    assert [r.a for r in rows.collect()] == ["1", "2", None, "�"]
    assert bad.first().corrupt_count == 2


def test_stream_equals_batch(spark, tmp_path):
    src = f"{tmp_path}/src"
    jsonl_append(spark.createDataFrame(frames(), FRAME).coalesce(1), src)
    for plan, key in ((sighting_tracker, "first_at"), (session_metrics_stream, "start")):
        want = {(r.capture_id, r[key]): r for r in plan(spark.read.schema(FRAME).json(src)).collect()}
        name = plan.__name__
        q = plan(journal_tail(spark, src, FRAME)).writeStream.format("memory").queryName(name).outputMode("complete" if plan is session_metrics_stream else "append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(60)
        got = {(r.capture_id, r[key]): r for r in spark.table(name).collect()}
        assert got and all(want[k] == r for k, r in got.items())
    assert [r.frame_count for r in sighting_tracker(spark.read.schema(FRAME).json(src)).collect()] == [3]


def test_newest_offer_wins(spark):
    got = newest_wins_slot(spark.createDataFrame([("x", 1.0, 1), ("x", 2.0, 5), ("x", 2.0, 4), ("y", None, 1)], "target string, offered_at double, revision int")).collect()
    assert {(r.target, r.revision, r.skipped) for r in got} == {("x", 5, 2), ("y", 1, 0)}
