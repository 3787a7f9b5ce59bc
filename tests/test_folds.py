import itertools
import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from sightline.functions.arrays import observation_id, perceptual_hash
from sightline.functions.assignment import assign, associate
from sightline.sources.store import observation_sink_guarded, prune, read_points, tightest_retention, upsert_monotonic
from sightline.streaming import folds
from sightline.streaming.keyed import fold_stream, fold_table


def play(fold, rows):
    step, close = fold if isinstance(fold, tuple) else (fold, lambda s: [])
    state, out = None, []
    for row in rows:
        state, made = step(state, row)
        state = json.loads(json.dumps(state))  # what a stream keeps
        out += made
    return out + (close(state) if state else [])


def test_assignment_is_best_of_all():
    rng = random.Random(1)
    for _ in range(300):
        n, m = rng.randrange(1, 5), rng.randrange(1, 5)
        w = {(i, j): rng.random() for i in range(n) for j in range(m) if rng.random() < 0.6}
        want = max((len(s), sum(w[p] for p in s)) for k in range(min(n, m) + 1) for s in itertools.combinations(w, k) if len({a for a, _ in s}) == len({b for _, b in s}) == k)
        got = assign(w)
        assert len(set(got.values())) == len(got) == want[0]
        assert sum(w[p] for p in got.items()) == pytest.approx(want[1])


def test_labels_must_agree():
    assert associate([["cup", 0, 0, 1, 1]], [["pen", 0, 0, 1, 1], ["cup", 0, 0, 1, 0.9]]) == {0: 1}


def test_tracker_latches_and_expires():
    box = '[{"label": "cup", "x0": 0, "y0": 0, "x1": 2, "y1": 2, "facing": null}]'
    out = play(folds.multi_object_tracker(patience=1), [{"at": float(i), "boxes": b} for i, b in enumerate([box, box, box, None, box, "[]", None, box])])
    assert [(r["event"], r["track_id"], r["confirmed"]) for r in out] == [("born", 0, False), ("seen", 0, False), ("seen", 0, True), ("missed", 0, True), ("seen", 0, True), ("missed", 0, True), ("expired", 0, True), ("born", 1, False)]


def test_dwell_ends():
    at = lambda t, x=0.5, seen=True, area=1.0: {"at": t, "visible": seen, "x": x, "y": 0.5, "area": area}
    rows = [at(t / 2) for t in range(6)] + [at(20 + t / 2) for t in range(4)] + [at(22, x=0.9)] + [at(22.5 + t / 2, x=0.9) for t in range(4)] + [at(26.0, seen=False)] + [at(30 + t / 2) for t in range(4)]
    assert [(r["frames"], r["reason"]) for r in play(folds.dwell_tracker(), rows)] == [(6, "gap"), (4, "region_moved"), (5, "region_lost"), (4, "stream_stopped")]


def test_small_folds():
    assert [r["found"] for r in play(folds.frame_gate(), [{"at": 0.0, "found": True}, {"at": 0.1, "found": False}, {"at": 1.4, "found": None}, {"at": 1.7, "found": None}])] == [True, True, True, None]
    frames = [{"seq": i, "sharp": s, "survival": v, "moved": m, "overlap": o} for i, (s, v, m, o) in enumerate([(0.1, 1, 0.1, 1), (1, 1, 0.1, 1), (1, 1, 0.1, 1), (1, 0.3, 0.1, 1), (1, 1, None, 1), (1, 1, 0.05, 1), (1, 0.1, 0, 1), (1, 0.1, 0, 1), (0.1, 1, 0, 1), (1, 0.1, 0, 1), (1, 0.1, 0, 1)])]
    assert [(r["decision"], r["segment"]) for r in play(folds.keyframe_gates(), frames)] == [
        ("reject:blurred", 0), ("accept:session_seed", 0), ("skip:rate_limited", 0), ("reject:tracking_degraded", 0), ("skip:no_motion_evidence", 0), ("accept:parallax", 0),
        ("reject:tracking_held", 0), ("reject:tracking_held", 0), ("reject:blurred", 0), ("lost:tracking_lost", 0), ("accept:session_seed", 1),
    ]
    assert play(folds.bounded_queue(2), [{"kind": "offer", "item": str(i)} for i in range(3)] + [{"kind": "take", "item": None}] * 3) == [{"item": "1", "dropped": 1}, {"item": "2", "dropped": 1}, {"item": None, "dropped": 1}]
    feed = [(0.0, '{"a": 1, "age": 1}'), (1.0, '{"age": 2, "a": 1}'), (2.0, '{"a": 1}'), (2.5, '{"a": 2}'), (3.0, None)]
    assert [(r["kind"], r["revision"]) for r in play(folds.change_feed(), [{"at": t, "payload": p} for t, p in feed])] == [("change", 1), ("heartbeat", 1), ("change", 2), ("change", 3)]
    assert [r["side"] for r in play(folds.side_hysteresis(), [{"at": 0, "x": x} for x in (0.34, 0.31, 0.37, 0.39, None, 0.9)])] == ["centre", "left", "left", "centre", "unknown", "right"]


def test_stream_equals_table(spark, tmp_path):
    rng = random.Random(3)
    box = lambda: [{"label": "cup", "x0": (x := rng.random()), "y0": 0.0, "x1": x + 1, "y1": 1.0, "facing": None}] if rng.random() < 0.7 else []
    rows = [(k, float(t), json.dumps(box())) for k in "ab" for t in range(40)]
    src, step, schema = f"{tmp_path}/src", folds.multi_object_tracker(), "capture string, " + folds.TRACKS
    df = spark.createDataFrame(rows, "capture string, at double, boxes string")
    df.where("at < 20").coalesce(1).write.parquet(src)
    df.where("at >= 20").coalesce(1).write.mode("append").parquet(src)
    want = sorted(map(tuple, fold_table(df, "capture", ["at"], step, schema).collect()))
    q = fold_stream(spark.readStream.schema(df.schema).parquet(src), "capture", ["at"], step, schema).writeStream.format("memory").queryName("tracks").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert want and sorted(map(tuple, spark.table("tracks").collect())) == want
    step, close = folds.dwell_tracker()
    assert fold_table(spark.createDataFrame([], "c string, at double, visible boolean, x double, y double, area double"), "c", ["at"], step, "c string, " + folds.DWELLS, close).collect() == []
    one = spark.createDataFrame([(None, i / 2, True, 0.5, 0.5, 1.0) for i in range(5)], "c string, at double, visible boolean, x double, y double, area double")
    assert [tuple(r) for r in fold_table(one, "c", ["at"], step, "c string, " + folds.DWELLS, close).collect()] == [(None, 0.0, 2.0, 5, "stream_stopped")]


def test_store(spark, tmp_path):
    df = spark.createDataFrame([("cup", 1.0), ("face", 2.0), (None, None)], "class string, recorded_at double")
    assert {r["class"]: r.refused for r in observation_sink_guarded(df, ["cup"], f"{tmp_path}/o").collect()} == {"face": 1, None: 1}
    assert spark.read.parquet(f"{tmp_path}/o").count() == 1
    kept, tally = prune(df, 2.0)
    assert [r["class"] for r in kept.collect()] == ["face"] and tuple(tally.first()) == (2, 1)
    assert tightest_retention(None, 3) == 3 and tightest_retention(2, None) == 2 and tightest_retention(None, None) is None
    schema = "class string, observed_at double, best_score double, last_seen_at double, frame_count long, confidence string, frame string"
    old = spark.createDataFrame([("cup", 1.0, 0.5, 9.0, 4, "medium", "f1")], schema)
    new = spark.createDataFrame([("cup", 1.0, 0.5, 3.0, 7, "low", "f2"), ("pen", 1.0, None, 1.0, 1, "unknown", "f3")], schema)
    assert sorted(map(tuple, upsert_monotonic(old, new).collect())) == [("cup", 1.0, 0.5, 9.0, 7, "medium", "f1"), ("pen", 1.0, None, 1.0, 1, "unknown", "f3")]
    (tmp_path / "p.bin").write_bytes(b"".join(struct.pack("<fff4B", i, 0.5, -1, 1, 2, 3, 255) for i in range(3)))
    assert [tuple(r)[1:] for r in read_points(spark, f"{tmp_path}/p.bin").orderBy("index").collect()] == [(i, float(i), 0.5, -1.0, 1, 2, 3, 255) for i in range(3)]
    (tmp_path / "bad.bin").write_bytes(b"123")
    with pytest.raises(Exception, match="whole number"):
        read_points(spark, f"{tmp_path}/bad.bin").collect()


def test_arrays(spark):
    flat, ramp = [1.0] * 1024, [float(i % 32) for i in range(1024)]
    got = spark.createDataFrame([("s", 1, "cup", ramp), ("s", 2, None, flat[:5])], "s string, f long, c string, p array<double>").select(observation_id("s", "c", F.col("f").cast("double")).alias("i"), perceptual_hash("p").alias("h")).collect()
    assert len(got[0].i) == len(got[0].h) == 16 and got[1].i is None and got[1].h is None


def test_tracker_forgets_what_a_lost_track_faced():
    b = lambda f: json.dumps([{"label": "p", "x0": 0, "y0": 0, "x1": 2, "y1": 2, "facing": f}])
    out = play(folds.multi_object_tracker(), [{"at": float(i), "boxes": x} for i, x in enumerate([b("toward"), b(None), None, b(None), b("away")])])
    assert [(r["event"], r["facing"]) for r in out] == [("born", "toward"), ("seen", "toward"), ("missed", "toward"), ("seen", None), ("seen", "away")]
    out = play(folds.multi_object_tracker(), [{"at": float(i), "boxes": x} for i, x in enumerate([b(None)] * 3 + [None] * 13)])
    assert [r["counted"] for r in out] == [False, False] + [True] * 7 + [False] * 7 and out[-1]["event"] == "expired" and out[-2]["event"] == "missed"


def test_sightings_speak_early_and_close():
    at = lambda t, s: {"at": t, "score": s}
    out = play(folds.sighting_updates(), [at(0.0, 0.6), at(0.1, 0.9), at(0.2, 0.9), at(0.3, 0.9), at(1.0, 0.95), at(4.0, 0.5), at(7.0, None), at(10.0, 0.1), at(12.0, 0.1), at(15.1, 0.1), at(20.0, 0.2)])
    assert [(r["kind"], r["frames"], r["best"]) for r in out] == [("record", 3, 0.9), ("update", 5, 0.95), ("update", 9, 0.95), ("close", 9, 0.95)]


def test_slots_count_what_they_replace():
    r = lambda t, w, v=None: {"at": t, "what": w, "revision": v}
    out = play(folds.publish_slot(), [r(0, "take"), r(1, "offer", "a"), r(1, "offer", "a"), r(2, "offer", "b"), r(2, "offer", "c"), r(3, "take"), r(3.5, "offer", "c"), r(4, "take"), r(5, "take")])
    assert [(x["at"], x["kind"], x["revision"], x["coalesced"]) for x in out] == [(3, "change", "c", 2), (5, "heartbeat", "c", 0)]


def test_segments_by_breaks_and_pages():
    r = lambda i, lost=False, broken=False, key=False: {"seq": i, "lost": lost, "broken": broken, "keyframe": key}
    rows = [r(0, key=True), r(1, broken=True, key=True), r(2, key=True), r(3, lost=True), r(4, lost=True), r(5, lost=True), r(6, key=True), r(7, lost=True)]
    assert [x["segment"] for x in play(folds.segment_index(), rows)] == [0, 0, 1, 2, 3, 3, 3, 4]
    pages = [1, 1, 0.1, 0.1, 1, 0.1, 0.1, 0.1, 1, None]
    assert [(x["segment"], x["first_seq"], x["frames"]) for x in play(folds.content_segments(), [{"seq": i, "alike": a} for i, a in enumerate(pages)])] == [(0, 0, 5), (1, 5, 5)]
    many = [x for _ in range(9) for x in (1, 0.1, 0.1, 0.1)]
    kept = play(folds.content_segments(), [{"seq": i, "alike": a} for i, a in enumerate(many)])
    assert [r["segment"] for r in kept] == [4, 5, 6, 7, 8, 9]  # the oldest go
    torn = [1, 0.1, None, 0.1, None, 0.1, 1, 0.1, None, 1, 0.1, 0.1]
    assert [(r["segment"], r["first_seq"], r["frames"]) for r in play(folds.content_segments(), [{"seq": i, "alike": a} for i, a in enumerate(torn)])] == [(0, 0, 3), (1, 1, 9)]  # a null neither agrees nor disagrees
