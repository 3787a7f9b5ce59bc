"""Folds with timers: worked cases, and streams that say what the table says, with late rows and silent keys."""
import os
import random

import pytest
from pyspark.sql import functions as F

from sightline.operators.timers import grace_windows, lab_runs
from sightline.streaming import timed
from sightline.streaming.feeds import late_verdicts


@pytest.fixture(scope="module")
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(key, old)


def play(fold, rows, until):
    return timed.advance(fold, None, rows, until)


def test_sightings():
    rows = [{"at": t, "score": s} for t, s in ((0.0, 0.6), (0.1, 0.9), (0.2, None), (3.2, 0.95), (6.2001, 0.5), (7.0, 0.5))]
    state, out = play(timed.Sightings(), rows, 10.0)
    assert [(r["kind"], r["at"], r["frames"], r["best"]) for r in out] == [("record", 0.2, 3, 0.9), ("update", 3.2, 4, 0.95), ("close", 6.2, 4, 0.95)]
    assert state["frames"] == 2 and play(timed.Sightings(), rows, 10.0001) == (None, out)  # immature: nothing to say, nothing kept


def test_feed():
    rows = [{"at": t, "body": b} for t, b in ((0.0, "a"), (1.0, "a"), (2.0, "b"), (9.0, "b"), (50.0, "b"))]
    _, out = play(timed.Feed(2.0, 10.0), rows, 53.0)
    assert [(r["kind"], r["at"], r["revision"]) for r in out] == [
        ("change", 0.0, 1), ("change", 2.0, 2), *(("heartbeat", float(t), 2) for t in range(4, 19, 2)), ("gone", 19.0, 2), ("change", 50.0, 1), ("heartbeat", 52.0, 1),
    ]


def test_carry():
    rows = [{"at": t, "steady": s, "region": r} for t, s, r in ((0.0, True, "x"), (0.2, True, "y"), (0.24, False, "z"), (0.25, True, None), (0.5, True, "w"), (2.1, True, None))]
    _, out = play(timed.Carry(), rows, 9.0)
    assert [(r["at"], r["ran"], r["region"], r["expired"]) for r in out] == [(0.0, True, "x", False), (0.2, False, "x", False), (0.25, True, None, False), (0.5, True, "w", False), (2.0, False, None, True), (2.1, True, None, False)]


def test_walks():
    rows = [{"at": float(t), "kind": k} for t, k in ((0, "start"), (5, "disconnect"), (95, "start"), (100, "disconnect"), (190.1, "start"), (200, "end"), (201, "start"), (300, "start"))]
    _, out = play(timed.Walks(), rows, 400.0)
    assert [(r["at"], r["walk"], r["event"]) for r in out] == [(0, 0, "begun"), (95, 0, "resumed"), (190, 0, "over"), (190.1, 1, "begun"), (200, 1, "over"), (201, 2, "begun"), (300, 2, "over"), (300, 3, "begun")]


def test_verdicts():
    r = lambda t, k, v=None: {"at": float(t), "kind": k, "verdict": v}
    cases = [([r(0, "closed"), r(30, "verdict", "agree")], [(30.0, "agree")]), ([r(0, "closed"), r(30.1, "verdict", "agree")], [(30.0, "unverified")]), ([r(0, "verdict", "no"), r(1, "verdict", "yes"), r(31, "closed")], [(31.0, "yes")]), ([r(0, "verdict", "no"), r(31, "closed")], [(61.0, "unverified")]), ([r(0, "closed"), r(1, "closed")], [(30.0, "unverified")])]
    for rows, want in cases:
        state, out = play(timed.Verdicts(), rows, 99.0)
        assert [(x["at"], x["verdict"]) for x in out] == want and state is None


FOLDS = [
    (timed.Sightings(1.0, 2, 3.0), "score double", lambda rnd: rnd.choice([None, 0.1, 0.5, 0.9])),
    (timed.Feed(0.7, 5.0), "body string", lambda rnd: rnd.choice(["a", "b", None])),
    (timed.Verdicts(1.5), "kind string", lambda rnd: rnd.choice(["closed", "verdict"])),
]


def test_streams_say_what_the_table_says(rocks, tmp_path):
    spark = rocks
    for n, (fold, column, value) in enumerate(FOLDS):
        rnd = random.Random(n)
        name = column.split()[0]
        extra = ", verdict string" if name == "kind" else ""
        rows = [(k, round(rnd.uniform(0, 40 if k != "silent" else 3), 2), i, value(rnd), *(["v%d" % i] if extra else [])) for i, k in enumerate(rnd.choice(["a", "b", None, "silent"]) for _ in range(160))]
        schema = f"k string, at double, seq int, {column}{extra}"
        rows.sort(key=lambda r: r[1] + rnd.uniform(0, 3))  # out of order by up to three seconds
        parts = [rows[i : i + 40] for i in range(0, len(rows), 40)]
        src = f"{tmp_path}/{n}/src"
        os.makedirs(src)
        stream = timed.fold_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), "k", ["seq"], fold, "4 seconds")
        for i, part in enumerate(parts):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
            q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/{n}/out").option("checkpointLocation", f"{tmp_path}/{n}/c").trigger(availableNow=True).start()
            q.awaitTermination(120)
        until = max(r[1] for r in rows) - 4
        want = timed.fold_table(spark.createDataFrame(rows, schema), "k", ["seq"], fold, until).collect()
        got = spark.read.parquet(f"{tmp_path}/{n}/out").collect()
        assert want and sorted(map(str, got)) == sorted(map(str, want)), n
        assert any(r.k == "silent" for r in got)  # ended by other keys' time


def test_rows_behind_the_watermark_are_dropped_and_state_goes(rocks, tmp_path):
    spark = rocks
    schema, src = "k string, at double, body string", f"{tmp_path}/src"
    os.makedirs(src)
    stream = timed.fold_stream(spark.readStream.schema(schema).parquet(src), "k", [], timed.Feed(100.0, 5.0), "1 second")

    def give(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/o").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return q.lastProgress

    give([("a", 1.0, "x"), ("b", 20.0, "x")])
    give([("a", 2.0, "late"), ("b", 21.0, "x")])
    last = give([("b", 60.0, "x")])
    got = sorted((r.k, r.kind, r.at) for r in spark.read.parquet(f"{tmp_path}/o").collect())
    assert got == [("a", "change", 1.0), ("a", "gone", 6.0), ("b", "change", 20.0), ("b", "gone", 26.0)]
    assert last is not None


def test_table_bounds(spark):
    df = spark.createDataFrame([("a", 0.0, "x"), ("a", None, "y"), ("a", 5.0, "y"), (None, 1.0, "z")], "k string, at double, body string")
    out = timed.fold_table(df, "k", [], timed.Feed(2.0, 60.0)).collect()
    assert sorted((str(r.k), r.kind, r.at) for r in out) == [("None", "change", 1.0), ("None", "heartbeat", 3.0), ("a", "change", 0.0), ("a", "change", 5.0), ("a", "heartbeat", 2.0), ("a", "heartbeat", 4.0)]
    assert timed.fold_table(df.limit(0), "k", [], timed.Feed()).count() == 0


def test_late_verdicts_as_streams(rocks, tmp_path):
    spark = rocks
    at = lambda c: F.timestamp_micros(((F.col(c) + 1000) * 1000000).cast("long"))
    sightings = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 2.0), (4, 3.0)], "item int, t double").select("item", at("t").alias("closed_at"))
    verdicts = spark.createDataFrame([(1, "agree", 20.0), (2, "disagree", 40.0), (3, "agree", 1.0), (3, "disagree", 9.0), (9, "agree", 5.0)], "verdict_of int, verdict string, t double").select("verdict_of", "verdict", at("t").alias("at"))
    want = {1: "agree", 2: "unverified", 3: "agree", 4: "unverified"}
    assert {r.item: r.verdict for r in late_verdicts(sightings, verdicts).collect()} == want
    s, v = f"{tmp_path}/s", f"{tmp_path}/v"
    sightings.coalesce(1).write.parquet(s)
    verdicts.coalesce(1).write.parquet(v)
    plan = late_verdicts(spark.readStream.schema(sightings.schema).parquet(s), spark.readStream.schema(verdicts.schema).parquet(v))

    def run():
        q = plan.writeStream.format("parquet").option("path", f"{tmp_path}/o").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination(120)

    run()
    for late, where in (((5, 200.0), s), ((5, "x", 200.0), v)):  # later rows of both sides move the watermark
        frame = spark.createDataFrame([late], "item int, t double").select("item", at("t").alias("closed_at")) if where == s else spark.createDataFrame([late], "verdict_of int, verdict string, t double").select("verdict_of", "verdict", at("t").alias("at"))
        frame.coalesce(1).write.mode("append").parquet(where)
    run()
    got = {r.item: r.verdict for r in spark.read.parquet(f"{tmp_path}/o").collect()}
    assert {k: x for k, x in got.items() if k != 5} == want


def test_graces_and_lab_runs_as_windows(spark):
    walks = [(0, "start"), (5, "disconnect"), (95, "start"), (100, "disconnect"), (190.1, "start"), (200, "end"), (201, "start")]
    df = spark.createDataFrame([("a", i, float(t), k) for i, (t, k) in enumerate(walks)], "key string, seq int, at double, kind string")
    assert [r.walk for r in grace_windows(df).orderBy("at").collect()] == [0, 0, 1, 2]
    runs = [("a", "sample", "x", 1.0), ("a", "sample", "x", 3.0), ("a", "sample", "x", None), ("a", "sample", None, 5.0), ("a", "sample", "z", 7.0), ("a", "stop", None, None), ("a", "sample", "x", 9.0), ("b", "stop", None, None), ("b", "sample", "x", 9.0)]
    df = spark.createDataFrame([(k, i, *r) for i, (k, *r) in enumerate(runs)], "key string, seq int, kind string, metric string, value double")
    got = sorted(tuple(r) for r in lab_runs(df, 2).collect())
    assert got == [("a", "", 1, 5.0, 5.0, 5.0), ("a", "(other)", 1, 7.0, 7.0, 7.0), ("a", "x", 2, 4.0, 1.0, 3.0)]
