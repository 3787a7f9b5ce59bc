"""Operators on small tables with nulls, ties and rows at the limits; the results are worked by hand."""
import json
import math

import pytest
from pyspark.sql import functions as F

from sightline.operators import finding as fi
from sightline.operators import gating as ga
from sightline.operators import keeping as ke
from sightline.operators import linking as li
from sightline.operators import measuring as me
from sightline.operators import ordering as od
from sightline.operators import shaping as sh
from sightline.plans.kernels import REGISTRY, FixedRows, Kernel, Registry, attach_rows

INF, NAN = float("inf"), float("nan")


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=str)


# ---- gates


def test_retention_pairs(spark):
    df = spark.createDataFrame([(1, 30, 3650, "ok", True), (2, 3, None, "ok", True), (3, None, 7, "ok", True), (4, None, None, "ok", True), (5, None, None, "absent", True), (6, None, None, "absent", False), (7, 3, 90, "bad", True), (8, 3, 5, "bad", False)], "id int, persisted int, requested int, manifest string, has_data boolean")
    assert rows(ga.retention_clamp(df), "id", "effective_days") == [(1, 30), (2, 3), (3, 7), (4, None), (5, 30), (6, None), (7, 30), (8, 5)]


def test_retention_view(spark):
    df = spark.createDataFrame([(1, 30, 3650), (2, 30, None), (3, 30, 0), (4, 30, 7), (5, None, 0), (6, 30, 30)], "id int, persisted int, requested int")
    assert rows(ga.retention_view(df), "id", "effective_days", "clamped") == [(1, 30, True), (2, 30, False), (3, 30, True), (4, 7, False), (5, None, False), (6, 30, False)]


def test_gate_order_and_limits(spark):
    base = dict(recorded=False, excluded=False, tier="remembered", allowed=True, best_score=0.5, frame_count=3, part_of_another=False, agrees=None)
    cases = [
        ({}, "record"), ({"recorded": True, "excluded": True}, "already-recorded"), ({"excluded": True, "best_score": 0.0}, "excluded"), ({"tier": "context", "best_score": 0.0}, "context-only"),
        ({"tier": "ignored"}, "not-whitelisted"), ({"allowed": False}, "not-whitelisted"), ({"best_score": 0.49, "frame_count": 1}, "below-min-score"), ({"best_score": None}, "below-min-score"), ({"frame_count": 2, "part_of_another": True}, "too-brief"),
        ({"part_of_another": True, "tier": "verify"}, "part-of-another"), ({"tier": "verify"}, "unverified"), ({"tier": "verify", "agrees": False}, "unverified"), ({"tier": "verify", "agrees": True}, "record"),
    ]
    df = spark.createDataFrame([(i, *{**base, **c}.values()) for i, (c, _) in enumerate(cases)], "id int, recorded boolean, excluded boolean, tier string, allowed boolean, best_score double, frame_count int, part_of_another boolean, agrees boolean")
    assert rows(ga.sighting_gate(df, 0.5), "id", "verdict") == sorted([(i, v) for i, (_, v) in enumerate(cases)], key=str)


def test_part_is_kept_once_no_whole_is_open(spark):
    """A keyboard beside an open laptop waits; alone it is recorded; a whole seen for one frame doesn't hold it for good."""
    f = [(1, "keyboard", t, t) for t in (0, 1, 2, 3, 9, 10, 11)] + [(1, "laptop", 1, 100), (1, "laptop", 2, 101)] + [(2, "keyboard", t, t) for t in (0, 1, 2)] + [(3, "keyboard", t, t) for t in (0, 1)]
    df = spark.createDataFrame(f, "capture int, label string, t long, seq int")
    got = ga.part_of_suppression(df, {"keyboard": ["laptop"]}, 3)
    assert rows(got, "capture", "first_at", "recorded_at") == [(1, 0, None), (1, 9, 11), (2, 0, 2)]
    assert rows(ga.part_of_suppression(df, {"keyboard": ["desk"]}, 3), "capture", "first_at", "recorded_at") == [(1, 0, 2), (1, 9, 11), (2, 0, 2)]


def test_detection_threshold(spark):
    df = spark.createDataFrame([("a", 0.5), ("b", 0.49), (None, 0.9), ("a", None)], "label string, score double")
    assert [ga.detection_threshold(df, 0.5, c).count() for c in (None, ["a"], [])] == [2, 1, 0]


def test_person_view_at_its_limits(spark):
    df = spark.createDataFrame([(1, 0.0, 45.0, 10.0, 100.0, 100, 100), (2, 0.0, 25.0, 80.0, 97.0, 100, 100), (3, 0.0, 25.0, 79.0, 97.0, 100, 100), (4, 0.0, 0.0, 1.0, 60.0, 100, 100), (5, 0.0, 0.0, 1.0, 29.0, 100, 100), (6, 0.0, 0.0, 70.0, 1.0, 100, 100), (7, 30.0, 0.0, 100.0, 1.0, 100, 100), (8, 0.0, 0.0, 1.0, 1.0, 0, 100), (9, None, 0.0, 1.0, 1.0, 100, 100)], "id int, x0 double, y0 double, x1 double, y1 double, w int, h int")
    got = {r.id: (r.size, r.partial, r.side, r.offset) for r in ga.person_view(df).collect()}
    assert [got[i][1] for i in (1, 2, 3)] == [True, True, False] and [got[i][0] for i in (4, 5)] == ["large", "small"]
    assert got[6][2:] == ("centre", -0.3) and got[7][2:] == ("centre", 0.3) and got[8] == ("unknown", False, "unknown", None) and got[9][2:] == ("unknown", None)


def test_json_safe_reaches_every_depth(spark):
    df = spark.createDataFrame([(NAN, [1.0, INF, None], {"k": -INF, "l": 2.0}, (NAN, [(INF,)]))], "a double, b array<double>, c map<string,double>, d struct<x: double, y: array<struct<z: double>>>")
    r = ga.json_safe(df).first()
    assert (r.a, r.b, r.c, r.d.x, r.d.y[0].z) == (None, [1.0, None, None], {"k": None, "l": 2.0}, None, None)


def test_timestamp_guard(spark):
    df = spark.createDataFrame([(1, "a", 5.0), (1, "b", NAN), (1, "c", INF), (1, "d", None), (1, "e", 7.0), (1, "f", 5.0)], "g int, id string, t double")
    assert [r.id for r in ga.timestamp_guard(df, "t", "id").orderBy("place").collect()] == ["e", "a", "f", "b", "c", "d"]


def test_frames_on_the_wire(spark):
    good = {"seq": 1, "width": 2, "height": 3, "format": "jpeg", "data": "/9j/4AAQ"}
    cases = [good, good | {"source_seq": 9, "tx_seq": 4}, good | {"seq": True}, good | {"seq": 1.5}, {k: v for k, v in good.items() if k != "data"}, good | {"format": "png"}, good | {"data": "/9j/4AA"}, good | {"data": "AAAA"}, good | {"width": None}]
    texts = [json.dumps(c) for c in cases] + ["[1]", "torn", None]
    got = [r.reject_reason for r in ga.frame_decode_validate(spark.createDataFrame(list(enumerate(texts)), "id int, wire string")).orderBy("id").collect()]
    assert got == [None, None, "seq is not a whole number", "seq is not a whole number", "missing data", "format", "data is not base64", "not an image", "missing width", "not an object", "not an object", "not an object"]


def test_manifests(spark):
    ok = '{"schema_version": 1, "session_id": "s", "poses": 1, "points": 0}'
    one = [1.0, 0.0, 0.0, 0.0]
    df = spark.createDataFrame([(1, ok, "s", one, 1.0), (2, ok, "t", one, 1.0), (3, ok.replace("1,", "true,", 1), "s", one, 1.0), (4, ok, "s", [1.0009, 0.0, 0.0, 0.0], 1.0), (5, ok, "s", [1.002, 0.0, 0.0, 0.0], 1.0), (6, ok, "s", one, 0.0), (7, ok, "s", [NAN, 0.0, 0.0, 0.0], 1.0), (8, ok.replace('"points": 0', '"points": null'), "s", one, 1.0), (9, None, "s", one, 1.0)], "id int, manifest string, session string, rotation array<double>, scale double")
    assert rows(ga.manifest_validation(df), "id", "problem") == [(1, None), (2, "session"), (3, "schema"), (4, None), (5, "not a rotation"), (6, "scale"), (7, "not finite"), (8, "missing figures"), (9, "not an object")]


def test_frame_sink_closes_at_the_first_bound(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 50), (1, 2, 1.0, 50), (1, 3, 2.0, 1), (1, 4, 3.0, 0), (2, 1, 0.0, 1), (2, 2, 9.9, 1), (2, 3, 10.0, 1)], "capture int, seq int, at double, byte_count long")
    assert rows(ga.bounded_frame_sink(df, 10.0, 100), "capture", "seq") == [(1, 1), (1, 2), (2, 1), (2, 2)]


def test_stability_starts_anew_with_the_frame_size(spark):
    df = spark.createDataFrame([(1, 1, 100, 100, 50.0, 0.0, 1.0), (1, 2, 100, 100, 24.0, 0.0, 1.0), (1, 3, 200, 100, 30.0, 0.0, 0.05)], "capture int, seq int, width int, height int, sharpness double, shift double, response double")
    assert rows(ga.frame_stability(df), "seq", "ratio", "stable", "content_changed") == [(1, 1.0, True, False), (2, 0.48, False, False), (3, 1.0, False, True)]


# ---- finding


def test_near_terms(spark):
    terms = spark.createDataFrame([("kubernetes",), ("port",), ("there",)], "term string")
    words = spark.createDataFrame([(w,) for w in "kubernetes kubemetes port sport ports therefore thereafter their theres there".split()], "token string")
    got = {(r.term, r.token): r.weight for r in fi.fuzzy_expand(terms, words).collect()}
    assert got == {("kubernetes", "kubernetes"): 1.0, ("kubernetes", "kubemetes"): 0.6, ("port", "port"): 1.0, ("there", "there"): 1.0, ("there", "therefore"): 0.6, ("there", "thereafter"): 0.6, ("there", "theres"): 0.6}


def test_search(spark):
    docs = spark.createDataFrame([(1, "Transformers\nattention is all you need\ntransformer attention"), (2, "Depth scale\nmetric distance"), (3, None), (4, " \n"), (5, "receipt\nkubemetes cluster"), (6, "receipt\nnothing")], "doc_id long, text string")
    ask = lambda q: [(r.doc_id, r.page, r.exact_terms, r.fuzzy) for r in fi.search_rank(fi.best_page_per_document(fi.page_scores(fi.pages_of(docs), spark.createDataFrame([(1, q)], "query int, text string")))).orderBy("place").collect()]
    assert ask("transformer attention")[0] == (1, 2, 2, False)
    assert ask("metric distance")[0] == (2, 1, 2, False)
    assert [d for d, *_ in ask("receipt")] == [5, 6]  # equal scores: by id
    assert ask("kubernetes") == [(5, 1, 0, True)]
    assert ask("the of and") == ask("") == ask("absent") == []


def test_readings(spark):
    w = lambda t: t.split()
    near, far = "0" * 16, "f" * 16
    text = w("alpha beta gamma delta epsilon zeta")
    cases = [
        (text, [], 0.9, near, text, [], 0.9, near, "same"), (text, [], 0.9, near, text, [], 0.9, far, "shares-text"), (text, [], 0.9, None, text, [], 0.9, far, "same"), (text, [], 0.9, near, w("one two three"), [], 0.9, "0" * 15 + "3", "same-look"),
        (text, [], 0.2, near, text, [], 0.9, near, "abstain"), (w("a b c"), [], 0.9, near, w("a b c"), [], 0.9, near, "abstain"), (text, ["1", "2", "3"], 0.9, None, text, ["4", "5", "6"], 0.9, None, "shares-text"), (text, [], 0.9, None, w("one two three"), [], 0.9, None, "different"),
    ]
    df = spark.createDataFrame([(i, *c[:-1]) for i, c in enumerate(cases)], "i int, a_words array<string>, a_figures array<string>, a_confidence double, a_hash string, b_words array<string>, b_figures array<string>, b_confidence double, b_hash string")
    assert [r.decision for r in fi.compare_readings(df).orderBy("i").collect()] == [c[-1] for c in cases]


def test_the_newest_of_the_last_records_wins(spark):
    text = "alpha beta gamma delta"
    df = spark.createDataFrame([("x", i, text if i in (1, 4, 9) else f"other{i} words{i} here{i} now{i}", 0.9, None) for i in range(1, 10)], "library string, id long, text string, confidence double, hash string")
    assert {r.id: r.again_of for r in fi.resighting_match(df).collect() if r.again_of} == {4: 1, 9: 4}
    assert {r.id: r.again_of for r in fi.resighting_match(df, last=4).collect() if r.again_of} == {4: 1}


def test_hashes_words_and_union(spark):
    df = spark.createDataFrame([("0" * 16, "0" * 15 + "f"), ("0" * 16, "f" * 16), ("zz", "0" * 16), (None, "0" * 16)], "a string, b string")
    assert [r[0] for r in df.select(fi.hash_distance(F.col("a"), F.col("b"))).collect()] == [4, 64, None, None]
    df = spark.createDataFrame([(1, "a a b c", "a c"), (2, "", "a"), (3, "x", None), (4, None, None)], "id int, expected string, actual string")
    assert rows(fi.word_recall(df), "id", "recall") == [(1, 0.75), (2, 1.0), (3, 0.0), (4, 1.0)]
    df = spark.createDataFrame([(1, 1, "b"), (1, 2, "a"), (2, 1, "b"), (2, 2, "c")], "part int, pos int, value string")
    assert [r.value for r in fi.ordered_union_distinct(df).orderBy("place").collect()] == ["b", "a", "c"]


def test_title_is_the_leading_run(spark):
    r = lambda y, t: (float(y), 10.0, t)
    df = spark.createDataFrame([(1, [r(0, "Attention"), r(5, "Is All"), r(30, "body"), r(1, "late")]), (2, [r(0, "w " * 45)]), (3, [])], "id int, regions array<struct<y: double, height: double, text: string>>")
    got = {x.id: (x.title, x.summary) for x in fi.title_and_summary(df).collect()}
    assert got[1] == ("Attention Is All", "Attention Is All body late") and got[2][1] == " ".join(["w"] * 40) + "..." and got[3] == ("", "")


# ---- measuring


def test_session_metrics(spark):
    f = [(1, i, s, t, float(i), 10, 1.0, a) for i, (s, t, a) in enumerate([(1, 1, True), (31, 2, True), (5, 3, False), (61, 4, True)])] + [(2, 0, 7, None, 0.0, 5, 2.0, True)] + [(3, 0, 9, 1, 0.0, 5, 2.0, True), (3, 1, 3, 9, 1.0, 5, 4.0, True)]
    df = spark.createDataFrame(f, "session int, arrival int, seq long, tx_seq long, at double, bytes long, latency double, accepted boolean")
    st = spark.createDataFrame([(1, "cv", 2.0), (1, "cv", 4.0)], "session int, stage string, ms double")
    got = {r.session: (r.frames, r.rejected, r.seq_gaps, r.tx_gaps, round(r.fps, 3)) for r in me.session_metrics(df, st).collect()}
    assert got == {1: (3, 1, 58, 0, 1.0), 2: (1, 0, 0, None, 1e9), 3: (2, 0, 0, 7, 2.0)}  # frames over the time from the first row to the last


def test_typed_metrics(spark):
    kinds = spark.createDataFrame([("r", "rate"), ("c", "count"), ("k", "constant"), ("v", "constant"), ("u", "unaggregated")], "metric string, kind string")
    df = spark.createDataFrame([(1, m, x) for m, xs in {"r": (1.0, 2.0), "c": (1.0, 2.0), "k": (5.0, 5.0), "v": (5.0, 6.0), "u": (1.0, 9.0)}.items() for x in xs], "run int, metric string, value double")
    assert rows(me.typed_metrics(df, kinds), "metric", "value", "varied", "frames") == [("c", 3.0, False, 2), ("k", 5.0, False, 2), ("r", 1.5, False, 2), ("u", None, False, 2), ("v", None, True, 2)]
    with pytest.raises(Exception, match="undeclared metric x"):
        me.typed_metrics(spark.createDataFrame([(1, "x", 1.0)], "run int, metric string, value double"), kinds).collect()


def test_two_percentiles_by_rank(spark):
    for n, low, high in ((1, 1, 1), (20, 19, 20), (21, 19, 20), (2, 1, 2)):
        c = spark.createDataFrame([("g", float(i), 1) for i in range(1, n + 1)], "g string, v double, n long")
        assert (me.percentile_by_rank(c, "g", "v", True).first().value, me.percentile_by_rank(c, "g", "v", False).first().value) == (low, high)


def test_digest_reads_every_id(spark):
    d = lambda ids: spark.createDataFrame([(i,) for i in ids], "i long").agg(me.ordered_digest(F.col("i"))).first()[0]
    assert d([1, 2, 9]) == d([9, 1, 2]) != d([1, 3, 9])


def test_auc_deciles_growth(spark):
    a = spark.createDataFrame([(True, 2.0), (True, 1.0), (False, 1.0), (False, 0.0), (True, NAN)], "positive boolean, score double")
    assert me.auc_rank(a).first().auc == 0.875 and me.auc_rank(a.where("positive")).first().auc is None
    d = spark.createDataFrame([(i, float(i)) for i in range(25)], "pos int, value double")
    assert rows(me.decile_means(d), "decile", "n") == sorted([(k, 2) for k in range(1, 10)] + [(10, 7)], key=str) and me.decile_means(d.limit(9)).count() == 0
    g = spark.createDataFrame([("a", i, float(i), False) for i in range(9)] + [("b", 0, 1.0, False)] + [("c", i, 1.0, i == 1) for i in range(3)] + [("d", i, 1.0, False) for i in range(3)], "measure string, pos int, value double, defect boolean")
    assert rows(me.growth_verdict(g, 0.5), "measure", "growth", "verdict") == [("a", 6.0, "GROWS"), ("b", None, "REFUSED"), ("c", 0.0, "DEFECT"), ("d", 0.0, "STEADY")]


def test_power_fit_and_path_length(spark):
    p = spark.createDataFrame([("a", float(x), 3.0 * x**2) for x in (1, 2, 4)] + [("a", 0.0, 1.0), ("a", None, 1.0), ("b", 1.0, 1.0), ("b", 2.0, 2.0)], "g string, x double, y double")
    got = {r.g: (r.n, r.dropped, r.a and round(r.a, 9), r.b and round(r.b, 9)) for r in me.power_fit(p).collect()}
    assert got == {"a": (3, 2, 3.0, 2.0), "b": (2, 0, None, None)}
    w = [("ok", i, "solved", float(i), 0.0, 0.0) for i in range(3)] + [("two", i, "solved", 0.0, 0.0, 0.0) for i in range(2)] + [("ref", 0, "refused", 0.0, 0.0, 0.0), ("one", 0, "solved", 1.0, 1.0, 1.0), ("gap", 0, "solved", None, 0.0, 0.0)]
    d = spark.createDataFrame(w, "world string, seq int, status string, x double, y double, z double")
    m = spark.createDataFrame([("ok", 0, 1, True), ("two", 0, 2, True), ("ref", 1, 1, True), ("one", 0, 1, True), ("gap", 0, 1, True)], "world string, refused int, segments int, scale_known boolean")
    assert rows(me.path_length(d, m), "world", "length", "reason") == [("gap", None, "a pose without a place"), ("ok", 2.0, None), ("one", 0.0, None), ("ref", None, "refused poses"), ("two", None, "several segments")]


def test_robust_fit_gains_and_rotations(spark):
    pts = [("g", i, float(i), 2.0 * i + 1 + (500.0 if i == 8 else 0.0)) for i in range(40)] + [("h", 0, 1.0, 1.0)]
    got = {r.g: r for r in me.robust_affine_fit(spark.createDataFrame(pts, "g string, pos int, x double, y double")).collect()}
    assert abs(got["g"].slope - 2) < 1e-3 and abs(got["g"].offset - 1) < 0.05 and got["g"].held_out < 1e-3 and got["h"].slope is None
    turn = lambda a: [math.cos(a), -math.sin(a), 0.0, math.sin(a), math.cos(a), 0.0, 0.0, 0.0, 1.0]
    m = me.rotation_mean(spark.createDataFrame([(1, turn(0.1)), (1, turn(0.3))], "g int, r array<double>")).first().r
    assert all(abs(x - y) < 1e-9 for x, y in zip(m, turn(0.2)))


# ---- ordering


def test_streaks(spark):
    def run(flags):
        df = spark.createDataFrame([(1, i, f) for i, f in enumerate(flags)], "track int, frame int, hit boolean")
        return {r.frame: (r.life, r.misses, r.confirmed, r.counted) for r in od.streak_confirm(df).collect()}

    h, m = [True], [False]
    got = run(h * 3 + m * 13 + h)
    assert got[2] == (1, 0, True, True) and got[8] == (1, 6, True, True) and got[9] == (1, 7, True, False) and got[14] == (1, 12, True, False) and 15 not in got and got[16] == (2, 0, False, False)
    assert not any(x[2] for x in run((h * 2 + m) * 4).values())  # never three in a row
    assert run(m * 3) == {}


def test_renumber_gaps_and_strides(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate([5, 6, 9, 2, 3, 3, 1])], "key int, pos int, seq long")
    assert [r.seq for r in od.seq_renumber(df).orderBy("pos").collect()] == [5, 6, 9, 10, 11, 12, 13]
    df = spark.createDataFrame([(1, i) for i in (0, 1, 4)] + [(2, 2)], "key int, id long")
    assert rows(od.dense_gap_check(df), "key", "lost", "first_lost", "widest") == [(1, 2, 2, 2), (2, 2, 0, 2)]
    df = spark.createDataFrame([("a", i) for i in range(90)] + [("b", i) for i in range(10)] + [("c", 0)], "segment string, pos int")
    got = rows(od.stride_subsample(df, 10), "segment", "pos")
    assert [p for s, p in got if s == "b"] == [0] and [p for s, p in got if s == "c"] == [0] and len([1 for s, _ in got if s == "a"]) == 9


def test_resume_at_exactly_the_grace(spark):
    df = spark.createDataFrame([(1, "a", 0.0, 10.0, "disconnect"), (1, "b", 100.0, 110.0, "disconnect"), (1, "c", 201.0, 210.0, "stopped"), (1, "d", 211.0, None, None)], "owner int, id string, started double, ended double, reason string")
    assert rows(od.resume_grace(df), "id", "continues") == [("a", None), ("b", "a"), ("c", None), ("d", None)]


def test_full_windows_lags_and_ties(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(6)], "key int, seq int, value double")
    assert rows(od.local_std(df), "seq") == [(4,), (5,)]
    df = spark.createDataFrame([(1, i, v, True) for i, v in enumerate([0.1, 0.632, 0.9])] + [(2, 0, 0.1, True)], "key int, seq int, value double, after boolean")
    assert rows(od.step_lag(df), "key", "lag") == [(1, 2.0), (2, INF)]  # counted from 1
    df = spark.createDataFrame([("s", 2, 1.0, 0.0), ("s", 1, 0.5, 0.1), ("s", 3, 0.1, 0.5)], "segment string, id int, sharpness double, squareness double")
    assert rows(od.best_n_per_segment(df), "id", "place") == [(1, 1), (2, 2)]  # all three score 0.05
    df = spark.createDataFrame([(1, "a", 1, 0.0), (1, "a", 2, None), (1, "a", 3, 3.0), (1, "a", 4, 6.0001)], "capture int, label string, seq int, at double")
    assert rows(od.batch_sightings(df, 3.0, 1), "run", "frames") == [(1, 3), (2, 1)]


# ---- linking


def test_lineages(spark):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "b"), ("x", "y"), ("y", "x"), ("z", "gone"), ("s", "s")], "id string, continues string")
    assert rows(li.capture_lineage(df), "id", "head", "pos", "cyclic") == [("a", "a", 0, False), ("b", "a", 1, False), ("c", "a", 2, False), ("d", "d", 0, False), ("s", "s", 0, False), ("x", "x", None, True), ("y", "x", None, True), ("z", "z", 0, False)]


def test_runs_are_refused_or_void(spark):
    run = lambda *r: spark.createDataFrame(list(r), "prefix string, segments int, keyframes int, solved int, points int")
    a = run(("p", 1, 2, 3, 4), ("q", 1, 2, 3, 4))
    assert rows(li.ab_compare(a, run(("p", 1, 2, 5, 4), ("q", 1, 2, 3, 9))), "prefix", "solved", "points", "verdict") == [("p", 2, 0, "ok"), ("q", 0, 5, "ok")]
    assert {r.verdict for r in li.ab_compare(a, run(("p", 1, 2, 5, 4), ("q", 2, 2, 3, 9))).collect()} == {"VOID"}
    assert {r.verdict for r in li.ab_compare(a, run(("p", 1, 2, 5, 4))).collect()} == {"refused"}


def test_placements(spark):
    seg = spark.createDataFrame([(1, i) for i in range(5)], "world int, segment int")
    p = spark.createDataFrame([(1, 0, "registered", 0, "now", 1.0), (1, 1, "registered", 0, "now", 2.0), (1, 2, "registered", 0, "old", 3.0), (1, 3, "registered", 2, "now", 4.0), (1, 4, "refused", 0, "now", 5.0)], "world int, segment int, state string, reference int, digest string, x double")
    got = li.placement_join(seg, p, spark.createDataFrame([(1, "now")], "world int, digest string"))
    assert rows(got, "segment", "x", "placed") == [(0, 1.0, True), (1, 2.0, True), (2, None, False), (3, None, False), (4, None, False)]
    assert not any(r.placed for r in li.placement_join(seg, p, spark.createDataFrame([(1, None)], "world int, digest string")).collect())


def test_pair_admission_in_order(spark):
    base = dict(scale_f=2.0, scale_r=0.5, cameras_f=3, cameras_r=3, span_f=0.05, span_r=1.0, ambiguity_f=1.5, ambiguity_r=1.0, reprojection_f=4.0, reprojection_r=1.0, rotation=10.0)
    cases = [({}, None), ({"scale_f": 0.0}, "collapsed"), ({"scale_r": NAN, "cameras_f": 1}, "collapsed"), ({"cameras_r": 2, "span_f": 0.0}, "cameras"), ({"span_r": 0.049}, "stood still"), ({"scale_r": 0.58}, "reciprocity"), ({"rotation": 10.1}, "rotation"), ({"ambiguity_r": 1.6}, "ambiguous"), ({"reprojection_r": 4.1}, "reprojection")]
    df = spark.createDataFrame([(i, *{**base, **c}.values()) for i, (c, _) in enumerate(cases)], "i int, " + ", ".join(f"{k} {'int' if isinstance(v, int) else 'double'}" for k, v in base.items()))
    assert [r.reason for r in li.pair_admission(df).orderBy("i").collect()] == [r for _, r in cases]


def test_meshes(spark):
    v = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0), (3, 1.0, 1.0, 0.0), (4, 0.001, 0.0, 0.0)], "id int, x double, y double, z double")
    f = spark.createDataFrame([(0, 0, 1, 2), (1, 1, 3, 2), (2, 4, 2, 1), (3, 0, 4, 1)], "id int, a int, b int, c int")
    weld, faces = li.weld_mesh(v, f, 0.01)
    assert rows(weld, "id", "welded") == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 0)] and rows(faces, "id", "a", "b", "c") == [(0, 0, 1, 2), (1, 1, 3, 2)]
    assert rows(li.boundary_curve(faces), "vertex", "kind") == [(i, "curve") for i in range(4)]
    tetra = [(10, 5, 6, 7), (11, 5, 6, 8), (12, 6, 7, 8), (13, 5, 7, 8)]
    both = spark.createDataFrame([(0, 0, 1, 2), (1, 1, 3, 2)] + tetra, "id int, a int, b int, c int")
    places = spark.createDataFrame([(i, float(i), float(i % 2), float(i % 3), i in (0, 5, 6)) for i in range(9)], "id int, x double, y double, z double, filled boolean")
    assert rows(li.sealed_patches(places, both, 0.01), "id") == [(1,), (10,), (11,), (12,), (13,)]  # the open patch goes, the closed one stays
    kept = li.drop_small_components(both, 0.8)
    assert rows(kept, "id", "a", "b", "c") == [(10, 0, 1, 2), (11, 0, 1, 3), (12, 1, 2, 3), (13, 0, 2, 3)]


def test_cluster_is_refused_by_one_bad_edge(spark):
    comp = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 4), (5, 4)], "node int, component int")
    res = spark.createDataFrame([(1, 2, 20.0, 2.0), (4, 5, 0.0, 2.01)], "src int, dst int, degrees double, scale_ratio double")
    assert rows(li.refused_clusters(res, comp), "component", "refused") == [(1, False), (3, False), (4, True)]


# ---- shaping and keeping


def test_keys_raise_outside_their_range(spark):
    df = spark.createDataFrame([(-(1 << 20), 0, (1 << 20) - 1)], "x long, y long, z long")
    k = df.select(sh.block_key(F.col("x"), F.col("y"), F.col("z")).alias("k"))
    assert tuple(k.select(*sh.block_coords(F.col("k"))).first()) == (-(1 << 20), 0, (1 << 20) - 1)
    with pytest.raises(Exception, match="outside the range"):
        df.select(sh.block_key(F.col("x"), F.col("y"), F.col("z") + 1)).collect()
    t = sh.occupied_tiles(spark.createDataFrame([(4, 0, 1), (5, 1, 1)], "x long, y long, z long"), 4)
    assert rows(t, "i", "j", "k") == [(0, 0, 0), (1, 0, 0)]


def test_quaternions_there_and_back(spark):
    q = [(1.0, 0.0, 0.0, 0.0), (0.0, 1.0, 0.0, 0.0), (0.5, -0.5, 0.5, 0.5), (-0.1, 0.9, 0.3, 0.2), (0.0, 0.0, 0.0, 0.0)]
    got = sh.quaternion_matrix(spark.createDataFrame([(i, *x) for i, x in enumerate(q)], "i int, w double, x double, y double, z double")).orderBy("i").collect()
    for r, x in zip(got[:4], q):
        n = math.sqrt(sum(c * c for c in x)) * (-1 if x[0] < 0 else 1)
        assert all(abs(a - b / n) < 1e-12 for a, b in zip((r.qw, r.qx, r.qy, r.qz), x))
    assert got[4].m00 is None


def test_payloads_text_and_sizes(spark):
    df = spark.createDataFrame([((1, ("x", 2)),)], "p struct<a: int, b: struct<c: string, d: int>>")
    assert sh.without(df, "p", ["b.c", "nope", "a.b.c"]).first().p.asDict(True) == {"a": 1, "b": {"d": 2}}
    t = spark.createDataFrame([("one. two",), ("no stop.",), ("abc  def",), (None,)], "t string")
    assert [tuple(r) for r in t.select(sh.clip_text(F.col("t"), 6), sh.first_sentence(F.col("t"))).collect()] == [("one.…", "one."), ("no st…", "no stop."), ("abc…", "abc  def"), (None, None)]
    s = spark.createDataFrame([(640, 360, 500.0, 500.0, 320.0, 180.0, 1280, 720, True), (640, 360, None, 500.0, 320.0, 180.0, 1, 1, False)], "w int, h int, fx double, fy double, cx double, cy double, to_w int, to_h int, allowed boolean")
    assert [r.fx2 for r in sh.intrinsics_scale(s).collect()] == [1000.0, None]
    with pytest.raises(Exception, match="another size"):
        sh.intrinsics_scale(s.withColumn("allowed", F.lit(False)).limit(1)).collect()


def test_blobs_and_purges(spark):
    j = bytes.fromhex("ffd8ff00")
    w = spark.createDataFrame([("abcdef01", 1, j), ("abcdef01", 2, j), ("short", 3, j), ("abcdef02", 4, b"xxx"), ("abcdef03", 5, j * 9), (None, 6, j), ("abcdef04", 7, None)], "id string, seq int, image binary")
    kept, why = ke.owned_keyframe_store(w, 20)
    assert rows(kept, "id") == [("abcdef01",)] and rows(why, "reason", "n") == [("already-there", 1), ("bad-id", 2), ("no-image", 1), ("not-an-image", 1), ("too-large", 1)]
    o = spark.createDataFrame([("a", 10.0), ("b", 9.9), ("c", None), ("d", NAN)], "id string, recorded_at double")
    b = spark.createDataFrame([("a", 1), ("b", 2), ("stray", 4)], "id string, length long")
    left, blobs, report = ke.prune_purge(o, b, 10.0)
    assert rows(left, "id") == [("a",)] and rows(blobs, "id") == [("a",)] and tuple(report.first()) == (3, 1, 2, 6, True)
    assert tuple(ke.prune_purge(o, b, None)[2].first())[:2] == (0, 4)


def test_kernels(spark):
    frames = spark.createDataFrame([(1, [1.0, 3.0]), (2, None), (3, [])], "frame_id long, pixels array<double>")
    got = {r.frame_id: (r.value, r.label, r.metrics) for r in REGISTRY.run("brightness", frames).collect()}
    assert got == {1: (2.0, "bright", {"contrast": 2.0, "brightness": 2.0}), 2: (None, "unknown", {}), 3: (None, "unknown", {})}
    r = Registry()
    r.register(Kernel("fixed", lambda: FixedRows({1: (0.9, "cup")})))
    r.register(Kernel("gone", lambda: None, available=lambda: "no weights"))
    assert [x.label for x in r.run("fixed", frames).orderBy("frame_id").collect()] == ["cup", "unknown", "unknown"]
    with pytest.raises(RuntimeError, match="no weights"):
        r.run("gone", frames)
    with pytest.raises(KeyError):
        r.find("nothing")
    with pytest.raises(ValueError):
        r.register(Kernel("bad", lambda: None, {"m": "median"}))
    found = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "frame_id long, pos int, label string")
    assert {x.frame_id: [y.label for y in x.found] for x in attach_rows(frames, found).collect()} == {1: ["a", "b"], 2: [], 3: []}
