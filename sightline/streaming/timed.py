"""Keyed folds with timers, alike over a table and over a stream with a watermark.

A fold has `state` and `out` (DDL), step(state, row) -> (state, rows out) for a row with its time `at` in
seconds, due(state) -> the time at which something happens without a row (or None), and
expire(state, at) -> (state, rows out) for that moment. State is a dict, or None: then the key is forgotten.
What is due strictly before a row's time happens before the row, so a row at exactly that time comes first.

Over a stream (transformWithState) a key's rows wait in a list state until the watermark passes them, so rows
that come out of order within its delay are folded in order of time; rows later than that are dropped by
Spark. Timers of event time fire as the watermark moves on, whichever key moved it: silent keys come to
their end too, and then leave no state. Over a table everything up to `until` is folded, by default the
newest time in it; a stream whose watermark is at `until` has said exactly the same.
"""
from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType


class Fold:
    """Base of folds; `at` of a row is never null."""

    state = out = ""

    def step(self, state: dict | None, row: dict) -> tuple[dict | None, list[dict]]:
        raise NotImplementedError

    def due(self, state: dict) -> float | None:
        return None

    def expire(self, state: dict, at: float) -> tuple[dict | None, list[dict]]:
        return None, []


def _timers(fold: Fold, state: dict | None, before: float) -> tuple[dict | None, list[dict]]:
    """Everything that is due strictly before a moment."""
    out: list[dict] = []
    while state is not None and (due := fold.due(state)) is not None and due < before:
        state, made = fold.expire(state, due)
        out += made
    return state, out


def advance(fold: Fold, state: dict | None, rows: Iterable[dict], until: float | None) -> tuple[dict | None, list[dict]]:
    """The state after rows in order of time, and after what is due before `until` (None: nothing more)."""
    out: list[dict] = []
    for row in rows:
        state, made = _timers(fold, state, row["at"])
        out += made
        state, made = fold.step(state, row)
        out += made
    if until is not None:
        state, made = _timers(fold, state, until)
        out += made
    return state, out


def _schema(df: DataFrame, key: str, fold: Fold) -> StructType:
    return StructType([df.schema[key], *StructType.fromDDL(fold.out)])


def fold_table(df: DataFrame, key: str, order: list[str], fold: Fold, until: float | None = None) -> DataFrame:
    """df (key, at and what the fold reads) -> the key and the fold's rows. Rows without a time, or after `until`, are left out; rows of a null key are one key.

    A key's rows pass through in batches, so it takes one state in memory. `until` of the newest time is found by a scan.
    """
    df = df.where("at IS NOT NULL")
    if until is None:
        until = df.agg(F.max("at")).first()[0]
        if until is None:
            until = 0.0
    schema = _schema(df, key, fold)
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        now, state = none, None
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                if row[key] != now or now is none:
                    out += [{key: now, **o} for o in advance(fold, state, [], until)[1]] if now is not none else []
                    now, state = row[key], None
                state, made = advance(fold, state, [row], None)
                out += [{key: now, **o} for o in made]
            yield pa.RecordBatch.from_pylist(out, arrow)
        if now is not none:
            yield pa.RecordBatch.from_pylist([{key: now, **o} for o in advance(fold, state, [], until)[1]], arrow)

    return df.where(F.col("at") <= until).repartition(key).sortWithinPartitions(key, "at", *order).mapInArrow(run, schema)


class _Keyed(StatefulProcessor):
    """A fold as a processor: `waiting` rows, `held` state, one timer for whatever comes first."""

    def __init__(self, fold: Fold, key: str, columns: list[str], rows: str, order: list[str]):
        self.fold, self.key, self.columns, self.ddl, self.order = fold, key, columns, rows, order
        self.names = StructType.fromDDL(fold.state).names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting, self.held = handle.getListState("waiting", self.ddl), handle.getValueState("held", self.fold.state)

    def _state(self) -> dict | None:
        return dict(zip(self.names, self.held.get())) if self.held.exists() else None

    def _wake(self, rows: list[tuple], state: dict | None) -> None:
        """The next moment at which a row is ripe or something is due; timers count milliseconds."""
        at = self.columns.index("at")
        moments = [math.ceil(min(r[at] for r in rows) * 1000)] if rows else []
        due = None if state is None else self.fold.due(state)
        if due is not None:
            moments.append(math.floor(due * 1000) + 1)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if moments:
            self.handle.registerTimer(min(moments))

    def handleInputRows(self, key, rows, timerValues):
        new = [tuple(r[c] for c in self.columns) for r in rows if r["at"] is not None]
        if new:
            old = list(self.waiting.get()) if self.waiting.exists() else []
            self.waiting.appendList(new)
            self._wake([tuple(r) for r in old] + new, self._state())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        until = timerValues.getCurrentWatermarkInMs() / 1000
        rows = [dict(zip(self.columns, r)) for r in self.waiting.get()] if self.waiting.exists() else []
        ripe = sorted((r for r in rows if r["at"] <= until), key=lambda r: [r["at"], *((r[c] is not None, r[c]) for c in self.order)])
        state, out = advance(self.fold, self._state(), ripe, until)
        rest = [tuple(r[c] for c in self.columns) for r in rows if r["at"] > until]
        self.waiting.put(rest) if rest else self.waiting.clear()
        self.held.clear() if state is None else self.held.update(tuple(state[n] for n in self.names))
        self._wake(rest, state)
        return iter([Row(**{self.key: key[0], **o}) for o in out])

    def close(self) -> None:
        pass


def fold_stream(df: DataFrame, key: str, order: list[str], fold: Fold, late: str = "10 seconds") -> DataFrame:
    """The same over a stream, with a watermark `late` behind the newest `at`. The session's state store must be RocksDB, which transformWithState asks for."""
    if "RocksDB" not in df.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass"):
        raise ValueError("set spark.sql.streaming.stateStore.providerClass to RocksDBStateStoreProvider")
    rows = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != key)
    columns = [c for c in df.columns if c != key]
    moment = df.withColumn("_moment", F.timestamp_micros(F.floor(F.col("at") * 1000000).cast("long"))).withWatermark("_moment", late)
    return moment.groupBy(key).transformWithState(_Keyed(fold, key, columns, rows, order), _schema(df, key, fold), "append", "eventTime")


# ---- folds


class Sightings(Fold):
    """Row: score. A sighting goes on while pauses are at most `gap`; it is told `record` at the frame that makes it mature, `update` when the score is
    better or `every` seconds after the last word, and `close` once it was silent for longer than gap. Immature ones say nothing."""

    state = "first double, last double, frames long, best double, said double"
    out = "kind string, at double, first_at double, last_at double, frames long, best double"

    def __init__(self, gap: float = 3.0, mature: int = 3, every: float = 10.0):
        self.gap, self.mature, self.every = gap, mature, every

    def _say(self, s, kind, at):
        return {"kind": kind, "at": at, "first_at": s["first"], "last_at": s["last"], "frames": s["frames"], "best": s["best"]}

    def step(self, s, row):
        at, score = row["at"], row["score"]
        if s is None:
            s = {"first": at, "last": at, "frames": 0, "best": None, "said": None}
        better = score is not None and (s["best"] is None or score > s["best"])
        s = s | {"last": at, "frames": s["frames"] + 1, "best": score if better else s["best"]}
        if s["frames"] == self.mature:
            kind = "record"
        elif s["frames"] > self.mature and (better or at - s["said"] >= self.every):
            kind = "update"
        else:
            return s, []
        s["said"] = at
        return s, [self._say(s, kind, at)]

    def due(self, s):
        return s["last"] + self.gap

    def expire(self, s, at):
        return None, [self._say(s, "close", at)] if s["frames"] >= self.mature else []


class Feed(Fold):
    """Row: body. `change` at a body unlike the last one said, a `heartbeat` every `beat` seconds without one, `gone` after `patience` without a row."""

    state = "body string, said double, seen double, revision long"
    out = "kind string, at double, revision long"

    def __init__(self, beat: float = 2.0, patience: float = 30.0):
        self.beat, self.patience = beat, patience

    def step(self, s, row):
        at, body = row["at"], row["body"]
        if s is not None and body == s["body"]:
            return s | {"seen": at}, []
        s = {"body": body, "said": at, "seen": at, "revision": 1 if s is None else s["revision"] + 1}
        return s, [{"kind": "change", "at": at, "revision": s["revision"]}]

    def due(self, s):
        return min(s["said"] + self.beat, s["seen"] + self.patience)

    def expire(self, s, at):
        if at >= s["seen"] + self.patience:
            return None, [{"kind": "gone", "at": at, "revision": s["revision"]}]
        return s | {"said": at}, [{"kind": "heartbeat", "at": at, "revision": s["revision"]}]


class Carry(Fold):
    """Row: steady, region (null: none). The detector runs on steady rows `cadence` after its last run at the earliest; its answer, none too, is carried for
    `carry` seconds. Out: a row a steady frame with ran and region, and one `expired` when a region's time is over; unsteady rows say nothing."""

    state = "ran double, region string"
    out = "at double, ran boolean, region string, expired boolean"

    def __init__(self, cadence: float = 0.25, carry: float = 1.5):
        self.cadence, self.carry = cadence, carry

    def step(self, s, row):
        at = row["at"]
        if not row["steady"]:
            return s, []
        run = s is None or at - s["ran"] >= self.cadence
        if run:
            s = {"ran": at, "region": row["region"]}
        return s, [{"at": at, "ran": run, "region": s["region"], "expired": False}]

    def due(self, s):
        return s["ran"] + max(self.carry, self.cadence)

    def expire(self, s, at):
        return None, [{"at": at, "ran": False, "region": None, "expired": True}] if s["region"] is not None else []


class Walks(Fold):
    """Row: kind (start, end or disconnect). A start within `grace` of a disconnect continues the walk; out: walk, event and time; a walk is `over` at its end,
    or `grace` after a disconnect."""

    state = "walk long, left double, live boolean"
    out = "at double, walk long, event string"

    def __init__(self, grace: float = 90.0, forget: float = 86400.0):
        self.grace, self.forget = grace, forget

    def step(self, s, row):
        at, kind = row["at"], row["kind"]
        s = s or {"walk": -1, "left": at, "live": False}
        if kind == "start":
            new = not s["live"]
            over = [{"at": at, "walk": s["walk"], "event": "over"}] if s["live"] and s["left"] is None else []
            if new or over:
                return {"walk": s["walk"] + 1, "left": None, "live": True}, [*over, {"at": at, "walk": s["walk"] + 1, "event": "begun"}]
            return s | {"left": None}, [{"at": at, "walk": s["walk"], "event": "resumed"}]
        if kind == "disconnect":
            return s | {"left": at}, []
        return s | {"left": at, "live": False}, [{"at": at, "walk": s["walk"], "event": "over"}] if s["live"] else []

    def due(self, s):
        return None if s["left"] is None else s["left"] + (self.grace if s["live"] else self.forget)

    def expire(self, s, at):
        if s["live"]:
            return s | {"live": False}, [{"at": at, "walk": s["walk"], "event": "over"}]
        return None, []


class Verdicts(Fold):
    """Key: a sighting. Row: kind (closed or verdict), verdict. A closed sighting waits `patience` for its verdict, then it is `unverified`; a verdict that
    came before waits as long for its sighting, the newest counting, and is then forgotten. Out: at, verdict."""

    state = "parked double, early string, came double"
    out = "at double, verdict string"

    def __init__(self, patience: float = 30.0):
        self.patience = patience

    def step(self, s, row):
        at = row["at"]
        if row["kind"] == "verdict":
            if s is not None and s["parked"] is not None:
                return None, [{"at": at, "verdict": row["verdict"]}]
            return {"parked": None, "early": row["verdict"], "came": at}, []
        if s is not None and s["came"] is not None:
            return None, [{"at": at, "verdict": s["early"]}]
        return s or {"parked": at, "early": None, "came": None}, []

    def due(self, s):
        return (s["came"] if s["parked"] is None else s["parked"]) + self.patience

    def expire(self, s, at):
        return None, [{"at": at, "verdict": "unverified"}] if s["parked"] is not None else []
