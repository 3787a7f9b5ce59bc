"""Keyed folds that run alike over a table and over a stream.

A fold is step(state, row) -> (state, rows out), with state a JSON value (None at first), and close(state) -> rows
out at the end of a key. Over a table, rows are sorted within partitions and pass through in Arrow batches, so a
key needs one state in memory, whatever its rows. Over a stream, rows of a trigger are sorted by time within
their key and the state is kept between triggers; close runs when a key was silent for the timeout, if given.
"""
from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout


def _plain(row: dict) -> dict:
    """Values that pandas holds as missing are None."""
    return {k: None if v is None or v != v else v for k, v in row.items()}


def fold_table(df: DataFrame, key: str, order: list[str], step: Callable, schema: str, close: Callable | None = None) -> DataFrame:
    """schema is of the rows out and has the key first. Rows of a null key are one key."""
    columns = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches: Iterator):
        import pandas as pd

        none = object()
        now, state = none, None
        for batch in batches:
            out = []
            for row in map(_plain, batch.to_dict("records")):
                if row[key] != now or now is none:
                    if now is not none and close:
                        out += [{key: now, **o} for o in close(state)]
                    now, state = row[key], None
                state, made = step(state, row)
                out += [{key: now, **o} for o in made]
            yield pd.DataFrame(out, columns=columns)
        if now is not none and close:
            yield pd.DataFrame([{key: now, **o} for o in close(state)], columns=columns)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def fold_stream(df: DataFrame, key: str, order: list[str], step: Callable, schema: str, close: Callable | None = None, timeout_ms: int | None = None) -> DataFrame:
    columns = [c.strip().split()[0] for c in schema.split(",")]

    def run(keys, batches, state):
        import pandas as pd

        at, out = json.loads(state.get[0]) if state.exists else None, []
        if state.hasTimedOut:
            out = close(at) if close else []
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values(order, kind="stable")
            for row in map(_plain, rows.to_dict("records")):
                at, made = step(at, row)
                out += made
            state.update((json.dumps(at),))
            if timeout_ms:
                state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame([{key: keys[0], **o} for o in out], columns=columns)

    kind = GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout
    return df.groupBy(key).applyInPandasWithState(run, schema, "state string", "append", kind)
