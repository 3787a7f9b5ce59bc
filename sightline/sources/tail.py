"""Journals that still grow: a stream by byte offset inside files, and following a capture into its successors.

The stream's offset is the end of the last whole line of each file. A line without its end waits for a later batch; a
file that became shorter is read again from its start. Only sizes and the last piece of a file are looked at on the
driver; ranges are read by tasks, a long backlog of one file by several: each reads the lines that begin in its span. Paths go through Arrow's file systems (file, hdfs, s3 and others by their URI).
"""
from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .journal import jsonl_rows

PIECE = 1 << 16


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(root: str, name: str) -> list[tuple[str, int]]:
    """(path, size) of journals under a folder, in order of path."""
    from pyarrow import fs

    system, at = _open(root)
    if system.get_file_info(at).type == fs.FileType.NotFound:
        return []
    found = system.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted((f.path, f.size) for f in found if f.is_file and f.base_name == name)


def _last_line_end(root: str, path: str, size: int, least: int) -> int:
    """Behind the last line end before `size`, at least `least`."""
    system, _ = _open(root)
    with system.open_input_file(path) as f:
        while size > least:
            start = max(least, size - PIECE)
            found = f.read_at(size - start, start).rfind(b"\n")
            if found >= 0:
                return start + found + 1
            size = start
    return least


class Span(InputPartition):
    """Lines of a file that begin from start to end; the file's whole lines reach to stop. A span that isn't the first begins within a line, or at one."""

    def __init__(self, path: str, start: int, end: int, stop: int, first: bool):
        self.path, self.start, self.end, self.stop, self.first = path, start, end, stop, first


def spans(path: str, start: int, stop: int, size: int) -> list[Span]:
    return [Span(path, at, min(at + size, stop), stop, at == start) for at in range(start, stop, size)]


def lines_of(f, span: Span, step: int = 1 << 20):
    """(offset, line) of a span's lines."""
    at = base = span.start if span.first else span.start - 1  # a line end just before belongs to the line before
    rest, skip = b"", not span.first
    while at < span.stop and base < span.end:
        piece = f.read_at(min(step, span.stop - at), at)
        if not piece:
            return
        at += len(piece)
        *lines, rest = (rest + piece).split(b"\n")
        for line in lines:
            if not skip and base < span.end:
                yield base, line
            skip = False
            base += len(line) + 1


class JournalReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.name = options["path"], options.get("name", "frames.jsonl")
        self.at_end = str(options.get("startAtEnd", "false")).lower() == "true"
        self.size = int(options.get("spanBytes", 64 << 20))
        self.before: dict = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {p: s for p, s in _files(self.root, self.name)} if self.at_end else {}

    def latestOffset(self) -> dict:  # noqa: N802
        out = {}
        for path, size in _files(self.root, self.name):
            was = self.before.get(path, 0)
            out[path] = _last_line_end(self.root, path, size, 0 if size < was else was)
        self.before = out
        return out

    def partitions(self, start: dict, end: dict) -> list[Span]:
        out = []
        for path, stop in end.items():
            at = start.get(path, 0)
            out += spans(path, 0 if stop < at else at, stop, self.size)
        return out

    def read(self, span: Span):
        system, _ = _open(self.root)
        with system.open_input_file(span.path) as f:
            for offset, line in lines_of(f, span):
                yield span.path, offset, line.decode("utf-8", "replace")

    def commit(self, end: dict) -> None:
        pass


class JournalSource(DataSource):
    """Format `journal_tail`: rows (path, offset, value), a row a whole line."""

    @classmethod
    def name(cls) -> str:
        return "journal_tail"

    def schema(self) -> str:
        return "path string, offset long, value string"

    def streamReader(self, schema) -> JournalReader:  # noqa: N802
        return JournalReader(self.options)


def tail(spark: SparkSession, root: str, name: str = "frames.jsonl", start_at_end: bool = False, span_bytes: int = 64 << 20) -> DataFrame:
    """The lines of all journals of that name under a folder, as they grow; a task reads about span_bytes."""
    spark.dataSource.register(JournalSource)
    return spark.readStream.format("journal_tail").option("path", root).option("name", name).option("startAtEnd", str(start_at_end).lower()).option("spanBytes", str(span_bytes)).load()


def _manifest(root: str, capture: str) -> dict:
    system, at = _open(root)
    try:
        with system.open_input_file(f"{at}/{capture}/manifest.json") as f:
            found = json.loads(f.read())
    except (OSError, ValueError):
        return {}
    return found if isinstance(found, dict) else {}


def _successor(root: str, capture: str) -> str | None:
    """Of the captures that continue this one, the first by name."""
    names = sorted({p.rsplit("/", 2)[-2] for p, _ in _files(root, "manifest.json")})
    return next((n for n in names if n != capture and _manifest(root, n).get("continues_capture") == capture), None)


def capture_follow(spark: SparkSession, root: str, capture: str, schema, sink: Callable[[DataFrame], None], checkpoint: str, max_idle: int | None = None, grace: float = 90.0, poll: float = 0.5, clock: Callable = time.time, sleep: Callable = time.sleep, stop: Callable = lambda: False) -> list[str]:
    """Reads one capture until it ends, and the captures that continue it; returns their names.

    Each poll reads what is there now. When the manifest is closed the journal is read once more. After a disconnect a
    successor may appear for `grace` seconds from its end; any other end is final. A capture seen before ends the walk.
    sink gets the rows of each batch, those that aren't JSON objects left out.
    """
    walk, idle = [capture], 0

    def drain(name: str) -> int:
        seen = [0]

        def take(batch: DataFrame, _: int) -> None:
            rows = jsonl_rows(batch, schema).where("NOT _bad").drop("_bad").persist()
            n = rows.count()
            if n:
                seen[0] += n
                sink(rows)
            rows.unpersist()

        query = tail(spark, f"{root}/{name}").writeStream.foreachBatch(take).option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).start()
        query.awaitTermination()
        return seen[0]

    while not stop():
        now = walk[-1]
        idle = 0 if drain(now) else idle + 1
        closed = _manifest(root, now)
        if closed.get("ended_at") is not None:
            drain(now)
            following = None
            while closed.get("end_reason") == "disconnect" and not stop():
                following = _successor(root, now)
                if following or clock() - closed["ended_at"] > grace:
                    break
                sleep(poll)
            if following is None or following in walk:
                return walk
            walk.append(following)
            idle = 0
            continue
        if max_idle is not None and idle >= max_idle:
            return walk
        sleep(poll)
    return walk
