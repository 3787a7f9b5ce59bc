"""Small files that readers see whole or not at all, leftovers of writers that died, and tables reused while their files stay the same."""
from __future__ import annotations

import json
import os
import re
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: A writer's file until it is renamed: its process and a random part.
STAGING = re.compile(r"^(?P<name>.+)\.p(?P<pid>\d+)\.[0-9a-f]{32}\.tmp$")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def atomic_publish(spark: SparkSession, path: str, payload, patience: float = 2.0, sleep: Callable = time.sleep) -> None:
    """JSON to a path on any Hadoop file system: written beside it, then renamed over it; the rename is tried again for `patience` seconds."""
    body = bytearray(json.dumps(payload, sort_keys=True, allow_nan=False).encode())
    jvm = spark._jvm
    fs, target = _fs(spark, path)
    staged = jvm.org.apache.hadoop.fs.Path(f"{path}.p{os.getpid()}.{uuid.uuid4().hex}.tmp")
    out = fs.create(staged, True)
    out.write(body)
    out.hsync()
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()) if target.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    end = time.monotonic() + patience
    while True:
        try:
            context.rename(staged, target, options)
            return
        except Exception:
            if time.monotonic() > end:
                fs.delete(staged, False)
                raise
            sleep(0.05)


def staging_sweep(folder: str, alive: Callable[[int], bool] | None = None) -> list[str]:
    """Removes staging files on this machine whose writer is dead; files of other names and of living writers stay. Returns their names."""

    def lives(pid: int) -> bool:
        try:
            os.kill(pid, 0)
        except ProcessLookupError:
            return False
        except OSError:
            return True
        return True

    gone = []
    for name in sorted(os.listdir(folder)):
        found = STAGING.match(name)
        if found and not (alive or lives)(int(found["pid"])):
            os.unlink(os.path.join(folder, name))
            gone.append(name)
    return gone


class StatGatedCache:
    """Tables kept in memory while the listing of their files, the retention asked for and the time's bucket stay the same.

    The bucket bounds how long a row may outlive its retention.
    """

    def __init__(self, spark: SparkSession, bucket_s: float = 60.0):
        self.spark, self.bucket_s, self.held = spark, bucket_s, {}
        self.loads = 0

    def stamp(self, path: str) -> tuple:
        fs, p = _fs(self.spark, path)
        if not fs.exists(p):
            return ()
        files, out = fs.listFiles(p, True), []
        while files.hasNext():
            f = files.next()
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        return tuple(sorted(out))

    def get(self, path: str, retention: float | None, load: Callable[[SparkSession, str], DataFrame], now: float | None = None) -> DataFrame:
        key = self.stamp(path), retention, int((time.time() if now is None else now) // self.bucket_s)
        if path in self.held:
            if self.held[path][0] == key:
                return self.held[path][1]
            self.held.pop(path)[1].unpersist()
        self.loads += 1
        self.held[path] = key, load(self.spark, path).persist()
        return self.held[path][1]
