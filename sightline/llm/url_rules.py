"""URL filter rules by a sort-merge range join over reversed-host keys.

A host turned round ("www.example.com" to "com.example.www.") makes a rule's host and all its
subdomains one interval of keys: those that start with the rule's own key. Intervals of hosts are
nested or disjoint, so one sweep over sorted urls and sorted rules needs only a stack of the rules
whose interval is open. Of the open rules, the longest whose path starts the url's path decides.

Rules up to `max_shipped` rows (their count is taken first) go to every task, and each task sweeps
its own sorted urls: no exchange at all. Beyond it, urls and rules are dealt over key ranges whose
bounds come from a bounded sample of url keys; a rule goes to every range that its interval meets.
The bounds steer only balance, never results; identical urls are split by a hash of the row.

Null url or no "://": host and path are empty. Host and path empty fit no rule. Rules with a null
host or path are ignored; of rules with equal host and path one stays, block before allow.
"""
from __future__ import annotations

from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import aside

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_key(host: str) -> str:
    """Labels in reverse, each closed by a dot: the key of a host starts every subdomain's key."""
    return ".".join(reversed(host.split("."))) + "."


class Sweep:
    """Takes keys in ascending order; keeps the stack of rules whose key interval is open."""

    def __init__(self):
        self.stack: list[tuple[str, list[str], list[tuple]]] = []

    def close(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def open(self, key: str, rules: list[tuple]) -> None:
        """rules: (path, host, verdict) of one host."""
        self.close(key)
        rules = sorted(rules)
        self.stack.append((key, [r[0] for r in rules], rules))

    def judge(self, key: str, path: str) -> tuple | None:
        self.close(key)
        best = None
        for _, paths, rules in self.stack:  # as many entries as the host has labels
            hi = bisect_right(paths, path)
            while hi:
                found = paths[hi - 1]
                if path.startswith(found):
                    rule = rules[hi - 1]
                    size = (len(rule[1]) + len(rule[0]), len(rule[1]))
                    if best is None or size > best[0]:
                        best = (size, rule)
                    break
                # any rule that starts the path also starts what the two share
                same = next((i for i, (a, b) in enumerate(zip(found, path)) if a != b), min(len(found), len(path)))
                hi = bisect_right(paths, path[:same], 0, hi - 1)
        return best and best[1]


def _by_key(rules) -> list[tuple[str, list[tuple]]]:
    by: dict[str, dict] = {}
    for host, path, verdict in rules:
        own = by.setdefault(host_key(host), {})
        if own.get(path, (0, 0, ""))[2] != "block":
            own[path] = (path, host, verdict)
    return sorted((k, list(v.values())) for k, v in by.items())


def _answers(schema: pa.Schema, batch: pa.RecordBatch, found: list) -> pa.RecordBatch:
    rule = pa.array([r and r[1] + r[0] for r in found], pa.string())
    verdict = pa.array([r and r[2] for r in found], pa.string())
    keep = [batch.column(batch.schema.get_field_index(n)) for n in schema.names[:-2]]
    return pa.RecordBatch.from_arrays([*keep, rule, verdict], schema=pa.schema([*(pa.field(n, c.type) for n, c in zip(schema.names, keep)), ("_rule", pa.string()), ("_verdict", pa.string())]))


def _sweep_shipped(rules: list[tuple[str, list[tuple]]], names: list[str]):
    starts = [k for k, _ in rules]

    def run(batches):
        schema = None
        sweep, at, last = Sweep(), 0, None
        for batch in batches:
            schema = schema or pa.schema([*((n, pa.null()) for n in names), ("_rule", pa.string()), ("_verdict", pa.string())])
            hosts = batch.column(batch.schema.get_field_index("_host")).to_pylist()
            paths = batch.column(batch.schema.get_field_index("_path")).to_pylist()
            found = []
            for host, path in zip(hosts, paths):
                key = host_key(host)
                if last is None:  # the rules open where this task's keys begin
                    for k in sorted({key[: i + 1] for i, c in enumerate(key) if c == "."}):
                        i = bisect_left(starts, k)
                        if i < len(starts) and starts[i] == k:
                            sweep.open(k, rules[i][1])
                    at = bisect_right(starts, key)
                last = key
                while at < len(starts) and starts[at] <= key:
                    sweep.open(*rules[at])
                    at += 1
                found.append(sweep.judge(key, path) if host else None)
            yield _answers(schema, batch, found)

    return run


def judge_urls(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", max_shipped: int = 50_000, sample_keys: int = 20_000) -> DataFrame:
    """df with host, path, rule, verdict; columns of df that have those names are replaced, others may have any name. An empty table gives an empty table.

    rules: host, path, verdict. Urls under no rule get `default`.
    """
    host, path = host_and_path(F.col(f"`{url}`"))
    own, back = aside(df, "host", "path", "rule", "verdict")
    df = df.select(*own, host.alias("_host"), path.alias("_path"))
    names = df.columns
    out = df.schema.add("_rule", "string").add("_verdict", "string")
    rules = rules.select("host", "path", "verdict").dropna(subset=["host", "path"]).distinct()
    turned = F.concat(F.array_join(F.reverse(F.split("_host", r"\.")), "."), F.lit("."))
    shipped = rules.limit(max_shipped + 1).collect()
    if len(shipped) <= max_shipped:
        found = df.sortWithinPartitions(turned, "_path").mapInArrow(_sweep_shipped(_by_key(tuple(r) for r in shipped), names), out)
    else:
        found = _dealt(df, rules, names, out, turned, sample_keys)
    return found.select(*back, F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.coalesce("_verdict", F.lit(default)).alias("verdict"))


def _dealt(df, rules, names, out, turned, sample_keys):
    """Both sides dealt over ranges of keys, rules to all ranges that they meet, and one sweep each."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tie = F.hex(F.xxhash64("_host", "_path", F.monotonically_increasing_id()))
    keyed = df.withColumn("_key", turned)
    total = max(1, keyed.count())
    sample = [r[0] for r in keyed.where(F.rand(7) < min(1.0, sample_keys / total)).select(F.concat("_key", F.lit("\0"), "_path", F.lit("\0"), tie)).limit(2 * sample_keys).collect()]
    sample.sort()
    bounds = sorted({sample[i * len(sample) // n] for i in range(1, n)}) if sample else []

    @F.pandas_udf("int")
    def range_of(at):
        return at.map(lambda k: bisect_right(bounds, k)).astype("int32")

    @F.pandas_udf("array<int>")
    def ranges_of(at):
        return at.map(lambda k: list(range(bisect_right(bounds, k), bisect_right(bounds, k + "\U0010ffff") + 1)))

    urls = keyed.withColumn("_range", range_of(F.concat("_key", F.lit("\0"), "_path", F.lit("\0"), tie)))
    rule_key = F.concat(F.array_join(F.reverse(F.split("host", r"\.")), "."), F.lit("."))
    ruled = rules.groupBy(rule_key.alias("_key")).agg(F.collect_list(F.struct("path", "host", "verdict")).alias("_rules")).withColumn("_range", F.explode(ranges_of("_key")))
    both = urls.withColumn("_rules", F.lit(None).cast("array<struct<path:string,host:string,verdict:string>>")).unionByName(ruled, allowMissingColumns=True)

    def run(batches):
        sweep, last = Sweep(), None
        for batch in batches:
            col = {f: batch.column(i).to_pylist() for i, f in enumerate(batch.schema.names) if f in ("_range", "_key", "_path", "_rules", "_host")}
            found, mine = [], []
            for i, (rng, key, path, own) in enumerate(zip(col["_range"], col["_key"], col["_path"], col["_rules"])):
                if rng != last:
                    sweep, last = Sweep(), rng
                if own is not None:
                    host, *_ = [r["host"] for r in own]
                    sweep.open(key, _by_key((r["host"], r["path"], r["verdict"]) for r in own)[0][1])
                else:
                    mine.append(i)
                    found.append(sweep.judge(key, path) if col["_host"][i] else None)
            if mine:
                yield _answers(pa.schema([*((n, pa.null()) for n in names), ("_rule", pa.string()), ("_verdict", pa.string())]), batch.take(pa.array(mine)) if len(mine) < batch.num_rows else batch, found)

    return both.repartition(n, "_range").sortWithinPartitions("_range", "_key", F.col("_rules").isNull(), "_path").mapInArrow(run, out)
