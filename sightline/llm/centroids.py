"""Centroid clustering in exact integers, with Drake's adaptive bounds.

Every vector keeps its centroid, an upper bound of the distance to it, lower bounds of the distances to
its `near` next centroids in order, and one remainder bound for all others. When centroids move, the
upper bound grows by its centroid's move, a lower bound shrinks by its own centroid's move and the
remainder by the largest. If the upper bound is below the first lower bound the vector stays, and nothing
is calculated. Else the first place is sought whose next bound the tightened upper bound stays below: the
centroids up to there are measured exactly and put in order; if not even the remainder certifies that the
nearest is among them, all are measured. So results equal those of measuring all distances every round,
ties included, which only a strict certificate excludes. After each round `near` shrinks to the deepest
place that any vector needed, an eighth of the centroids (two) at least, as Drake's rule says.

Components are integers, so squared distances, sums and floors are exact. Bounds are rounded outwards.

Vectors are written once, bucketed by a row number, and never again; a round writes only its bounds (some
20 bytes a vector), bucketed alike, so that a round is one scan of both that joins in place, without a
shuffle. A vector that changes its centroid adds to that task's differences of sums and counts, which
ride on the rows of the bounds; they are added up by Spark, and a round's new centroids, k times the
dimensions, are all that the driver sees. A lost executor's tasks are made again from the tables.

Kept are vectors of exactly `dim` components, none null or not finite. Components are x * scale, floored,
and clamped to +-2^27, so that squared distances of up to 127 components fit 64 bits; a sum of distances
that doesn't fit is null. Rows without an id are clustered but give no starting centroid. Repeated rows
count each time; those of one id may give several centroids, in order of their components' bytes, and of
equal centroids the smaller number takes all. With fewer than k kept vectors with an id there are fewer
centroids; with none, no vector is returned. Empty centroids stay where they are. Other columns are left
out.
"""
from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace, shuffle_partitions

LIMIT = 1 << 27
STATE = "row long, cluster int, high float, rest float, order binary, low binary, moved binary"


def whole(batches, dim: int, scale: int):
    """Rows (id, vec) to (id, vec as bytes of 32-bit integers), only those that are kept."""
    for batch in batches:
        ids, out = [], []
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
            x = v.values if v.is_valid else None
            if x is None or len(x) != dim or x.null_count:
                continue
            x = x.to_numpy(zero_copy_only=False).astype(np.float64)
            if not np.isfinite(x).all():
                continue
            ids.append(i)
            out.append(np.floor(np.clip(x * scale, -LIMIT, LIMIT)).astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["id", "vec"])


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances (n, k) of int64 rows."""
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * (1 + 1e-12)).astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter((x * (1 - 1e-12)).astype(np.float32), np.float32(-np.inf)), np.float32(0))


class Bounds:
    """Of n vectors: cluster, high, order and low (n, near), rest; used: the deepest place a round measured."""

    def __init__(self, cluster, high, order, low, rest):
        self.cluster, self.high, self.order, self.low, self.rest, self.used = cluster, high, order, low, rest, 0

    @classmethod
    def measured(cls, x: np.ndarray, centroids: np.ndarray, near: int) -> Bounds:
        """All distances; equal ones in order of number."""
        d = squared(x, centroids)
        order = np.argsort(d, axis=1, kind="stable")
        root = np.sqrt(np.take_along_axis(d, order, axis=1))
        near = min(near, len(centroids) - 1)
        rest = _down(root[:, near + 1]) if near + 1 < len(centroids) else np.full(len(x), np.inf, np.float32)
        return cls(order[:, 0].astype(np.int32), _up(root[:, 0]), order[:, 1 : near + 1].astype(np.int32), _down(root[:, 1 : near + 1]), rest)

    def step(self, x: np.ndarray, centroids: np.ndarray, moves: np.ndarray, near: int) -> None:
        """After centroids moved by `moves` (rounded up), with `near` bounds kept from now on."""
        if near < self.low.shape[1]:
            self.rest = np.minimum(self.rest, self.low[:, near:].min(axis=1))
            self.order, self.low = self.order[:, :near], self.low[:, :near]
        self.high = _up(self.high.astype(np.float64) + moves[self.cluster])
        self.low = _down(self.low.astype(np.float64) - moves[self.order])
        self.rest = _down(self.rest.astype(np.float64) - moves.max(initial=0.0))
        # rest and later bounds may fall below earlier ones: what counts at a place is the least from there on
        least = np.minimum.accumulate(np.concatenate([self.low, self.rest[:, None]], axis=1)[:, ::-1], axis=1)[:, ::-1]
        open_ = np.flatnonzero(self.high >= least[:, 0])
        if not len(open_):
            return
        own = ((x[open_] - centroids[self.cluster[open_]]) ** 2).sum(axis=1)
        self.high[open_] = _up(np.sqrt(own))
        open_ = open_[self.high[open_] >= least[open_, 0]]
        if not len(open_):
            return
        b = self.low.shape[1]
        place = np.where(self.high[open_, None] < least[open_, 1:], np.arange(1, b + 1), b + 1).min(axis=1, initial=b + 1)
        self.used = int(place.max())
        for z in np.unique(place):
            rows = open_[place == z]
            if z > b:  # the ordering can't be certified
                new = Bounds.measured(x[rows], centroids, b)
                self.cluster[rows], self.high[rows], self.order[rows], self.low[rows], self.rest[rows] = new.cluster, new.high, new.order, new.low, new.rest
                continue
            ids = np.concatenate([self.cluster[rows, None], self.order[rows, :z]], axis=1)
            d = ((x[rows, None, :] - centroids[ids]) ** 2).sum(axis=2)
            rank = np.lexsort((ids, d), axis=1)
            ids, root = np.take_along_axis(ids, rank, axis=1), np.sqrt(np.take_along_axis(d, rank, axis=1))
            self.cluster[rows], self.high[rows] = ids[:, 0], _up(root[:, 0])
            self.order[rows, :z], self.low[rows, :z] = ids[:, 1:], _down(root[:, 1:])


def _binary(x: np.ndarray) -> pa.Array:
    flat, width = np.ascontiguousarray(x).tobytes(), x.shape[1] * x.itemsize if x.ndim == 2 else x.itemsize
    return pa.array([flat[i : i + width] for i in range(0, len(flat), width)] if width else [b""] * len(x), pa.binary())


def _rows(column, kind, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(n, -1).copy()


def _round(centroids: np.ndarray, moves: np.ndarray | None, near: int):
    """Batches of vectors with their last bounds, or of vectors alone in the first round, to bounds."""
    k, dim = centroids.shape

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            x = _rows(col["vec"], np.int32, n).astype(np.int64)
            if moves is None:
                was, state = np.full(n, -1, np.int32), Bounds.measured(x, centroids, near)
            else:
                was = col["cluster"].to_numpy()
                state = Bounds(was.copy(), col["high"].to_numpy().copy(), _rows(col["order"], np.uint16, n).astype(np.int32), _rows(col["low"], np.float32, n), col["rest"].to_numpy().copy())
                state.step(x, centroids, moves, near)
            diff = np.zeros((k, dim + 1), np.int64)
            for rows, ids, sign in ((np.flatnonzero(was != state.cluster), state.cluster, 1), (np.flatnonzero((was != state.cluster) & (was >= 0)), was, -1)):
                np.add.at(diff[:, 0], ids[rows], sign)
                np.add.at(diff[:, 1:], ids[rows], sign * x[rows])
            moved = [None] * n
            if diff.any() or state.used:
                moved[0] = np.append(diff, state.used).tobytes()
            yield pa.RecordBatch.from_arrays(
                [col["row"], pa.array(state.cluster, pa.int32()), pa.array(state.high), pa.array(state.rest), _binary(state.order.astype(np.uint16)), _binary(state.low), pa.array(moved, pa.binary())],
                names=["row", "cluster", "high", "rest", "order", "low", "moved"],
            )

    return run


def _summed(k: int, dim: int):
    """Differences of many batches to one row a task, centroid and component, and the deepest place as the last."""

    def run(batches):
        total, used = np.zeros(k * (dim + 1) + 1, np.int64), 0
        for batch in batches:
            for v in batch.column(0).to_pylist():
                own = np.frombuffer(v, np.int64)
                total, used = total + own, max(used, int(own[-1]))
        total[-1] = used
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["at", "n"])

    return run


class _Bucketed:
    """Tables bucketed by row, in the shared folder; names go when they are dropped."""

    def __init__(self, space: Workspace, buckets: int):
        self.space, self.buckets, self.tag, self.n = space, buckets, uuid.uuid4().hex[:12], 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        name = f"_centroids_{self.tag}_{self.n}"
        df.write.bucketBy(self.buckets, "row").sortBy("row").option("path", f"{self.space.root}/bucketed-{self.n}").format("parquet").saveAsTable(name)
        out = self.space.spark.table(name)
        out._name, out._kept_path = name, f"{self.space.root}/bucketed-{self.n}"
        return out

    def drop(self, df: DataFrame) -> None:
        self.space.spark.sql(f"DROP TABLE IF EXISTS {df._name}")
        self.space.drop(df)


def cluster_vectors(df: DataFrame, id_col: str = "vec_id", vec: str = "embedding", dim: int = 64, scale: int = 1024, k: int = 8, rounds: int = 10, near: int | None = None, seed: int = 3) -> DataFrame:
    """One row a kept vector: id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256, centroid (its components).

    Centroids 0, 1, ... start as the k vectors with the smallest SHA-256 of `seed:id`; each round assigns every vector
    to the nearest (ties: the smaller number) and replaces centroids by the floor of their vectors' mean; then vectors
    are assigned once more.
    """
    if not 0 < k < 1 << 16:
        raise ValueError("k must be from 1 to 65,535")
    spark, space = df.sparkSession, Workspace(df.sparkSession, "centroids")
    vectors = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec}`").alias("vec")).mapInArrow(lambda b: whole(b, dim, scale), "id long, vec binary")
    tables = _Bucketed(space, shuffle_partitions(spark))
    vectors = tables.keep(vectors.withColumn("row", F.monotonically_increasing_id()).repartition(tables.buckets, "row"))
    first = vectors.where("id is not null").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h"), "row", "vec").orderBy("h", "vec").limit(k).collect()
    none = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>"
    if not first:
        return spark.createDataFrame([], f"`{id_col}` long, {none}")
    centroids = np.stack([np.frombuffer(r.vec, np.int32) for r in first]).astype(np.int64)
    k = len(centroids)
    least = min(k - 1, max(2, k // 8))
    near = min(k - 1, max(least, k // 4 + 1) if near is None else near)
    state, moves, sums = None, None, np.zeros((k, dim + 1), dtype=object)
    for _ in range(rounds):
        joined = vectors.select("row", "vec") if state is None else vectors.select("row", "vec").join(state.select("row", "cluster", "high", "rest", "order", "low").hint("merge"), "row")
        before, state = state, tables.keep(joined.mapInArrow(_round(centroids, moves, near), STATE))
        if before is not None:
            tables.drop(before)
        told = state.where("moved is not null").select("moved").mapInArrow(_summed(k, dim), "at int, n long").groupBy("at").agg(F.sum("n").alias("n"), F.max("n").alias("most")).collect()
        deepest = 0
        for r in told:  # k * (dim + 1) + 1 rows at most
            if r.at == k * (dim + 1):
                deepest = r.most
            else:
                sums[r.at // (dim + 1), r.at % (dim + 1)] += r.n
        if moves is not None:
            near = max(least, min(near, deepest))
        new = np.array([[s // c[0] for s in c[1:]] if c[0] else old.tolist() for c, old in zip(sums.tolist(), centroids)], dtype=np.int64).reshape(k, dim)
        moves = np.sqrt(((new - centroids) ** 2).sum(axis=1)) * (1 + 1e-12)
        centroids = new
    return _assigned(vectors, state, centroids, moves, near, tables, id_col)


def _last(centroids: np.ndarray, moves: np.ndarray | None, near: int):
    """The last assignment, with exact distances."""
    step = _round(centroids, moves, near)

    def run(batches):
        for batch in batches:
            x = _rows(batch.column(batch.schema.get_field_index("vec")), np.int32, batch.num_rows).astype(np.int64)
            for out in step([batch]):
                cluster = out.column(1).to_numpy()
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("id")), out.column(1), pa.array(((x - centroids[cluster]) ** 2).sum(axis=1))], names=["id", "cluster", "distance"])

    return run


def _assigned(vectors: DataFrame, state: DataFrame | None, centroids: np.ndarray, moves, near: int, tables: _Bucketed, id_col: str) -> DataFrame:
    joined = vectors if state is None else vectors.join(state.select("row", "cluster", "high", "rest", "order", "low").hint("merge"), "row")
    out = tables.space.keep(joined.mapInArrow(_last(centroids, moves, near), "id long, cluster int, distance long"))
    for done in (vectors, *([] if state is None else [state])):
        tables.drop(done)
    sums = {r.cluster: int(r.n) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("n")).collect()}  # k rows at most
    fits = lambda n: n if n < 1 << 63 else None
    rows = [(c, fits(n), fits(sum(sums.values())), centroids[c].tolist()) for c, n in sums.items()]
    per = out.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    per = per.select("cluster", "cluster_inertia", "inertia", F.sha2(F.array_join("centroid", ","), 256).alias("centroid_sha256"), "centroid")
    return out.join(F.broadcast(per), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")
