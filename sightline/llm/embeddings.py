"""Embedding near-dedup: a subspace pigeonhole join.

Unit vectors with a cosine of at least c lie within D = 2 - 2c of each other in squared distance. After
a fixed random rotation their coordinates are split into blocks of `block` dimensions; if every block
were further apart than its share of D (in proportion to its dimensions), the whole would be too. So
each block is a range join of its own, under its share; the union of what the blocks find is verified
exactly, in double precision. A pair that several blocks find is counted by the first of them.

A block's range join cuts its first `axes` coordinates into cells twice the radius wide. Cells and
neighbouring cells are compared tile by tile, a tile being at most `tile` vectors of a cell; only vectors
within the radius of a neighbour's cell go there. Within a tile pair, distances are a matrix product.
The number of cells is bounded by the cells' width, so their sizes are a small table on the driver.

Equal vectors are one node. A tile pair returns, for each vector it links, how many it links with and
one representative, not the pairs themselves; so a dense group costs rows in proportion to its size.

Vectors that are null, zero, empty or hold null or non-finite numbers link with nothing, as do rows
without an id. Vectors of different lengths are never compared. Ids may repeat: each row counts.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .workspace import Workspace


def rotation(dim: int) -> np.ndarray:
    """The same orthogonal matrix in every task."""
    q, r = np.linalg.qr(np.random.default_rng(20240101 + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


class Plan:
    def __init__(self, dim: int, cosine: float, block: int, axes: int):
        self.rot = rotation(dim)
        cuts = list(range(0, dim, block))
        if len(cuts) > 1 and dim - cuts[-1] < block // 2:
            cuts.pop()
        self.blocks = [(a, b) for a, b in zip(cuts, [*cuts[1:], dim])]
        total = (2 - 2 * cosine) * (1 + 1e-6)
        self.budget = [total * (b - a) / dim for a, b in self.blocks]
        self.axes = axes

    def cells(self, unit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, float]:
        """Cell numbers on the block's first axes, coordinates, radius."""
        a, b = self.blocks[k]
        at = unit @ self.rot[:, a : min(b, a + self.axes)]
        r = float(np.sqrt(self.budget[k])) + 1e-9
        return np.floor(at / (2 * r)).astype(np.int64), at, r


def _units(flat: np.ndarray) -> np.ndarray:
    x = flat.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _valid(batches):
    """Rows to (id, dim, vec): vec the numbers' bytes, null if the vector links with nothing."""
    for batch in batches:
        ids, col = batch.column(0), batch.column(1)
        dims, out = [], []
        for v in col:
            x = None if v is None or not v.is_valid else v.values
            if x is None or not len(x) or x.null_count:
                dims.append(0)
                out.append(None)
                continue
            x = x.to_numpy()
            ok = np.isfinite(x).all() and x.any()
            dims.append(len(x) if ok else 0)
            out.append((x + x.dtype.type(0)).tobytes() if ok else None)  # -0 becomes 0
        yield pa.RecordBatch.from_arrays([ids, pa.array(dims, pa.int32()), pa.array(out, pa.binary())], names=["id", "dim", "vec"])


def _matrix(table, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("vec").to_pylist()), kind).reshape(table.num_rows, -1)


def _place(make, kind, sizes: dict | None, tile: int):
    """Nodes to cells: counts if sizes is unknown, else copies for the tile pairs they take part in."""

    def run(batches):
        plans: dict = {}
        for batch in batches:
            dims = batch.column(batch.schema.get_field_index("dim")).to_numpy()
            for dim in np.unique(dims):
                own = batch.filter(pa.array(dims == dim))
                plan = plans.setdefault(dim, make(int(dim)))
                unit = _units(_matrix(own, kind))
                node = own.column(own.schema.get_field_index("node")).to_numpy()
                for k in range(len(plan.blocks)):
                    cell, at, r = plan.cells(unit, k)
                    if sizes is None:
                        found, n = np.unique(cell, axis=0, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([f"{dim},{k}," + ",".join(map(str, c)) for c in found]), pa.array(n, pa.int64())], names=["cell", "n"])
                        continue
                    keys, rows, sides = [], [], []
                    for moved in np.ndindex(*[3] * cell.shape[1]):
                        to = cell + np.array(moved) - 1
                        near = ((at >= to * 2 * r - r) & (at <= (to + 1) * 2 * r + r)).all(axis=1)
                        for i in np.flatnonzero(near):
                            a, b = tuple(cell[i]), tuple(to[i])
                            there = sizes.get((int(dim), k, b))
                            if there is None:
                                continue
                            mine = int(node[i]) % -(-sizes[int(dim), k, a] // tile)
                            for j in range(-(-there // tile)):
                                x, y = (a, mine), (b, j)
                                low, high = (x, y) if x <= y else (y, x)
                                keys.append(f"{dim},{k},{low},{high}" + "=" * (x == y))
                                rows.append(i)
                                sides.append(x != low)
                    rest = own.take(pa.array(rows, pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([k] * len(keys), pa.int32()), pa.array(sides, pa.bool_()), *(rest.column(rest.schema.get_field_index(c)) for c in ("node", "dim", "n", "vec"))], names=["tile", "block", "high", "node", "dim", "n", "vec"])

    return run


def _join(make, kind, cosine: float):
    def run(table: pa.Table) -> pa.Table:
        none = pa.table({"node": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        plan, k = make(table.column("dim")[0].as_py()), table.column("block")[0].as_py()
        table = table.combine_chunks()
        high = table.column("high").to_numpy(zero_copy_only=False)
        raw, node, n = _matrix(table, kind).astype(np.float64), table.column("node").to_numpy(), table.column("n").to_numpy()
        unit = _units(raw)
        a, b = plan.blocks[k]
        block = (unit @ plan.rot[:, a:b]).astype(np.float32)
        left, right = (np.flatnonzero(~high), np.flatnonzero(high))
        alone = table.column("tile")[0].as_py().endswith("=")  # a tile with itself
        if alone:
            right = left
        norm = (block * block).sum(axis=1)
        x_all, y_all = [], []
        for i in range(0, len(left), 1024):
            rows = left[i : i + 1024]
            near = norm[rows, None] + norm[right] - 2 * (block[rows] @ block[right].T) <= plan.budget[k] + 1e-4
            x, y = np.nonzero(near)
            x, y = rows[x], right[y]
            keep = node[x] < node[y] if alone else slice(None)
            x_all.append(x[keep])
            y_all.append(y[keep])
        x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (x_all, y_all))
        linked_x, linked_y = [], []
        for i in range(0, len(x), 1 << 15):
            u, v = unit[x[i : i + (1 << 15)]], unit[y[i : i + (1 << 15)]]
            ok = np.einsum("ij,ij->i", u, v) >= cosine - 1e-9
            if not ok.any():
                continue
            px, py, apart = x[i : i + (1 << 15)][ok], y[i : i + (1 << 15)][ok], (u - v)[ok]
            first = np.full(len(px), -1)
            for j, (p, q) in enumerate(plan.blocks):  # no matrix product: the same bits in every task
                d = np.einsum("ij,jk->ik", apart, plan.rot[:, p:q], optimize=False)
                first[(first < 0) & ((d * d).sum(axis=1) <= plan.budget[j])] = j
            rx, ry = raw[px], raw[py]
            cos = (rx * ry).sum(axis=1) / (np.sqrt((rx * rx).sum(axis=1)) * np.sqrt((ry * ry).sum(axis=1)))
            weak = ~np.isfinite(cos) | (cos == 0)  # numbers too large or small to square
            cos[weak] = np.einsum("ij,ij->i", unit[px], unit[py])[weak]
            good = (first == k) & (cos >= cosine)
            linked_x.append(px[good])
            linked_y.append(py[good])
        if not sum(map(len, linked_x)):
            return none
        x, y = np.concatenate(linked_x), np.concatenate(linked_y)
        links = np.zeros(len(node), np.int64)
        np.add.at(links, x, n[y])
        np.add.at(links, y, n[x])
        root = node.copy()
        while True:  # each takes the smallest root among itself and its partners, until nothing moves
            low = np.minimum(root[x], root[y])
            new = root.copy()
            np.minimum.at(new, x, low)
            np.minimum.at(new, y, low)
            if (new == root).all():
                break
            root = new
        used = np.flatnonzero(links)
        return pa.table({"node": node[used], "links": links[used], "root": root[used]})

    return run


def link_vectors(df: DataFrame, id_col: str = "vec_id", vec: str = "embedding", cosine: float = 0.95, block: int = 16, axes: int = 2, tile: int = 8192) -> DataFrame:
    """One row a vector: id, n_links, component_id, kept."""
    spark = df.sparkSession
    space = Workspace(spark, "embeddings")
    double = df.select(vec).schema[0].dataType.elementType.typeName() != "float"
    col = F.col(vec).cast("array<double>") if double else F.col(vec)
    kind = np.float64 if double else np.float32
    rows = space.keep(df.select(F.col(id_col).cast("long").alias("id"), col.alias("vec")).mapInArrow(_valid, "id long, dim int, vec binary").withColumn("node", F.xxhash64("vec")))
    nodes = space.keep(rows.where("vec is not null and id is not null").groupBy("node", "dim", "vec").agg(F.min("id").alias("least"), F.count("*").alias("n")))

    def make(dim):
        return Plan(dim, cosine, block, axes)

    cells = nodes.mapInArrow(_place(make, kind, None, tile), "cell string, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    sizes = {(int(d), int(k), tuple(map(int, c))): r.n for r in cells for d, k, *c in [r.cell.split(",")]}
    placed = nodes.repartition("node").mapInArrow(_place(make, kind, sizes, tile), "tile string, block int, high boolean, node long, dim int, n long, vec binary")
    linked = space.keep(placed.groupBy("tile").applyInArrow(_join(make, kind, cosine), "node long, links long, root long"))
    labels = components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")), space)
    counts = linked.groupBy("node").agg(F.sum("links").alias("links"))
    full = nodes.select("node", "n", "least").join(counts, "node", "left").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = full.groupBy("label").agg(F.min("least").alias("component"))
    full = full.join(smallest, "label").select(F.col("node").alias("_node"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component")
    out = rows.select("id", "node", (F.col("vec").isNotNull() & F.col("id").isNotNull()).alias("ok")).join(full, F.col("ok") & (F.col("node") == F.col("_node")), "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
