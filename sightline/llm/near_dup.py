"""MinHash near-dedup with an LSH forest.

A document's set holds the hashes of its distinct shingles. Equal sets are one node from the start, so
exact copies, however many, cost one entry. Nodes get MinHash signatures, read as several orders (trees)
of `depth_max` values each. In a tree, nodes sorted by their values lie beside those with which they
share the longest prefix. Nodes that share `depth_min` values form a region; a region of more than
`crowd` nodes is taken deeper, value by value, as long as that splits it, up to depth_max. So depth
follows how crowded the place is.

Within a region, candidates are chosen by a one-byte sketch of the signature that lies well below the
limit, and each is confirmed on the full sets. First every node is compared with the smallest node of
its region and with its medoid, then those that this leaves with the smallest of them, and so on: a
region of n nodes costs about 2n comparisons, not n squared. Confirmed links are joined up. Regions
whose nodes then still lie in several components go on, by a sketch of 1024 values: each node outside the
largest of them is compared with its best partners in the others, the next 6, 24, 96 ... a round of those
that its bucket has not asked for yet, until no region has a pair left that is neither joined nor compared.
No partner is left out; a round only bounds how many are compared at a time.

The number of trees follows the limit, so that two documents at it are missed by all trees at full depth
with a chance of at most 1e-4: 20 trees at 0.85 (8e-5, and 4e-7 at depth 4), 31 at 0.8 (8e-5, and 8e-8).

Empty texts and texts without words have empty sets and are linked with nothing. Documents without an id
are linked with nothing, and their component is null. Documents of equal id and different sets are
different nodes. Texts with fewer words than a shingle have one shingle, all their words.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .text import U, Words, mixed, slices
from .workspace import Workspace, shuffle_partitions

TREES_MIN, DEPTH_MIN, DEPTH_MAX, CROWD, SKETCH, MISS = 16, 4, 6, 64, 64, 1e-4
#: Sketches of two sets at the limit lie within four standard deviations (0.045 each) of it.
SLACK = 0.18
#: Values of the fine sketch, its slack (four deviations of 0.011) and a third of the partners that a node gets in the first later round.
FINE, FINE_SLACK, RANKS = 1024, 0.045, 2


def trees_for(share: int) -> int:
    """Trees that all miss a pair of similarity share / 100 at full depth with a chance of at most MISS."""
    split = 1 - (share / 100) ** DEPTH_MAX
    return max(TREES_MIN, math.ceil(math.log(MISS) / math.log(split))) if split > 0 else TREES_MIN


def _multipliers(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(1, n + 1, dtype=U) + U(seed << 32)
    return (mixed(at) >> U(32)).astype(np.uint32) | np.uint32(1), (mixed(at + U(1 << 60)) >> U(32)).astype(np.uint32)


def shingle_sets(texts, k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, A-Z lower-cased."""
    words = Words(texts, lower=True)
    h, n = words.hash, len(words.hash)
    if n >= k:
        roll = mixed(h[: n - k + 1])
        for i in range(1, k):
            roll = mixed(roll * U(3) + h[i : n - k + 1 + i])
    out = []
    for a, b in zip(words.starts.tolist(), words.ends.tolist()):
        if b - a >= k:
            out.append(np.unique(roll[a : b - k + 1]))
        elif b > a:
            whole = mixed(h[a : a + 1])
            for i in range(a + 1, b):
                whole = mixed(whole * U(3) + h[i : i + 1])
            out.append(mixed(whole + U(b - a)))  # never a full shingle
        else:
            out.append(np.zeros(0, U))
    return out


def _signature(s: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    low = np.full(len(mul), 0xFFFFFFFF, np.uint32)
    s = s.astype(np.uint32)[:, None]
    for i in range(0, len(s), 512):
        x = s[i : i + 512] ^ add
        x *= mul
        np.minimum(low, x.min(axis=0), out=low)
    return low


def _sign(k: int, trees: int):
    def run(batches):
        mul, add = _multipliers(trees * DEPTH_MAX, 1)
        for batch in (x for b in batches for x in slices(b, 1)):
            sets = shingle_sets(batch.column(1), k)
            node = [xxhash.xxh3_64_intdigest(s.tobytes()) if len(s) else 0 for s in sets]
            sig = [_signature(s, mul, add).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(np.array(node, U).view(np.int64)), pa.array(sig, pa.binary())], names=["id", "n_shingles", "node", "sig"])

    return run


def _plant(n: int, trees: int):
    """Nodes into rows a bucket: each tree's entries, by a hash of the first values."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column(0).to_numpy()
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(len(node), trees, DEPTH_MAX)
            sketch = mixed(sig.reshape(len(node), trees * DEPTH_MAX)[:, :SKETCH].astype(U)).astype(np.uint8)
            key = np.zeros((len(node), trees), U) + mixed(np.arange(trees, dtype=U) + U(99))
            for d in range(DEPTH_MIN):
                key = mixed(key * U(3) + sig[:, :, d])
            bucket = (key % U(n)).astype(np.int64).ravel()
            order = np.argsort(bucket, kind="stable")
            who, tree = order // trees, order % trees
            values = sig[who, tree].astype(np.uint16)
            cut = np.flatnonzero(np.diff(bucket[order])) + 1
            edges = np.concatenate([[0], cut, [len(order)]])
            spans = [(int(i), int(j)) for i, j in zip(edges[:-1], edges[1:])]
            yield pa.RecordBatch.from_arrays([pa.array([int(bucket[order[i]]) for i, _ in spans], pa.int32()), *(pa.array([x[i:j].tobytes() for i, j in spans], pa.binary()) for x in (node[who], tree.astype(np.uint16), values, sketch[who]))], names=["bucket", "nodes", "trees", "values", "sketches"])

    return run


def regions(tree: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted order of entries, and in it where each region starts; adaptive depth."""
    order = np.lexsort((*(values[:, d] for d in range(DEPTH_MAX - 1, -1, -1)), tree))
    t, v = tree[order], values[order]
    same = t[1:] == t[:-1]
    run = None
    chosen = np.full(len(order), -1, np.int64)
    for d in range(1, DEPTH_MAX + 1):
        same = same & (v[1:, d - 1] == v[:-1, d - 1])
        if d < DEPTH_MIN:
            continue
        run = np.concatenate([[0], np.cumsum(~same)])
        size = np.bincount(run)[run]
        take = (chosen < 0) & ((size <= CROWD) | (d == DEPTH_MAX))
        chosen[take] = run[take] * (DEPTH_MAX + 1) + d
    starts = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]])) if len(order) else np.zeros(0, np.int64)
    return order, starts


def _alike(sketch: np.ndarray, other: np.ndarray) -> np.ndarray:
    return (sketch == other).mean(axis=-1)


def _grow(limit: float):
    """A bucket's regions of several nodes: first candidates, and the members for later rounds."""

    def run(table: pa.Table) -> pa.Table:
        node = np.frombuffer(b"".join(table.column("nodes").to_pylist()), np.int64)
        tree = np.frombuffer(b"".join(table.column("trees").to_pylist()), np.uint16)
        values = np.frombuffer(b"".join(table.column("values").to_pylist()), np.uint16).reshape(-1, DEPTH_MAX)
        sketch = np.frombuffer(b"".join(table.column("sketches").to_pylist()), np.uint8).reshape(-1, SKETCH)
        order, starts = regions(tree, values)
        ends = np.append(starts[1:], len(order))
        pairs_a, pairs_b, kept, region, live = [], [], [], [], 0
        for i, j in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
            own = order[i:j]
            own = own[np.argsort(node[own], kind="stable")]
            left, any_pair = own, False
            if len(own) > 2:
                some = sketch[own[:: -(-len(own) // 256)]]
                close = np.array([_alike(sketch[x], some).mean() for x in own])
                middle = own[np.flatnonzero(close >= close.max() - 0.02)[0]]
                hit = own[(_alike(sketch[middle], sketch[own]) >= limit) & (own != middle)]
                pairs_a.append(np.minimum(node[middle], node[hit]))
                pairs_b.append(np.maximum(node[middle], node[hit]))
            while len(left) > 1:
                near = _alike(sketch[left[0]], sketch[left[1:]]) >= limit
                if near.any():
                    any_pair = True
                    hit = left[1:][near]
                    pairs_a.append(np.full(len(hit), node[left[0]]))
                    pairs_b.append(node[hit])
                left = left[1:][~near]
            if any_pair:
                kept.append(own)
                region.append(np.full(len(own), live))
                live += 1
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        kept, region = cat(kept, np.int64), cat(region, np.int64)
        return pa.table({"bucket": pa.array([table.column("bucket")[0].as_py()], pa.int32()), "a": [cat(pairs_a, np.int64).tobytes()], "b": [cat(pairs_b, np.int64).tobytes()], "nodes": [node[kept].tobytes()], "regions": [region.astype(np.int32).tobytes()], "sketches": [sketch[kept].tobytes()]})

    return run


_GROWN = "bucket int, a binary, b binary, nodes binary, regions binary, sketches binary"


def _unpack(*names):
    """Binary arrays of longs, one row an element; rows stay under a million a batch."""

    def run(batches):
        for batch in batches:
            for row in zip(*(batch.column(batch.schema.get_field_index(n)) for n in names)):
                cols = [np.frombuffer(x.as_py(), np.int64) for x in row]
                for i in range(0, len(cols[0]), 1 << 17):
                    yield pa.RecordBatch.from_arrays([pa.array(c[i : i + (1 << 17)]) for c in cols], names=list(names))

    return run


def _again(limit: float, turn: int):
    """Of a bucket's regions: pairs between components, of each node the best ones that the bucket hasn't asked for."""
    ranks = 3 * RANKS * 4**turn

    def run(table: pa.Table, asked: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        region, node, label = (table.column(c).to_numpy() for c in ("region", "node", "label"))
        order = np.lexsort((node, region))
        region, node, label = region[order], node[order], label[order]
        sketch = np.frombuffer(b"".join(table.column("fine").take(pa.array(order)).to_pylist()), np.uint8).reshape(-1, FINE)
        ends = [np.frombuffer(b"".join(asked.column(c).to_pylist()), np.int64) for c in ("a", "b")]
        one, other = np.concatenate(ends), np.concatenate(ends[::-1])
        by = np.argsort(one, kind="stable")
        one, other = one[by], other[by]
        out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        edges = np.concatenate([[0], np.flatnonzero(np.diff(region)) + 1, [len(region)]])
        for i, j in zip(edges[:-1], edges[1:]):
            kinds, inverse, n = np.unique(label[i:j], return_inverse=True, return_counts=True)
            for x in np.flatnonzero(inverse != n.argmax()) if len(kinds) > 1 else ():
                est = _alike(sketch[i + x], sketch[i:j])
                est[inverse == inverse[x]] = 0
                before = other[np.searchsorted(one, node[i + x]) : np.searchsorted(one, node[i + x], "right")]
                at = np.minimum(np.searchsorted(node[i:j], before), j - i - 1)
                est[at[node[i:j][at] == before]] = 0
                best = np.argsort(-est, kind="stable")[:ranks]
                best = best[est[best] >= limit]
                out_a.append(np.minimum(node[i + x], node[i:j][best]))
                out_b.append(np.maximum(node[i + x], node[i:j][best]))
        pairs = np.unique(np.stack([np.concatenate(out_a), np.concatenate(out_b)]), axis=1)
        buckets = table.column("bucket")[:1].cast(pa.int32()) if pairs.size else pa.array([], pa.int32())
        return pa.table({"bucket": buckets, **{c: pa.array([x.tobytes()] if pairs.size else [], pa.binary()) for c, x in zip("ab", pairs)}})

    return run


def _confirm(share: int):
    """Pairs with both sets: links of 100 * intersection >= share * union."""

    def run(batches):
        for batch in batches:
            a, b, keep = batch.column("set_a"), batch.column("set_b"), []
            for x, y in zip(a, b):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = len(np.intersect1d(x, y, assume_unique=True)) if 100 * min(len(x), len(y)) >= share * max(len(x), len(y)) else 0
                keep.append(100 * both >= share * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(keep, pa.bool_())], names=["a", "b", "linked"])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, share: int = 80, space: Workspace | None = None) -> DataFrame:
    """One row a document: id, n_shingles, component_id, kept. Links: 100 * intersection >= share * union of k-word shingles.

    space: where tables are written; its caller clears it when the result was used.
    """
    spark = docs.sparkSession
    space = space or Workspace(spark, "near")
    limit = share / 100 - SLACK
    n, trees = shuffle_partitions(spark), trees_for(share)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    signed = space.keep(base.mapInArrow(_sign(k, trees), "id long, n_shingles long, node long, sig binary"))
    nodes = space.keep(signed.where("id is not null and n_shingles > 0").groupBy("node").agg(F.min("id").alias("least"), F.first("sig").alias("sig")))
    # buckets follow the entries, about 4 MB each, whatever the session's partitions
    n = max(n, -(-nodes.count() * trees // 50_000))
    planted = nodes.select("node", "sig").mapInArrow(_plant(n, trees), "bucket int, nodes binary, trees binary, values binary, sketches binary")
    grown = space.keep(planted.groupBy("bucket").applyInArrow(_grow(limit), _GROWN))
    todo = space.keep(grown.mapInArrow(_unpack("a", "b"), "a long, b long").distinct())
    members = grown.select(F.col("nodes").alias("node")).mapInArrow(_unpack("node"), "node long").distinct()
    # the sets of nodes that have a candidate, each from one of its documents
    one = nodes.join(members, "node").select("node", F.col("least").alias("id"))
    sets = space.keep(base.join(one, "id").mapInArrow(_set_rows(k), "node long, words binary, fine binary").dropDuplicates(["node"]))
    tested, labels, turn, wide, asked = None, None, 0, None, grown.select("bucket", "a", "b")
    while True:
        pairs = todo.join(sets.select(F.col("node").alias("a"), F.col("words").alias("set_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("words").alias("set_b")), "b")
        done = space.keep(pairs.select("a", "b", "set_a", "set_b").mapInArrow(_confirm(share), "a long, b long, linked boolean"))
        tested = done if tested is None else space.keep(tested.unionByName(done))
        if not turn or not done.where("linked").isEmpty():
            labels = space.keep(components(tested.where("linked").select("a", "b"), space))
        places = wide if wide is not None else grown.mapInArrow(_places, "bucket int, region int, node long")
        marked = places.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        if wide is None:  # only regions with several components go on, now with the fine sketch
            open_ = marked.groupBy("bucket", "region").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("bucket", "region")
            wide = space.keep(marked.drop("label").join(open_, ["bucket", "region"], "left_semi").join(sets.select("node", "fine"), "node"))
            marked = wide.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        found = space.keep(marked.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(_again(share / 100 - FINE_SLACK, turn), "bucket int, a binary, b binary"))
        if found.isEmpty():
            break
        asked = asked.unionByName(found)
        todo = space.keep(found.mapInArrow(_unpack("a", "b"), "a long, b long").distinct().join(tested, ["a", "b"], "left_anti"))
        turn += 1
    space.drop_but(signed, nodes, labels)  # the rounds' tables
    least = nodes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "least")
    smallest = least.groupBy("label").agg(F.min("least").alias("component"))
    final = least.join(smallest, "label").select(F.col("node").alias("_node"), "component")
    out = signed.select("id", "n_shingles", "node").join(final, (F.col("node") == F.col("_node")) & (F.col("n_shingles") > 0) & F.col("id").isNotNull(), "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _places(batches):
    """Members of regions, one row each."""
    for batch in batches:
        for bucket, nodes, region in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("bucket", "nodes", "regions"))):
            nodes, region = np.frombuffer(nodes.as_py(), np.int64), np.frombuffer(region.as_py(), np.int32)
            for i in range(0, len(nodes), 1 << 17):
                part = slice(i, i + (1 << 17))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(nodes[part]), bucket.as_py(), np.int32)), pa.array(region[part]), pa.array(nodes[part])], names=["bucket", "region", "node"])


def _set_rows(k: int):
    """Sets of texts; rows whose set is not the node's (another text under the same id) go."""

    def run(batches):
        for batch in (x for b in batches for x in slices(b, b.schema.get_field_index("text"))):
            sets = shingle_sets(batch.column(batch.schema.get_field_index("text")), k)
            want = batch.column(batch.schema.get_field_index("node")).to_numpy().view(U)
            keep = [i for i, s in enumerate(sets) if len(s) and xxhash.xxh3_64_intdigest(s.tobytes()) == int(want[i])]
            mul, add = _multipliers(FINE, 2)
            fine = [mixed(_signature(sets[i], mul, add).astype(U)).astype(np.uint8).tobytes() for i in keep]
            yield pa.RecordBatch.from_arrays([pa.array(want[keep].view(np.int64), pa.int64()), pa.array([sets[i].tobytes() for i in keep], pa.binary()), pa.array(fine, pa.binary())], names=["node", "words", "fine"])

    return run
