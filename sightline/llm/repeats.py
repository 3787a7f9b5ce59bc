"""Substring dedup by fixed-block anchors.

A word goes if a window of 50 words covers it whose sequence also starts in a document of smaller id.
Every such window holds, in the other document, a whole block of 25 words that starts at a multiple of
25 there. So the blocks of all documents are the index, and each of every document's rolling windows of
25 words probes it. Hits are extended both ways: all windows of 50 around a hit are compared in full, the
smallest id of each is found, and words in windows that a smaller id holds form the maximal exact
repeats that go. Windows are equal if two independent hashes of 64 bits are, over words hashed apart for
each; so among 10^13 windows a false removal has a chance of 10^-13.

Documents are dealt into parts by a hash. A part sends what it holds once: 32-bit fingerprints of its
distinct probes, dealt over buckets by the other bits of their hash, then its distinct candidate windows.
So a passage that a third of all documents share costs a part one entry, and a bucket one entry a part.
There are `BUCKETS` buckets until one would hold the fingerprints of over 64 MB of text: up to there the
rows of a pass grow with the parts, as the text does; beyond it a row gets smaller as they grow, and there
are never more rows than fingerprints. Fingerprints only choose candidates.
The parts are shuffled once, and the three passes over them share that exchange.

Null or empty text has no words. Documents without an id neither lose words nor serve as a reference.
Documents of equal id don't remove each other's words. Texts that lose nothing stay as they were; of
others the kept words are joined by one space. Repeated rows are dealt over parts like others.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Rolling, U, Words, is_in, joined, mixed, window_starts
from .workspace import dealt, parts_for

LOW, BUCKETS = U(0xFFFFFFFF), 64
NONE = np.iinfo(np.int64).min


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    """Rises with h, so sorted hashes lie bucket by bucket."""
    return ((h >> U(32)) * U(n)) >> U(32)


def _ids(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    col = table.column("_id")
    return col.fill_null(NONE).to_numpy(), col.is_valid().to_numpy()


class _Part:
    """Words of a part's documents, and where windows of `window` words may start."""

    def __init__(self, table: pa.Table, window: int):
        self.ids, has_id = _ids(table)
        self.words = Words(table.column("_text"))
        self.doc = self.words.doc_of()
        self.rolling = Rolling(self.words.hash)
        self.long = has_id & (self.words.counts >= window)
        self.window, self.block = window, window // 2

    def probes(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of all rolling blocks of documents that have a window."""
        h = self.rolling.of(self.block)
        at = np.flatnonzero(window_starts(self.words, self.block) & self.long[self.doc[: len(h)]]) if len(h) else np.zeros(0, np.int64)
        return at, h[at]

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Where windows may start, and their first hash."""
        h = _key(self.rolling.of(self.window))
        ok = window_starts(self.words, self.window)
        if len(h):
            ok &= self.long[self.doc[: len(h)]]
        return ok, h

    def checks(self, at: np.ndarray) -> np.ndarray:
        """The second hash of windows that start at `at`."""
        return Rolling(self.words.hashes(1)).of(self.window)[at] if len(at) else np.zeros(0, U)


def _key(h: np.ndarray) -> np.ndarray:
    """The first hash of windows as it is; tests make it clash."""
    return h


def _match(w: np.ndarray, c: np.ndarray, table_w: np.ndarray, table_c: np.ndarray) -> np.ndarray:
    """Whether both hashes of a window are together in the table."""
    z = mixed(w * U(3) + c)
    own = mixed(table_w * U(3) + table_c)
    order = np.argsort(own)
    at = np.minimum(np.searchsorted(own[order], z), max(0, len(own) - 1))
    at = order[at] if len(own) else at
    return (table_w[at] == w) & (table_c[at] == c) if len(own) else np.zeros(len(w), bool)


def _segments(h: np.ndarray, n: int):
    b = _bucket(h, n)
    cut = np.flatnonzero(np.diff(b)) + 1
    edges = np.concatenate([[0], cut, [len(h)]]) if len(h) else np.zeros(1, np.int64)
    return [(int(b[i]), int(i), int(j)) for i, j in zip(edges[:-1], edges[1:])]


def _slice(h: np.ndarray, n: int, b: int) -> np.ndarray:
    """Of sorted h, the elements of bucket b."""
    own = _bucket(h, n)
    return h[np.searchsorted(own, b) : np.searchsorted(own, b, side="right")]


def _anchors(table: pa.Table, window: int, n: int) -> pa.Table:
    part = _Part(table, window)
    at, h = part.probes()
    blocks = np.unique(h[(at - part.words.starts[part.doc[at]]) % part.block == 0])
    order = np.argsort(h, kind="stable")
    h, ids = h[order], part.ids[part.doc[at]][order]
    same = h[1:] == h[:-1]
    several = np.unique(h[1:][same & (ids[1:] != ids[:-1])])
    distinct = h[np.concatenate([[True], ~same])] if len(h) else h
    rows = []
    for b, i, j in _segments(distinct, n):
        rows.append((b, (distinct[i:j] & LOW).astype(np.uint32).tobytes(), (_slice(blocks, n, b) & LOW).astype(np.uint32).tobytes(), (_slice(several, n, b) & LOW).astype(np.uint32).tobytes()))
    part_no = table.column("_part")[0].as_py()
    return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([part_no] * len(rows), pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3))], names=["bucket", "part", "probes", "blocks", "several"])


def _hits(table: pa.Table) -> pa.Table:
    """Of a bucket: fingerprints that are a block somewhere and are probed by several documents."""
    probes = [np.frombuffer(x, np.uint32) for x in table.column("probes").to_pylist()]
    distinct, n = np.unique(np.concatenate(probes), return_counts=True)
    hot = distinct[is_in(distinct, np.unique(joined(table.column("blocks"), np.uint32)))]
    n = n[np.searchsorted(distinct, hot)]
    hot = hot[(n > 1) | is_in(hot, np.unique(joined(table.column("several"), np.uint32)))]
    own = [p[is_in(p, hot)] for p in probes]
    keep = [i for i, x in enumerate(own) if len(x)]
    parts = table.column("part").take(pa.array(keep, pa.int64()))
    bucket = table.column("bucket")[0].as_py()
    return pa.table([parts.combine_chunks(), pa.array([bucket] * len(keep), pa.int32()), pa.array([own[i].tobytes() for i in keep], pa.binary())], names=["part", "bucket", "hits"])


_CANDIDATES = "bucket int, part int, ids binary, counts binary, windows binary, checks binary, several binary"


def _candidates(hits: pa.Table, docs: pa.Table, window: int, n: int) -> pa.Table:
    """A part's distinct windows around hits, each with the smallest id that holds it, ordered by id within a bucket.

    several: of those in that order, whether another document of the part holds the window too.
    """
    rows: list[tuple] = []
    if docs.num_rows and hits.num_rows:
        part = _Part(docs, window)
        at, h = part.probes()
        keys = np.sort(np.concatenate([(U(b) << U(32)) | np.frombuffer(x, np.uint32).astype(U) for b, x in zip(hits.column("bucket").to_pylist(), hits.column("hits").to_pylist())]))
        hit = np.zeros(len(part.words.hash) + 1, np.int64)
        hit[at[is_in((_bucket(h, n) << U(32)) | (h & LOW), keys)] + 1] = 1
        seen = np.cumsum(hit)
        ok, w = part.windows()
        # a hit at p lies within the windows that start at p - block ... p
        if len(w):
            ok &= seen[part.block + 1 : part.block + 1 + len(w)] > seen[: len(w)]
        at = np.flatnonzero(ok)
        w, c, ids = w[at], part.checks(at), part.ids[part.doc[at]]
        order = np.lexsort((ids, c, w))
        w, c, ids = w[order], c[order], ids[order]
        first = np.concatenate([[True], (w[1:] != w[:-1]) | (c[1:] != c[:-1])]) if len(w) else np.zeros(0, bool)
        group = np.cumsum(first) - 1
        several = np.bincount(group[1:][~first[1:] & (ids[1:] != ids[:-1])], minlength=int(first.sum())) > 0 if len(w) else first
        w, c, ids = w[first], c[first], ids[first]
        part_no = docs.column("_part")[0].as_py()
        for b, i, j in _segments(w, n):
            by = i + np.argsort(ids[i:j], kind="stable")
            own, counts = np.unique(ids[i:j], return_counts=True)
            rows.append((b, part_no, own.tobytes(), counts.astype(np.uint32).tobytes(), w[by].tobytes(), c[by].tobytes(), several[by].tobytes()))
    cols = list(zip(*rows)) if rows else [[]] * 7
    return pa.table([pa.array(c, t) for c, t in zip(cols, [pa.int32(), pa.int32()] + [pa.binary()] * 5)], names=[x.split()[0] for x in _CANDIDATES.split(", ")])


def _decide(table: pa.Table) -> pa.Table:
    """Of a bucket: each part's windows that a smaller id outside holds, and those to settle within the part."""
    w, c, several = (joined(table.column(k), t) for k, t in (("windows", U), ("checks", U), ("several", bool)))
    sizes = [len(x) // 8 for x in table.column("windows").to_pylist()]
    ids = np.concatenate([np.repeat(np.frombuffer(i, np.int64), np.frombuffer(k, np.uint32)) for i, k in zip(table.column("ids").to_pylist(), table.column("counts").to_pylist())])
    order = np.lexsort((ids, c, w))
    first = np.concatenate([[True], (w[order][1:] != w[order][:-1]) | (c[order][1:] != c[order][:-1])])
    least = np.empty_like(ids)
    least[order] = ids[order][first][np.cumsum(first) - 1]
    gone, within = least < ids, (least == ids) & several
    rows, at = [], 0
    for part, n in zip(table.column("part").to_pylist(), sizes):
        g, i = (at + np.flatnonzero(x[at : at + n]) for x in (gone, within))
        at += n
        if len(g) or len(i):
            rows.append((part, w[g].tobytes(), c[g].tobytes(), w[i].tobytes(), c[i].tobytes()))
    cols = list(zip(*rows)) if rows else [[]] * 5
    return pa.table([pa.array(x, t) for x, t in zip(cols, [pa.int32()] + [pa.binary()] * 4)], names=["part", "gone", "gone_checks", "within", "within_checks"])


def _strip(answers: pa.Table, docs: pa.Table, window: int, names: list[str], texts: bool) -> pa.Table:
    part = _Part(docs, window)
    gone, gone_c, within, within_c = (joined(answers.column(k), U) for k in ("gone", "gone_checks", "within", "within_checks"))
    ok, w = part.windows()
    drop = np.zeros(len(w), bool)
    maybe = np.flatnonzero(ok & (is_in(w, np.unique(gone)) | is_in(w, np.unique(within))))
    if len(maybe):
        mine, checks = w[maybe], part.checks(maybe)
        drop[maybe[_match(mine, checks, gone, gone_c)]] = True
        inside = np.flatnonzero(_match(mine, checks, within, within_c))
        if len(inside):
            iw, ic, ids = mine[inside], checks[inside], part.ids[part.doc[maybe[inside]]]
            order = np.lexsort((ids, ic, iw))
            iw, ic = iw[order], ic[order]
            head = np.concatenate([[True], (iw[1:] != iw[:-1]) | (ic[1:] != ic[:-1])])
            least = ids[order][head][np.cumsum(head) - 1]
            drop[maybe[inside[order[ids[order] > least]]]] = True
    n = len(part.words.hash)
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(drop)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    removed = np.cumsum(edge)[:n] > 0
    total = np.concatenate([[0], np.cumsum(removed)])
    n_removed = total[part.words.ends] - total[part.words.starts]
    digests, kept_texts, words, index = [], [], part.words.words, part.words.index
    own = docs.column("_text").to_pylist() if texts else None
    for d, (a, b) in enumerate(zip(part.words.starts.tolist(), part.words.ends.tolist())):
        mine = index[a:b]
        if n_removed[d]:
            mine = mine[~removed[a:b]]
        kept = b" ".join([words[i] for i in mine.tolist()])
        digests.append(hashlib.sha256(kept).hexdigest())
        if texts:
            kept_texts.append(kept.decode("utf-8") if n_removed[d] else own[d])
    made = [pa.array(part.words.counts, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())] + [pa.array(kept_texts, pa.string())] * texts
    return pa.table([*(docs.column(c) for c in names), *made], names=[*names, "n_words", "n_removed", "kept_sha256", *["_kept"] * texts])


def strip_repeats(df: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = 50, texts: bool = True, part_mb: int = 8) -> DataFrame:
    """df's columns, then n_words, n_removed, kept_sha256; with texts, text is what is kept, else it is left out.

    Columns of df that have the new names are replaced.
    """
    if window < 2 or window % 2:
        raise ValueError("window must be even")
    n = parts_for(df, text, part_mb)
    own = [c for c in df.columns if c != text and c not in ("n_words", "n_removed", "kept_sha256")]
    names = [f"_c{i}" for i in range(len(own))]
    docs = df.select(*(F.col(c).alias(x) for c, x in zip(own, names)), F.col(id_col).cast("long").alias("_id"), F.col(text).alias("_text"))
    buckets = max(BUCKETS, -(-n * part_mb // 64))
    by_part = dealt(docs, n, "_id", "_text").groupBy("_part")
    anchors = by_part.applyInArrow(lambda t: _anchors(t, window, buckets), "bucket int, part int, probes binary, blocks binary, several binary")
    hits = anchors.groupBy("bucket").applyInArrow(_hits, "part int, bucket int, hits binary")
    found = hits.groupBy("part").cogroup(by_part).applyInArrow(lambda a, b: _candidates(a, b, window, buckets), _CANDIDATES)
    answers = found.groupBy("bucket").applyInArrow(_decide, "part int, gone binary, gone_checks binary, within binary, within_checks binary")
    schema = docs.select(*names).schema.add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")
    if texts:
        schema = schema.add("_kept", "string")
    out = answers.groupBy("part").cogroup(by_part).applyInArrow(lambda a, b: _strip(a, b, window, names, texts), schema)
    back = {c: F.col(x).alias(c) for c, x in zip(own, names)} | ({text: F.col("_kept").alias(text)} if texts else {})
    return out.select(*(back[c] for c in df.columns if c in back), "n_words", "n_removed", "kept_sha256")
