"""Periodic run detection: repeated k-gram masking, then Main-Lorentz on what survives.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), at least
max(min_length, exponent * q) words long, that no neighbouring word extends with period q. All but q of
its words come again q words away, so each k-gram of a run, with k the least overlap
max(min_length, exponent * q) - q over all q (5 for the defaults), occurs twice in the document. Words
that no such repeated k-gram covers can't be part of a run and are masked. K-grams are compared by a
64-bit hash; a clash leaves words in, it never takes any out, so the result is exact.

Each stretch of surviving words is halved again and again (Main-Lorentz). A run that crosses a middle
reaches a whole period to its right or to its left, so for every period the longest common extensions
of the middle and the place a period away, forwards and backwards, give its ends. Extensions come from
exact ids of 1, 2, 4, ... words, built by doubling; the nodes of one depth, of all documents of a slice,
are done together. A stretch of m words takes O(m log^2 m) time and 4 m log2(m) bytes; documents are
taken in slices of 4 MB of text, and a longer one alone.

Every row is worked on by itself: nothing is shuffled, and rows may repeat or lack an id. Null and empty
texts have no words: no runs, an empty collapsed text. Columns of the input come back as they are, save
that ones with the names of the results are replaced. An empty table gives an empty table.
"""
from __future__ import annotations

import hashlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from .text import Rolling, U, Words, mixed, slices, window_starts
from .workspace import small_batches

WORD = r"[^\x20\x09-\x0D]+"
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def least_overlap(min_length: int, exponent: int) -> int:
    """Words that any run has in common with itself moved by its period."""
    return min(max(min_length, exponent * q) - q for q in range(1, min_length + 1))


def survivors(words: Words, k: int) -> np.ndarray:
    """Per word: whether a k-gram covers it that occurs twice in its document."""
    n = len(words.hash)
    out = np.zeros(n, bool)
    at = np.flatnonzero(window_starts(words, k)) if n >= k else np.zeros(0, np.int64)
    if not len(at):
        return out
    own = mixed(Rolling(words.hash).of(k)[at] + mixed(words.doc_of()[at].astype(U) + U(1)))
    order = np.argsort(own, kind="stable")
    same = own[order][1:] == own[order][:-1]
    twice = np.zeros(len(at) + 1, bool)
    twice[:-1][1:] = same
    twice[:-1][:-1] |= same
    first = at[order[twice[:-1]]]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, first, 1)
    np.add.at(cover, first + k, -1)
    return np.cumsum(cover[:n]) > 0


class Extensions:
    """Longest common extensions of places in x, exactly: ids of the 2**j values that start at each place."""

    def __init__(self, x: np.ndarray, longest: int):
        self.ids = [np.unique(x, return_inverse=True)[1].astype(np.int32)]
        while 2 << (len(self.ids) - 1) <= longest:
            last, step = self.ids[-1].astype(np.int64), 1 << (len(self.ids) - 1)
            pair = last[:-step] * (int(last.max()) + 1) + last[step:]
            self.ids.append(np.unique(pair, return_inverse=True)[1].astype(np.int32))

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many values from i on equal those from j on (i < j)."""
        n = np.zeros(len(i), np.int64)
        for k in range(len(self.ids) - 1, -1, -1):
            ids, last = self.ids[k], len(self.ids[k]) - 1
            b = j + n
            n += ((b <= last) & (ids[np.minimum(i + n, last)] == ids[np.minimum(b, last)])).astype(np.int64) << k
        return n

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many values up to and with i equal those up to and with j (i < j)."""
        n = np.zeros(len(i), np.int64)
        for k in range(len(self.ids) - 1, -1, -1):
            ids, last = self.ids[k], len(self.ids[k]) - 1
            a, b = i - n - (1 << k) + 1, j - n - (1 << k) + 1
            n += ((a >= 0) & (ids[np.clip(a, 0, last)] == ids[np.clip(b, 0, last)])).astype(np.int64) << k
        return n


def main_lorentz(x: np.ndarray, low: np.ndarray, high: np.ndarray, min_length: int, exponent: int) -> np.ndarray:
    """Runs (start, end, period) of the stretches [low, high) of x, which a value of its own ends each; sorted by start, then period."""
    found = [np.zeros((0, 3), np.int64)]
    ext = Extensions(x, int((high - low).max())) if len(low) else None
    while len(low):
        keep = high - low >= min_length
        low, high = low[keep], high[keep]
        mid, most = (low + high) // 2, (high - low) // exponent
        q = np.arange(int(most.sum())) - np.repeat(np.cumsum(most) - most, most) + 1
        m, lo, hi = np.repeat(mid, most), np.repeat(low, most), np.repeat(high, most)
        for side in (0, 1):  # a whole period to the right of the middle, or to its left
            ok = (m + q < hi) if side == 0 else (m - q >= lo)
            a = m[ok] if side == 0 else (m - q)[ok]
            p = q[ok]
            ends, starts = a + p + ext.forward(a, a + p), a - ext.backward(a - 1, a + p - 1)
            good = ends - starts >= np.maximum(min_length, exponent * p)
            found.append(np.stack([starts[good], ends[good], p[good]], axis=1))
        low, high = np.concatenate([low, mid]), np.concatenate([mid, high])
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)  # equal ends: multiples of the smallest period
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[first]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def runs_of(words: Words, min_length: int, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs (start, end, period) in word numbers of all documents one after another, and the document of each."""
    at = np.flatnonzero(survivors(words, least_overlap(min_length, exponent)))
    if not len(at):
        return np.zeros((0, 3), np.int64), np.zeros(0, np.int64)
    doc = words.doc_of()
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (doc[at][1:] != doc[at][:-1])
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(at)))
    long = size >= min_length
    at, begin, size = at[np.repeat(long, size)], begin[long], size[long]
    if not len(size):
        return np.zeros((0, 3), np.int64), np.zeros(0, np.int64)
    high = np.cumsum(size + 1) - 1
    low = high - size
    x = np.empty(int(high[-1]) + 1, np.int64)
    ends = np.zeros(len(x), bool)
    ends[high] = True
    x[~ends], x[ends] = words.index[at], len(words.words) + np.arange(len(high))
    runs = main_lorentz(x, low, high, min_length, exponent)
    part = np.searchsorted(high, runs[:, 0])
    moved = at[np.cumsum(size) - size] - low  # from places in x to word numbers
    runs[:, 0] += moved[part]
    runs[:, 1] += moved[part]
    return runs, doc[runs[:, 0]]


def strongest(runs: np.ndarray) -> tuple[int, int, int] | None:
    """(start, length, period) of greatest exact length / period; ties: smallest start, then period."""
    if not len(runs):
        return None
    share = (runs[:, 1] - runs[:, 0]) / runs[:, 2]
    near = runs[share == share.max()]  # rounding keeps order, so the greatest is among these
    s, e, q = min(near.tolist(), key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2]))
    return s, e - s, q


def _sha(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


def _run(schema: pa.Schema, kept: list[str], text: str, min_length: int, exponent: int, texts: bool):
    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(batch.column(batch.schema.get_field_index(text)))
        runs, doc = runs_of(words, min_length, exponent)
        cut = np.searchsorted(doc, np.arange(batch.num_rows + 1))
        gone = np.zeros(len(words.index) + 1, np.int64)
        np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
        np.add.at(gone, runs[:, 1], -1)
        stays = np.cumsum(gone[:-1]) == 0
        listed, best, digest, joined = [], [], [], []
        for d in range(batch.num_rows):
            a, b = int(words.starts[d]), int(words.ends[d])
            own = runs[cut[d] : cut[d + 1]].copy()
            own[:, :2] -= a
            index = words.index[a:b]
            if len(own):
                index = index[stays[a:b]]
            joined.append(b" ".join([words.words[i] for i in index.tolist()]))
            rows = [(s, e - s, q) for s, e, q in own.tolist()]
            listed.append(rows)
            best.append(strongest(own))
            digest.append(_sha(b"".join(b"%d,%d,%d\n" % r for r in rows)))
        long = lambda k: pa.array([None if r is None else r[k] for r in best], pa.int64())
        made = {
            "n_words": pa.array(words.counts, pa.int64()), "n_runs": pa.array(np.diff(cut), pa.int64()), "start": long(0), "length": long(1), "period": long(2),
            "exponent_milli": pa.array([None if r is None else 1000 * r[1] // r[2] for r in best], pa.int64()),
        }
        if texts:
            made["runs"] = pa.array([[dict(zip(("start", "length", "period"), r)) for r in rows] for rows in listed], schema.field("runs").type)
            made["collapsed"] = pa.array([x.decode() for x in joined], pa.string())
        else:
            made["runs_sha256"] = pa.array(digest)
            made["collapsed_sha256"] = pa.array([_sha(x) for x in joined], pa.string())
        return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), *(made[f.name] for f in list(schema)[len(kept) :])], names=schema.names)

    def run(batches):
        for batch in batches:
            for piece in slices(batch, batch.schema.get_field_index(text)):
                yield of(piece)

    return run


def periodic_runs(df: DataFrame, text: str = "text", min_length: int = 6, exponent: int = 4, texts: bool = True) -> DataFrame:
    """The rows with n_words, n_runs, the strongest run (start, length, period, exponent_milli: 1000 length / period, floored; nulls without
    a run), and either runs (all, by start, then period) and collapsed (the words that stay, joined by one space), or with texts=False
    the SHA-256 of both: runs_sha256 over `start,length,period` lines, collapsed_sha256.

    A word stays unless a run contains it after that run's first period.
    """
    if exponent < 2 or min_length < 2:
        raise ValueError("a run has at least two words and two periods")
    small_batches(df.sparkSession)
    last = f"runs {RUNS}, collapsed string" if texts else "runs_sha256 string, collapsed_sha256 string"
    made = StructType.fromDDL(f"n_words long, n_runs long, start long, length long, period long, exponent_milli long, {last}")
    kept = [f for f in df.schema if f.name not in made.names]
    out = StructType([*kept, *made])
    carried = df.select(*(F.col(f"`{f.name}`") for f in kept), *([] if text not in made.names else [F.col(f"`{text}`")]))
    schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in out])
    return carried.mapInArrow(_run(schema, [f.name for f in kept], text, min_length, exponent, texts), out)


def with_periods(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each row whose crc32(decimal id) is divisible by ten, the words from a on are replaced by repeats of the p words at a, where
    n is the number of words, g = crc32 / 10 floored, a = g % n and p = 1 + floor((n - a) / (3 + g % 8)). Other rows, rows without an id and
    rows without words stay as they are."""
    h = F.crc32(F.col(id_col).cast("string"))
    words = F.when(h % 10 == 0, F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)))
    g, n = F.floor(h / 10), F.size("_words").cast("long")
    rest = F.col("_n") - F.col("_a")
    block = F.slice("_words", (F.col("_a") + 1).cast("int"), F.col("_p").cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(block, F.ceil(rest / F.col("_p")).cast("int"))), F.lit(1), rest.cast("int"))
    own = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"), words.alias("_words"), g.alias("_g"), F.col(f"`{text}`").alias("_text"))
    own = own.withColumn("_n", n).withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n"))).withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8)))
    new = F.when(F.col("_a").isNotNull(), F.array_join(F.concat(F.slice("_words", F.lit(1), F.col("_a").cast("int")), tail), " ")).otherwise(F.col("_text"))
    return own.select(*((new.alias(c) if c == text else F.col(f"_row.`{c}`").alias(c)) for c in df.columns))
