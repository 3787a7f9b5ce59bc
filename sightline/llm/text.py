"""Words of many texts at once, as numpy arrays."""
from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
#: An odd multiplier of rolling hashes, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)


def trim() -> None:
    """Gives freed memory back, so that a Python worker doesn't keep its largest task's; from then on arrays of 8 MB
    and more get pages of their own, which go back as soon as they are freed."""
    pa.default_memory_pool().release_unused()
    try:
        lib = ctypes.CDLL("libc.so.6")
        lib.mallopt(-3, 8 << 20)  # M_MMAP_THRESHOLD, which otherwise grows with use
        lib.malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def slices(batch: pa.RecordBatch, column: int, limit: int = 4 << 20):
    """The batch in runs of rows with about `limit` bytes of text at most, so that arrays over its words stay small."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        done = int(size[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(size, done + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end


def coded_words(texts, lower: bool = False) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of all texts, and how many each text has."""
    trim()
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    if texts.offset:  # ascii_lower misreads what a cast makes of a slice, so the slice is copied first
        texts = texts.take(pa.array(np.arange(len(texts))))
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.ascii_lower(texts)
    parts = pc.ascii_split_whitespace(texts)
    flat = parts.flatten()
    real = pc.not_equal(pc.binary_length(flat), 0)
    per = np.diff(np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False).astype(np.int64))])[parts.offsets.to_numpy()]) if len(parts) else np.zeros(0, np.int64)
    return flat.filter(real).dictionary_encode(), per


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of texts: hash[i] of word i, ends[d] the end of document d's words."""

    def __init__(self, texts, lower: bool = False, seed: int = 0):
        coded, per = coded_words(texts, lower)
        self.index = coded.indices.to_numpy(zero_copy_only=False)
        self.words = coded.dictionary.cast(pa.large_binary()).to_pylist()
        self.hash = self.hashes(seed)
        self.counts = per
        self.ends = np.cumsum(per)
        self.starts = self.ends - per

    def hashes(self, seed: int) -> np.ndarray:
        own = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in self.words), U, len(self.words))
        return own[self.index] if len(own) else np.zeros(0, U)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


class Rolling:
    """Hashes of k consecutive words, for any k; those that span two documents mean nothing."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        power = np.full(n + 1, BASE, U)
        power[0] = 1
        self.down = np.full(n + 1, UNBASE, U)
        self.down[0] = 1
        np.cumprod(power, out=power)
        np.cumprod(self.down, out=self.down)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(hashes * power[:n], out=self.sums[1:])

    def of(self, k: int) -> np.ndarray:
        n = len(self.sums) - 1
        if n < k:
            return np.zeros(0, U)
        return mixed((self.sums[k:] - self.sums[: n - k + 1]) * self.down[: n - k + 1] + U(k))


def window_starts(words: Words, k: int) -> np.ndarray:
    """Of every word but the last k - 1: whether k words of one document start there."""
    n = len(words.hash)
    if n < k:
        return np.zeros(0, bool)
    ok = np.zeros(n + 1, np.int64)
    long = words.counts >= k
    np.add.at(ok, words.starts[long], 1)
    np.add.at(ok, words.ends[long] - k + 1, -1)
    return np.cumsum(ok)[: n - k + 1] > 0


def is_in(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """keys in table (sorted): a bit table first, then a search for the few that pass."""
    out = np.zeros(len(keys), bool)
    if not len(table) or not len(keys):
        return out
    bits = max(12, int(len(table)).bit_length() + 3)
    mask = keys.dtype.type((1 << min(bits, 26)) - 1)
    seen = np.zeros(int(mask) + 1, bool)
    seen[(table & mask).astype(np.int64)] = True
    maybe = np.flatnonzero(seen[(keys & mask).astype(np.int64)])
    at = np.minimum(np.searchsorted(table, keys[maybe]), len(table) - 1)
    out[maybe] = table[at] == keys[maybe]
    return out


def joined(column, kind) -> np.ndarray:
    """The arrays that a binary column holds, one after another."""
    return np.frombuffer(b"".join(column.to_pylist()), kind)
