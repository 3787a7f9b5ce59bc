"""Records compared with those just before them, in blocks that hold those too: rows of words are exchanged once."""
from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .scanning import distinct_words

_HASH = re.compile("^[0-9a-fA-F]{16}$")
#: Share of words in common from which two readings are the same, and shares of the smaller one's.
SAME, CONTAINED, RELATED_CONTAINED, SURE = 0.70, 0.85, 0.60, 0.30


def dealer(starts: dict, ahead: dict, schema: pa.Schema):
    """library, id, text, figures, confidence, hash -> the records with their words, in their block and, if the next block compares with them, there too.

    starts: of each library the first id of each block; ahead: of each library and block the first id that it compares with."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, blocks, own = [], [], []
            for i, (library, id_) in enumerate(zip(batch.column("library").to_pylist(), batch.column("id").to_pylist())):
                block = bisect_right(starts[library], id_) - 1
                rows.append(i), blocks.append(block), own.append(True)
                if (first := ahead.get((library, block + 1))) is not None and id_ >= first:
                    rows.append(i), blocks.append(block + 1), own.append(False)
            rows = pa.array(rows, pa.int64())
            have = {"words": distinct_words(batch.column("text"))} | {c: batch.column(c) for c in ("library", "id", "figures", "confidence", "hash")}
            have = {c: x.take(rows) for c, x in have.items()} | {"block": pa.array(blocks, pa.int64()), "own": pa.array(own, pa.bool_())}
            yield pa.RecordBatch.from_arrays([have[f.name].cast(f.type) for f in schema], schema=schema)

    return deal


def _sets(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Of texts parted by blanks: numbers of the words, where each text's begin (and the end), how many distinct words there are."""
    at, flat = lists.offsets.to_numpy(), lists.flatten().dictionary_encode()
    return flat.indices.to_numpy(zero_copy_only=False), at - at[0], max(len(flat.dictionary), 1)


def _common(codes: np.ndarray, at: np.ndarray, of: np.ndarray, mark: np.ndarray, lo: int, j: int) -> np.ndarray:
    """How many words each text from lo to j has in common with text j. of: the text of each word."""
    own = codes[at[j] : at[j + 1]]
    mark[own] = True
    hits = np.flatnonzero(mark[codes[at[lo] : at[j]]])
    mark[own] = False
    return np.bincount(of[at[lo] + hits] - lo, minlength=j - lo)


def comparer(last: int, related: float, look: int, schema: pa.Schema):
    """A block's records -> of each of its own: id, again_of, shares_text, same_look; decisions are those of finding.compare_readings."""

    def compare(block: pa.Table) -> pa.Table:
        block = block.take(pc.sort_indices(block["id"])).combine_chunks()
        column = lambda c: pa.concat_arrays(block[c].chunks)
        sure = column("confidence")
        sure = (pc.fill_null(pc.or_(pc.greater_equal(sure, SURE), pc.is_nan(sure)), False)).to_numpy(zero_copy_only=False)
        lists = pc.ascii_split_whitespace(column("words"))
        long = pc.greater_equal(pc.utf8_length(lists.flatten()), 2).to_numpy(zero_copy_only=False)
        begin = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        counted = np.concatenate([[0], np.cumsum(long)])
        place = np.flatnonzero(sure & (counted[begin[1:]] - counted[begin[:-1]] >= 3))  # others abstain
        kept = pa.array(place)
        codes, at, n_codes = _sets(lists.take(kept))
        n, of, mark = np.diff(at), np.repeat(np.arange(len(place)), np.diff(at)), np.zeros(n_codes, bool)
        figures = pc.ascii_split_whitespace(column("figures")).take(kept)
        figures = pc.if_else(pc.equal(column("figures").take(kept), ""), pa.scalar([], figures.type), figures)
        f_codes, f_at, f_n = _sets(figures)
        nf, f_of, f_mark = np.diff(f_at), np.repeat(np.arange(len(place)), np.diff(f_at)), np.zeros(f_n, bool)
        hashes = column("hash").take(kept).to_pylist()
        good = np.array([h is not None and bool(_HASH.match(h)) for h in hashes], bool)
        bits = np.array([int(h[:16], 16) if g else 0 for h, g in zip(hashes, good)], np.uint64)
        first, own = np.searchsorted(place, place - last), column("own").to_numpy(zero_copy_only=False)
        again, shares, looks = np.full(len(block), -1), np.zeros(len(block), np.int64), np.zeros(len(block), np.int64)
        for j in np.flatnonzero(own[place] & (first < np.arange(len(place)))):
            lo = first[j]
            both = _common(codes, at, of, mark, lo, j)
            overlap, contained = both / (n[lo:j] + n[j] - both), both / np.minimum(n[lo:j], n[j])
            words = (overlap >= SAME) | ((contained >= CONTAINED) & (overlap >= related))
            if nf[j] >= 3 and (words & (nf[lo:j] >= 3)).any():
                some = _common(f_codes, f_at, f_of, f_mark, lo, j)
                words &= ~((nf[lo:j] >= 3) & (some / (nf[lo:j] + nf[j] - some) < 0.5))
            known = good[lo:j] & good[j]
            close = known & (np.bitwise_count(bits[lo:j] ^ bits[j]) <= look)
            same = words & (close | ~known)
            b = place[j]
            looks[b] = (close & ~words).sum()
            shares[b] = (words & ~same).sum() + (~words & ~close & ((overlap >= related) | (contained >= RELATED_CONTAINED))).sum()
            if same.any():
                again[b] = place[lo + np.flatnonzero(same)[-1]]
        mine = np.flatnonzero(own)
        ids = column("id")
        found = pa.array(again[mine], mask=again[mine] < 0)
        out = [ids.take(pa.array(mine)), ids.take(found), pa.array(shares[mine]), pa.array(looks[mine])]
        return pa.Table.from_arrays([x.cast(f.type) for x, f in zip(out, schema)], schema=schema)

    return compare
