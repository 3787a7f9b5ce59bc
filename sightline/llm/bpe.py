"""Byte-level BPE by a lazily determinised transducer, and streaming decoding.

A string's BPE encoding is the only way to write it as tokens whose every neighbouring pair encodes to
itself. So the encoding of a prefix is the encoding of a shorter prefix and one last token that goes
with that one's last token, and reading bytes from the left only the prefixes matter from which some
token may still be under way. The transducer's state is that set: for each such start the place in the
token trie and the token that ends at the start. A move gives the last token up to here; following last
tokens back gives the encoding. A state is built when a text first leads to it and its moves are kept,
so later texts only follow them. Lookahead is bounded: within a long piece, the tokens that all starts
still under way share are emitted every LOOKAHEAD bytes.

Decoding turns ids to bytes in blocks; a UTF-8 automaton passes on whole characters and carries the
bytes of an unfinished one to the next block.
"""
from __future__ import annotations

import base64
import gc
import hashlib
import sys
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import slices, trim
from .workspace import aside, small_batches

BLOCK = 1 << 20
#: Tokens are emitted at the latest after so many bytes; the longest token is far shorter.
LOOKAHEAD = 4096


class Transducer:
    """ranks: bytes -> id. Moves are kept for at most max_states states, then built anew."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 300_000):
        self.ranks, self.max_states = ranks, max_states
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.trie: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        self.depth: list[int] = [0]
        self.size = {i: len(b) for b, i in ranks.items()}
        self.longest = max(self.size.values(), default=1)
        for word, rank in ranks.items():
            at = 0
            for b in word:
                nxt = self.trie[at].get(b)
                if nxt is None:
                    nxt = self.trie[at][b] = len(self.trie)
                    self.trie.append({})
                    self.token_at.append(-1)
                    self.depth.append(self.depth[at] + 1)
                at = nxt
            # a token that merges never build stands only for a whole piece, never within one
            self.token_at[at] = rank
        self.goes: dict[tuple[int, int], bool] = {}
        self.sound: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        self.index: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: list[dict[int, tuple[int, tuple]]] = []
        self.start = self._state(((0, -1),))

    def merged(self, piece: bytes) -> list[int]:
        """The definition: join the neighbouring pair of lowest rank, again and again."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
            if best[0] == 1 << 60:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [self.ranks[p] for p in parts]

    def _fits(self, left: int, right: int) -> bool:
        if right not in self.sound:
            self.sound[right] = self.merged(self.bytes_of[right]) == [right]
        if not self.sound[right]:
            return False
        if left < 0:
            return True
        return self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]

    def _state(self, key: tuple) -> int:
        """key: (trie place, token that ends where this start begins, -1 at the very start), oldest start first."""
        found = self.index.get(key)
        if found is None:
            found = self.index[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
        return found

    def _move(self, state: int, byte: int) -> tuple[int, int]:
        """The next state, and the last token of the encoding up to here."""
        live, token, trie, token_at, goes = [], -1, self.trie, self.token_at, self.goes
        for place, last in self.states[state]:
            nxt = trie[place].get(byte)
            if nxt is None:
                continue
            if token < 0 and (t := token_at[nxt]) >= 0:
                ok = goes.get((last, t))
                if ok is None:
                    ok = goes[last, t] = self._fits(last, t)
                if ok:
                    token = t
            if trie[nxt]:
                live.append((nxt, last))
        live.append((0, token))
        found = self.moves[state][byte] = self._state(tuple(live)), token
        return found

    def _back(self, lasts: list[int], end: int) -> list[int]:
        out, size = [], self.size
        while end > 0:
            token = lasts[end - 1]
            out.append(token)
            end -= size[token]
        out.reverse()
        return out

    def _settled(self, lasts: list[int], state: int) -> list[int]:
        """Tokens that every encoding still under way begins with."""
        runs = [self._back(lasts, len(lasts) - self.depth[place]) for place, _ in self.states[state]]
        n = 0
        while all(len(r) > n and r[n] == runs[0][n] for r in runs):
            n += 1
        return runs[0][:n]

    def encode(self, piece: bytes) -> list[int]:
        if piece in self.ranks:
            return [self.ranks[piece]]
        if len(self.states) > self.max_states:
            self.reset()
        out: list[int] = []
        lasts: list[int] = []
        due = LOOKAHEAD
        state, moves, put = self.start, self.moves, lasts.append
        for byte in piece:
            found = moves[state].get(byte)
            if found is None:
                found = self._move(state, byte)
            state, token = found
            put(token)
            if len(lasts) >= due:
                done = self._settled(lasts, state)
                out += done
                del lasts[: sum(self.size[t] for t in done)]
                due = max(LOOKAHEAD, len(lasts) + self.longest)
        return out + self._back(lasts, len(lasts))


class Utf8:
    """Incremental UTF-8: feed() gives the whole characters so far, the rest waits."""

    def __init__(self):
        self.rest = b""

    def feed(self, data: bytes) -> str:
        data = self.rest + data
        cut = len(data)
        for back in range(1, min(4, len(data)) + 1):  # an unfinished character is at most three bytes
            b = data[-back]
            if b >= 0xC0:
                if back < (2 if b < 0xE0 else 3 if b < 0xF0 else 4):
                    cut -= back
                break
            if b < 0x80:
                break
        self.rest = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        out, self.rest = self.rest.decode("utf-8", "replace"), b""
        return out


def load_ranks(data: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


class Codec:
    """Whole texts to ids and back. Pieces met again are looked up in a bounded memory of the transducer's answers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_known: int = 300_000):
        import regex

        self.machine = Transducer(ranks)
        self.split, self.gap = regex.compile(pattern), regex.compile(r"(?<=\S) (?=\S)")
        self.known: dict[str, tuple] = {}
        self.max_known = max_known

    def blocks(self, text: str):
        """Cuts before a single space between other characters, where no match of the pattern spans."""
        at = 0
        while len(text) - at > BLOCK:
            found = self.gap.search(text, at + BLOCK)
            if not found:
                break
            yield text[at : found.start()]
            at = found.start()
        yield text[at:] if at else text

    def encode(self, text: str):
        """Arrays of ids, one a block of text."""
        known = self.known
        for block in self.blocks(text):
            if len(known) > self.max_known:
                known.clear()
            ids = array("I")
            for piece in self.split.findall(block):
                found = known.get(piece)
                if found is None:
                    found = self.machine.encode(piece.encode("utf-8"))
                    if len(piece) <= 64:
                        known[piece] = found
                ids.extend(found)
            yield ids

    def decode(self, ids, utf8: Utf8 | None = None):
        """Blocks of ids to blocks of text."""
        utf8, of = utf8 or Utf8(), self.machine.bytes_of
        for block in ids:
            yield utf8.feed(b"".join([of[i] for i in block]))
        yield utf8.finish()


def _codec(data: str, pattern: str) -> Codec:
    """One a Python worker: the transducer's states stay from task to task."""
    held = sys.modules.setdefault("_sightline_codecs", type(sys)("_sightline_codecs")).__dict__
    key = ("codec", hash(data), pattern)
    if key not in held:
        held[key] = Codec(load_ranks(data), pattern)
    return held[key]


def encode_documents(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: bool = True, keep_machine: bool = True) -> DataFrame:
    """df less its text, with token_ids (if ids), n_tokens, ids_sha256, decoded_sha256.

    vocabulary: the contents of a rank file, under 1 MB for 50,000 ranks; each task gets it. No exchange.
    keep_machine: Python workers keep the transducer's states (about 300 MB) from task to task.
    Null text is empty: no tokens, digests of nothing; an empty table gives an empty table. Other columns of df may have any names; those
    with the new names are replaced.
    """
    new = [("token_ids", T.ArrayType(T.IntegerType()))] * ids + [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    own, back = aside(df, text, *dict(new))
    width = len(own)
    inner = df.select(*own, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    schema = inner.drop("_text").schema
    for name, kind in new:
        schema = schema.add(name, kind)
    columns = schema.names
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    small_batches(df.sparkSession)

    def run(batches):
        codec = _codec(shared.value, pattern)
        for batch in (x for b in batches for x in slices(b, width)):
            trim()
            tokens, n, digests, plain_digests = array("I"), [], [], []
            for value in batch.column(width):
                raw, plain, count, utf8 = hashlib.sha256(), hashlib.sha256(), 0, Utf8()
                for block in codec.encode(value.as_py()):
                    raw.update(block.tobytes())
                    count += len(block)
                    plain.update(utf8.feed(b"".join([codec.machine.bytes_of[i] for i in block])).encode("utf-8"))
                    if ids:
                        tokens.extend(block)
                plain.update(utf8.finish().encode("utf-8"))
                n.append(count)
                digests.append(raw.hexdigest())
                plain_digests.append(plain.hexdigest())
            made = [pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(plain_digests, pa.string())]
            if ids:
                ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                made.insert(0, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(tokens, np.uint32).astype(np.int32) if len(tokens) else np.zeros(0, np.int32))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: width], *made], names=columns)
        if not keep_machine:
            del codec
            sys.modules.pop("_sightline_codecs", None)
            gc.collect()
            trim()

    return inner.mapInArrow(run, schema).select(*back, *dict(new))
