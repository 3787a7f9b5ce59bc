"""Language-model scoring with a hierarchical Pitman-Yor model.

Restaurants form three levels. A context is the word before a token, hashed into one of `contexts`
restaurants (the start of a text has its own): its customers are the tokens met after it, and its tables
are customers of its class, a restaurant that `per_class` contexts share as their parent; the tables of
classes are customers of the root, and the root's own tables draw from a uniform base over the vocabulary
and one unknown word. So the totals of all restaurants, which every task needs, are vectors of fixed
length whatever the corpus, while dishes and their counts grow with it. The common words of a corpus have
a restaurant nearly to themselves; rare ones share theirs.

Counts of (context, word) are gathered from all training texts into buckets by word; a bucket then
holds whole dishes: a word's customers in every context, class and the root. Seating is sampled by Gibbs,
a dish at a time: given the tables of all restaurants, customers of a dish are seated anew one by one
(beyond the 64th in growing blocks within which the odds are held). A dish draws from random numbers of
its own, by its word, context and sweep, so neither partitions nor the order of rows change a score.
Buckets sample at the same time; the restaurants' totals are brought together after each sweep, so a
dish's own old tables still count in its odds: the step is an approximation of single-site Gibbs. After
the burn-in, sweeps are kept as samples, and a text's probability takes each token's predictive
probability averaged over the samples.

For scoring, texts are dealt into parts. A part asks the buckets once for each of its distinct words
and (context, word) pairs and gets counts and probabilities back in the same order. Logarithms travel as
whole numbers of 2 ** -26, so a token's is exact to 8e-9. A part sends at most one row to a bucket, and
there are `BUCKETS` of them until one would hold the pairs of over 8 MB of text; up to there rows grow with the
parts, beyond it a row gets smaller as they grow, and there are never more rows than pairs.

A-Z is lower-cased; tokens are words and one end. Null text is empty: only the end. Documents whose
crc32(id as text) mod 7 is 2 are held out; a null id is not held out. Repeated rows count as often as
they occur and are dealt over parts like others. Without training documents N and V are 0.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import U, coded_words, mixed, slices, trim
from .workspace import Workspace, dealt, parts_for

END = U(0x5EED0E0D5EED0E0D)
SINGLE = 64
BUCKETS, STEP = 128, float(1 << 26)


class Model:
    """Fixed settings, and the totals that the sweeps share."""

    def __init__(self, contexts: int = 1 << 15, per_class: int = 64, discount: float = 0.75, strength: float = 1.0, class_discount: float = 0.6, class_strength: float = 1.0, root_discount: float = 0.5, root_strength: float = 1.0):
        if contexts % per_class or contexts > 1 << 15:
            raise ValueError("contexts must be a multiple of per_class, and at most 32768")
        self.contexts, self.per_class = contexts, per_class
        self.classes = contexts // per_class + 1  # the last one is the start's
        self.d, self.s, self.d2, self.s2, self.d1, self.s1 = discount, strength, class_discount, class_strength, root_discount, root_strength
        self.n = self.v = 0
        self.customers = np.zeros(contexts + 1)
        self.samples: list[Totals] = []

    def root(self, c1, t1, totals: Totals):
        all_customers = self.s1 + totals.classes.sum()
        return (c1 - self.d1 * t1) / all_customers + (self.s1 + self.d1 * totals.root) / all_customers / (self.v + 1)

    def grouped(self, g, c2, t2, p1, totals: Totals):
        """The probability in class g."""
        return (c2 - self.d2 * t2 + (self.s2 + self.d2 * totals.classes[g]) * p1) / (self.s2 + totals.in_class(self)[g])

    def known(self, u, c, t, p2, totals: Totals):
        """The probability in context u."""
        return (c - self.d * t + (self.s + self.d * totals.contexts[u]) * p2) / (self.s + self.customers[u])


class Totals:
    """Of one seating: the tables of each context, of each class and of the root."""

    def __init__(self, contexts: np.ndarray, classes: np.ndarray, root: float):
        self.contexts, self.classes, self.root = contexts, classes, root

    def in_class(self, model: Model) -> np.ndarray:
        """Customers of each class: the tables of its contexts."""
        return np.bincount(np.arange(model.contexts + 1) // model.per_class, self.contexts, model.classes)


def _draws(seed: np.ndarray, turn: int) -> np.ndarray:
    """Uniform numbers in (0, 1), each from its seed and turn alone."""
    return (mixed(seed * U(0x9E3779B97F4A7C15) + U((turn + 1) * 0xD1B54A32D192ED03 % (1 << 64))) >> U(11)).astype(np.float64) / (1 << 53) + 2.0**-54


def _binomial(x: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The x-quantile of a binomial: by its distribution function, or for a wide one by its normal form."""
    out = np.zeros(len(n), np.int64)
    wide = (n * p * (1 - p) > 30) | (n > 200)
    at = np.flatnonzero(wide)
    if len(at):
        z = np.sqrt(2) * _erfinv(2 * x[at] - 1)
        out[at] = np.clip(np.rint(n[at] * p[at] + z * np.sqrt(n[at] * p[at] * (1 - p[at]))), 0, n[at]).astype(np.int64)
    at = np.flatnonzero(~wide)
    if len(at):
        term = (1 - p[at]) ** n[at]
        below, k, left = term.copy(), np.zeros(len(at), np.int64), np.arange(len(at))
        while True:
            left = left[(below[left] < x[at[left]]) & (k[left] < n[at[left]])]
            if not len(left):
                break
            who = at[left]
            term[left] *= (n[who] - k[left]) / (k[left] + 1) * p[who] / (1 - p[who])
            k[left] += 1
            below[left] += term[left]
        out[at] = k
    return out


def _erfinv(y: np.ndarray) -> np.ndarray:
    """To four digits, which is enough for a seat among hundreds."""
    log = np.log1p(-y * y)
    a = 2 / (np.pi * 0.147) + log / 2
    return np.sign(y) * np.sqrt(np.sqrt(a * a - log / 0.147) - a)


def seated(seed: np.ndarray, turn: int, c: np.ndarray, new: np.ndarray, d: float) -> np.ndarray:
    """Tables for c customers of a dish: each next one opens a table with odds new : (customers - d * tables)."""
    t = np.minimum(c, 1).astype(np.int64)
    at = np.flatnonzero(c > 1)
    done, k = 1, turn << 20
    while len(at):
        step = 1 if done < SINGLE else done // 16
        left = np.minimum(c[at] - done, step)
        p = new[at] / (done - d * t[at] + new[at])
        x = _draws(seed[at], k)
        t[at] += x < p if step == 1 else _binomial(x, left, p)
        done += step
        k += 1
        at = at[c[at] > done]
    return t


def _tokens(table, contexts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """How many tokens each text has, each text's end after its words; all texts' distinct words in order, and of each
    token the word's place among them and the context. Hashes and contexts are made once a distinct word."""
    coded, per = coded_words(table.column("_text"), lower=True)
    texts = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)  # bytes by the row; to_pylist takes ten times as long
    words, place = np.unique(np.append(np.fromiter(map(xxhash.xxh3_64_intdigest, texts), U, len(texts)), END), return_inverse=True)
    counts = per + 1
    ends = np.cumsum(counts)
    is_word = np.ones(int(ends[-1]) if len(ends) else 0, bool)
    is_word[ends - 1] = False
    word = np.full(len(is_word), place[-1])
    word[is_word] = place[coded.indices.to_numpy(zero_copy_only=False)]
    context = np.empty(len(word), np.uint16)
    context[1:] = (mixed(words + U(77)) % U(contexts)).astype(np.uint16)[word[:-1]]
    context[ends - counts] = contexts
    return counts, words, word, context


def _pairs(words: np.ndarray, word: np.ndarray, context: np.ndarray, places: bool = False):
    """The pairs each word has, each pair's context and count; with places, the pair of each token."""
    keys, *pair, count = np.unique(word << 16 | context, return_inverse=places, return_counts=True)
    return np.bincount(keys >> 16, minlength=len(words)), (keys & 0xFFFF).astype(np.uint16), count, *pair


def _bucket(w: np.ndarray, n: int) -> np.ndarray:
    return ((w >> U(32)) * U(n)) >> U(32)


def _cuts(words: np.ndarray, per: np.ndarray, n: int):
    """(bucket, words from, to, pairs from, to)"""
    b = _bucket(words, n)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(b)) + 1, [len(words)]]) if len(words) else np.zeros(1, np.int64)
    p = np.concatenate([[0], np.cumsum(per)])
    return [(int(b[i]), int(i), int(j), int(p[i]), int(p[j])) for i, j in zip(edges[:-1], edges[1:])]


def _gather(contexts: int, n: int):
    def run(batches):
        for batch in (x for b in batches for x in slices(b, 0, 4 << 20)):
            if batch.num_rows:
                _, words, word, context = _tokens(batch, contexts)
                per, u, c = _pairs(words, word, context)
                cuts = _cuts(words, per, n)
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in cuts], pa.int32()), *(pa.array(v, pa.binary()) for v in zip(*((words[i:j].tobytes(), _narrow(per[i:j]), u[p:q].astype(np.uint16).tobytes(), _narrow(c[p:q])) for _, i, j, p, q in cuts)))], names=["bucket", "words", "per", "contexts", "counts"])

    return run


def _cat(table, name, kind):
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def _narrow(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest takes, which the first byte tells."""
    kind = next(k for k in "BHIQ" if int(x.max(initial=0)) <= np.iinfo(k).max)
    return kind.encode() + x.astype(kind).tobytes()


def _widened(data: bytes) -> np.ndarray:
    return np.frombuffer(data, chr(data[0]), offset=1).astype(np.int64)


def _wide(table, name) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *map(_widened, table.column(name).to_pylist())])


STATE = "bucket int, words binary, per binary, contexts binary, counts binary, tables binary, groups binary, roots binary"


def _row(bucket, words, per, u, c, tables, groups, roots):
    """tables, groups and roots: the kept samples and, last, the current seating, one after another; all numbers in as few bytes as they need."""
    join = lambda xs: _narrow(np.concatenate(xs)) if len(xs) else b""
    return [bucket, words.tobytes(), _narrow(per), u.astype(np.uint16).tobytes(), _narrow(c), join(tables), join(groups), join(roots)]


def _table(rows):
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in STATE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for v, (_, k) in zip(zip(*rows) if rows else [[]] * len(fields), fields)], names=[f for f, _ in fields])


class Dishes:
    """A bucket's dishes: word of, context and class of each pair, and where words and their classes start."""

    def __init__(self, model: Model, row: dict):
        self.words, self.per = np.frombuffer(row["words"], U), _widened(row["per"])
        self.u, self.c = np.frombuffer(row["contexts"], np.uint16).astype(np.int64), _widened(row["counts"])
        self.starts = np.cumsum(self.per) - self.per
        self.of = np.repeat(np.arange(len(self.words)), self.per)
        g = self.u // model.per_class
        first = np.concatenate([[True], (self.of[1:] != self.of[:-1]) | (g[1:] != g[:-1])]) if len(g) else np.zeros(0, bool)
        self.group_starts = np.flatnonzero(first)  # contexts rise within a word, so classes do
        self.g, self.group_of, self.word_of_group = g[first], np.cumsum(first) - 1, self.of[first]
        self.root_starts = np.searchsorted(self.word_of_group, np.arange(len(self.words)))
        if row["tables"]:
            self.tables, self.groups, self.roots = (_widened(row[k]).reshape(-1, n) for k, n in (("tables", len(self.u)), ("groups", len(self.g)), ("roots", len(self.words))))

    def group_customers(self, tables):
        return np.add.reduceat(tables, self.group_starts, axis=-1)

    def root_customers(self, groups):
        return np.add.reduceat(groups, self.root_starts, axis=-1)


def _summed(pieces: list) -> list:
    """(words, contexts, counts) of the distinct pairs of all pieces, in order."""
    w, u, c = (np.concatenate(x) for x in zip(*pieces))
    order = np.lexsort((u, w))
    w, u, c = w[order], u[order], c[order]
    at = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (u[1:] != u[:-1])]))
    return [(w[at], u[at], np.add.reduceat(c, at))]


def _merge(model: Model, held: int = 1 << 21):
    """Rows in the order of buckets -> a row a bucket. A common word's bucket gets a row with it from every piece of the
    corpus, so pairs are summed whenever over `held` of them have come since, and memory doesn't grow with the pieces."""

    def whole(bucket, pieces):
        ((w, u, c),) = _summed(pieces)
        words, per = np.unique(w, return_counts=True)
        row = _row(bucket, words, per, u, c, [], [], [])
        dishes = Dishes(model, dict(zip((x.split()[0] for x in STATE.split(", ")), row)))
        row[5:] = (_narrow(np.ones(n, np.int64)) for n in (len(u), len(dishes.g), len(words)))
        trim()
        return _table([row])

    def run(batches):
        bucket, pieces, new = None, [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != bucket:
                    if pieces:
                        yield whole(bucket, pieces)
                    bucket, pieces, new = row["bucket"], [], 0
                u = np.frombuffer(row["contexts"], np.uint16)
                pieces.append((np.repeat(np.frombuffer(row["words"], U), _widened(row["per"])), u, _widened(row["counts"])))
                new += len(u)
                if new > max(held, 2 * len(pieces[0][0])):
                    pieces, new = _summed(pieces), 0
        if pieces:
            yield whole(bucket, pieces)

    return run


def _sweep(model: Model, totals: Totals, turn: int, keep: bool):
    """One Gibbs sweep over the dishes of each bucket; keep: the seating before it stays as a sample."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                x = Dishes(model, row)
                old, was, roots = x.tables[-1], x.groups[-1], x.roots[-1]
                p1 = model.root(x.root_customers(was), roots, totals)
                p2 = model.grouped(x.g, x.group_customers(old), was, p1[x.word_of_group], totals)
                seed = lambda of, k: mixed(x.words[of] + U(1)) + k.astype(U)
                now = seated(seed(x.of, x.u), 3 * turn, x.c, ((model.s + model.d * totals.contexts)[x.u] * p2[x.group_of]), model.d)
                c2 = x.group_customers(now)
                group = seated(seed(x.word_of_group, x.g), 3 * turn + 1, c2, (model.s2 + model.d2 * totals.classes)[x.g] * p1[x.word_of_group], model.d2)
                c1 = x.root_customers(group)
                root = seated(mixed(x.words + U(1)), 3 * turn + 2, c1, np.full(len(x.words), (model.s1 + model.d1 * totals.root) / (model.v + 1)), model.d1)
                kept = slice(0, len(x.tables) if keep else len(x.tables) - 1)
                trim()
                yield _table([_row(row["bucket"], x.words, x.per, x.u, x.c, [*x.tables[kept], now], [*x.groups[kept], group], [*x.roots[kept], root])])

    return run


def _totals(model: Model, state: DataFrame) -> Totals:
    """Sums of a fixed number of values, whatever the corpus."""
    size, end = model.contexts + 1, model.contexts + 1 + model.classes

    def add(batches):
        n, v, t1, cu, tu = 0, 0, 0, np.zeros(end), np.zeros(end)
        for batch in batches:
            for r in batch.to_pylist():
                x = Dishes(model, r)
                n, v, t1 = n + int(x.c.sum()), v + len(x.words), t1 + int(x.roots[-1].sum())
                cu[:size] += np.bincount(x.u, x.c, size)
                tu[:size] += np.bincount(x.u, x.tables[-1], size)
                tu[size:] += np.bincount(x.g, x.groups[-1], model.classes)
        at = np.flatnonzero(tu)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([*at, -1, -2]), pa.array([*cu[at], float(n), float(t1)]), pa.array([*tu[at], float(v), 0.0])], names=["u", "x", "y"])

    rows = state.mapInArrow(add, "u long, x double, y double").groupBy("u").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).toArrow()
    u, x, y = (rows.column(c).to_numpy() for c in "uxy")
    tables, at = np.zeros(end), u >= 0
    tables[u[at]] = y[at]
    model.customers[u[(u >= 0) & (u < size)]] = x[(u >= 0) & (u < size)]
    for k, a, b in zip(u[~at], x[~at], y[~at]):
        if k == -1:
            model.n, model.v = int(a), int(b)
    return Totals(tables[:size], tables[size:], float(x[u == -2].sum()))


def train(docs: DataFrame, space: Workspace, n: int, model: Model, burn_in: int = 2, samples: int = 3) -> DataFrame:
    """docs: _text of training documents -> the state table; model gets the totals of each sample."""
    state = space.keep(docs.mapInArrow(_gather(model.contexts, n), "bucket int, words binary, per binary, contexts binary, counts binary").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_merge(model), STATE))
    for turn in range(burn_in + samples):
        totals = _totals(model, state)
        keep = turn > burn_in
        if keep:
            model.samples.append(totals)
        new = space.keep(state.mapInArrow(_sweep(model, totals, turn, keep), STATE))
        space.drop(state)
        state = new
    model.samples.append(_totals(model, state))
    space.settle()
    return state


def predictive(model: Model, u, c, t, c2, t2, c1, t1) -> np.ndarray:
    """Mean over samples of the probability of a word after context u; rows of t, c2, t2, c1 and t1 are samples."""
    total = np.zeros(len(u))
    for i, sample in enumerate(model.samples):
        p2 = model.grouped(u // model.per_class, c2[i], t2[i], model.root(c1[i], t1[i], sample), sample)
        total += model.known(u, c, t[i], p2, sample)
    return total / len(model.samples)


def _ask(contexts: int, n: int):
    def run(table: pa.Table) -> pa.Table:
        _, words, word, context = _tokens(table, contexts)
        per, u, _ = _pairs(words, word, context)
        cuts = _cuts(words, per, n)
        part = table.column("_part")[0].as_py()
        return pa.table({"bucket": pa.array([x[0] for x in cuts], pa.int32()), "part": pa.array([part] * len(cuts), pa.int32()), "words": [words[i:j].tobytes() for _, i, j, _, _ in cuts], "per": [_narrow(per[i:j]) for _, i, j, _, _ in cuts], "contexts": [u[p:q].astype(np.uint16).tobytes() for _, _, _, p, q in cuts]})

    return run


class Served:
    """A bucket's dishes as they are asked for: the logarithm of each known pair, which many parts ask for, made once; and for
    other pairs those of known words, with the customers and tables of every kept sample."""

    def __init__(self, model: Model, row: dict | None, block: int = 1 << 17):
        self.model, self.words = model, np.zeros(0, U)
        if row:
            x = self.x = Dishes(model, row)
            self.words, self.base = x.words, max(model.contexts + 1, model.classes)
            self.c2, self.key, self.group_key = x.group_customers(x.tables), x.of * self.base + x.u, x.word_of_group * self.base + x.g
            self.c1, self.once = x.root_customers(x.groups), np.add.reduceat(x.c, x.starts)
            self.logs = np.empty(len(x.u), np.int32)
            for a in range(0, len(x.u), block):
                b = slice(a, a + block)
                g, of = x.group_of[b], x.of[b]
                self.logs[b] = self.log(x.u[b], x.c[b], x.tables[:, b], self.c2[:, g], x.groups[:, g], self.c1[:, of], x.roots[:, of])

    def log(self, *pairs):
        return np.rint(np.log10(predictive(self.model, *pairs)) * STEP).astype(np.int32)

    def answers(self, w, n, ctx):
        """Of words w with n contexts each: the words' counts, and their logarithms after each context."""
        count, logs, rest = np.zeros(len(w), np.int64), np.empty(len(ctx), np.int32), np.arange(len(ctx))
        of = np.full(len(ctx), -1)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, w), len(self.words) - 1)
            known = self.words[at] == w
            count[known] = self.once[at[known]]
            of = np.repeat(np.where(known, at, -1), n)
            want = of * self.base + ctx
            hit = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            met = self.key[hit] == want
            logs = self.logs[hit]
            rest = np.flatnonzero(~met)
        if len(rest):
            of, ctx = of[rest], ctx[rest]
            c2, t2, c1, t1 = np.zeros((4, len(self.model.samples), len(rest)))
            if len(self.words):
                there = np.flatnonzero(of >= 0)
                c1[:, there], t1[:, there] = self.c1[:, of[there]], self.x.roots[:, of[there]]
                want = of[there] * self.base + ctx[there] // self.model.per_class
                hit = np.minimum(np.searchsorted(self.group_key, want), len(self.group_key) - 1)
                met = self.group_key[hit] == want
                there, hit = there[met], hit[met]
                c2[:, there], t2[:, there] = self.c2[:, hit], self.x.groups[:, hit]
            none = np.zeros_like(c1)
            logs[rest] = self.log(ctx, none[0], none, c2, t2, c1, t1)
        return count, logs


TOLD = {"part": pa.int32(), "bucket": pa.int32(), "counts": pa.binary(), "logs": pa.binary()}


def _tell(model: Model, held: int = 1 << 18):
    """Rows in the order of buckets, each bucket's state (part -1) before what the parts ask -> answers. Every part asks for
    the common words, so a bucket's questions aren't held together: they are answered by some `held` pairs at a time."""

    def answered(served, bucket, rows):
        w, n, ctx = [np.frombuffer(r["words"], U) for r in rows], [_widened(r["per"]) for r in rows], [np.frombuffer(r["contexts"], np.uint16) for r in rows]
        count, logs = served.answers(np.concatenate(w), np.concatenate(n), np.concatenate(ctx).astype(np.int64))
        i, p = (np.cumsum([0, *map(len, x)]) for x in (w, ctx))
        values = ([r["part"] for r in rows], [bucket] * len(rows), [_narrow(count[a:b]) for a, b in zip(i, i[1:])], [logs[a:b].tobytes() for a, b in zip(p, p[1:])])
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, TOLD.values())], names=[*TOLD])

    def run(batches):
        bucket, served, asked, size = None, None, [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if asked and (row["bucket"] != bucket or size > held):
                    yield answered(served, bucket, asked)
                    asked, size = [], 0
                if row["bucket"] != bucket:
                    bucket, served = row["bucket"], Served(model, row if row["part"] < 0 else None)
                    trim()
                if row["part"] >= 0:
                    asked.append(row)
                    size += len(row["contexts"]) // 2
        if asked:
            yield answered(served, bucket, asked)

    return run


def _score(model_n: int, model_v: int, contexts: int):
    def run(told: pa.Table, docs: pa.Table) -> pa.Table:
        order = np.argsort(told.column("bucket").to_numpy(), kind="stable")
        told = told.take(pa.array(order))
        counts, words, word, context = _tokens(docs, contexts)
        *_, pair = _pairs(words, word, context, places=True)
        count = _wide(told, "counts")
        logs = _cat(told, "logs", np.int32) / STEP
        c, log = count[word], logs[pair]
        base = np.log10((c + 1) / (model_n + model_v + 1))
        starts = np.cumsum(counts) - counts
        add = lambda x: np.add.reduceat(x, starts) if len(starts) else x
        return pa.table([docs.column("_id"), docs.column("_held"), pa.array(counts, pa.int64()), pa.array(add((c > 0).astype(np.int64)), pa.int64()), pa.array(add(base), pa.float64()), pa.array(add(log), pa.float64())], names=["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def score_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", model: Model | None = None, part_mb: int = 4) -> DataFrame:
    """One row a document: id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    spark = docs.sparkSession
    space, model = Workspace(spark, "lm"), model or Model()
    n = parts_for(docs, text, part_mb)
    buckets = max(BUCKETS, -(-n * part_mb // 8))
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))
    base = docs.select(F.col(id_col).alias("_id"), held.alias("_held"), F.col(text).alias("_text"))
    state = train(base.where(~F.col("_held")).select("_text"), space, buckets, model)
    parted = dealt(base, n, "_id", "_text").groupBy("_part")
    asked = parted.applyInArrow(_ask(model.contexts, buckets), "bucket int, part int, words binary, per binary, contexts binary")
    served = asked.unionByName(state.withColumn("part", F.lit(-1)), allowMissingColumns=True)
    told = served.repartition("bucket").sortWithinPartitions("bucket", "part").mapInArrow(_tell(model), "part int, bucket int, counts binary, logs binary")
    kind = docs.schema[id_col].dataType.simpleString()
    out = told.groupBy("part").cogroup(parted).applyInArrow(_score(model.n, model.v, model.contexts), f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
