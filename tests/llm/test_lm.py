import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sightline.llm import lm
from sightline.llm.lm import END, Dishes, Model, Totals, _draws, _merge, _narrow, _tell, _widened, predictive, score_documents, seated
from sightline.llm.text import U, mixed
import xxhash

W = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return [*W.findall(low), None]


def brute(rows):
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    c = Counter(w for h, (_, t) in zip(held, rows) if not h for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return {(i, h, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for h, (i, t) in zip(held, rows)}


def test_base_and_perplexity(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = score_documents(df).collect()
    assert {(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got} == brute(rows)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    again = {r.doc_id: r.score for r in score_documents(df.repartition(5)).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-6 * abs(r.score) for r in got)


def test_odd_rows(spark):
    rows = [(1, "A a b"), (2, None), (3, ""), (None, "a b"), (2, "zz a"), (9, "é É"), (13, "b " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = score_documents(df).collect()
    assert {(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got} == brute(rows)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert score_documents(df.limit(0)).count() == 0
    assert score_documents(df.where("crc32(cast(cast(doc_id as string) as binary)) % 7 = 2")).count() == sum(zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows if i)


def test_scores_dont_depend_on_partitions(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    runs, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (4, 7):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            runs.append({r.doc_id: r.score for r in score_documents(df, part_mb=4 if n == 4 else 1).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert runs[0] == runs[1]


def test_seating():
    c = np.array([0, 1, 2, 50, 1000, 100000] * 200)
    t = seated(np.arange(len(c)).astype(U), 3, c, np.full(len(c), 0.7), 0.5)
    assert (t <= c).all() and (t[c > 0] >= 1).all() and (t[c == 0] == 0).all()
    # the same by the definition, one customer at a time
    rng, want = np.random.default_rng(1), []
    for _ in range(400):
        k = 1
        for n in range(1, 1000):
            k += rng.random() < 0.7 / (n - 0.5 * k + 0.7)
        want.append(k)
    assert abs(t[c == 1000].mean() - np.mean(want)) < 0.5


def test_draws_are_uniform_and_differ_by_turn():
    x, y = (_draws(np.arange(100_000).astype(U), k) for k in (5, 6))
    assert abs(x.mean() - 0.5) < 0.005 and abs(x.std() - 12**-0.5) < 0.005 and abs(np.corrcoef(x, y)[0, 1]) < 0.02 and abs(np.corrcoef(x[1:], x[:-1])[0, 1]) < 0.02


def test_probabilities_of_all_words_add_up_to_one():
    rng = np.random.default_rng(2)
    m = Model(contexts=6, per_class=2)
    m.v = 50
    counts = rng.integers(0, 6, (7, 50))
    counts[0] += counts.sum(axis=0) == 0
    m.customers = counts.sum(axis=1).astype(float)
    of = np.arange(7) // 2
    tabs, c2s, t2s, c1s, t1s = [], [], [], [], []
    for _ in range(2):
        t = np.minimum(counts, rng.integers(1, 3, counts.shape))
        c2 = np.stack([t[of == g].sum(axis=0) for g in range(4)])
        t2 = np.minimum(c2, rng.integers(1, 3, c2.shape))
        c1 = t2.sum(axis=0)
        t1 = np.minimum(c1, 1)
        m.samples.append(Totals(t.sum(axis=1).astype(float), t2.sum(axis=1).astype(float), float(t1.sum())))
        for to, x in ((tabs, t), (c2s, c2), (t2s, t2), (c1s, c1), (t1s, t1)):
            to.append(x)
    for u in range(7):
        p = predictive(m, np.full(50, u), counts[u], [t[u] for t in tabs], [c[of[u]] for c in c2s], [t[of[u]] for t in t2s], c1s, t1s).sum()
        zero = np.zeros((2, 1))
        p += predictive(m, np.array([u]), np.zeros(1), zero, zero, zero, zero, zero)[0]
        assert abs(p - 1) < 1e-9


class ByHand:
    """The model in plain Python: dictionaries, one customer at a time; only the random numbers are the operator's."""

    def __init__(self, texts, model, burn_in=2, samples=3):
        self.m, self.c = model, Counter()
        for t in texts:
            before = None
            for w in tokens(t):
                self.c[self.context(before), self.hash(w)] += 1
                before = w
        self.words = {w for _, w in self.c}
        self.t = {k: 1 for k in self.c}
        self.t2 = {(u // model.per_class, w): 1 for u, w in self.c}
        self.t1 = {w: 1 for w in self.words}
        self.kept = []
        for turn in range(burn_in + samples):
            if turn > burn_in:
                self.kept.append(self.now())
            self.sweep(turn)
        self.kept.append(self.now())

    def hash(self, w):
        return int(END) if w is None else xxhash.xxh3_64_intdigest(w.encode())

    def context(self, before):
        return self.m.contexts if before is None else int(mixed(np.array([self.hash(before)], U) + U(77))[0] % U(self.m.contexts))

    def now(self):
        c2, c1 = Counter(), Counter()
        for (u, w), t in self.t.items():
            c2[u // self.m.per_class, w] += t
        for (g, w), t in self.t2.items():
            c1[w] += t
        sums = [Counter() for _ in range(3)]  # tables of contexts, of classes, customers of classes
        for (u, _), t in self.t.items():
            sums[0][u] += t
        for (g, _), t in self.t2.items():
            sums[1][g] += t
        for (g, _), n in c2.items():
            sums[2][g] += n
        return dict(self.t), dict(self.t2), dict(self.t1), c2, c1, *sums, sum(self.t1.values())

    def p1(self, w, s):
        all_ = self.m.s1 + sum(s[6].values())
        return (s[4][w] - self.m.d1 * s[2].get(w, 0)) / all_ + (self.m.s1 + self.m.d1 * s[8]) / all_ / (len(self.words) + 1)

    def p2(self, g, w, s):
        return (s[3][g, w] - self.m.d2 * s[1].get((g, w), 0) + (self.m.s2 + self.m.d2 * s[6][g]) * self.p1(w, s)) / (self.m.s2 + s[7][g])

    def p(self, u, w, s):
        n = sum(k for (x, _), k in self.c.items() if x == u)
        return (self.c[u, w] - self.m.d * s[0].get((u, w), 0) + (self.m.s + self.m.d * s[5][u]) * self.p2(u // self.m.per_class, w, s)) / (self.m.s + n)

    def seat(self, seed, turn, c, new, d):
        t = min(c, 1)
        for done in range(1, c):
            t += _draws(np.array([seed], U), (turn << 20) + done - 1)[0] < new / (done - d * t + new)
        return int(t)

    def sweep(self, turn):
        s, m = self.now(), self.m
        seed = lambda w, k: (int(mixed(np.array([w], U) + U(1))[0]) + k) % (1 << 64)
        self.t = {(u, w): self.seat(seed(w, u), 3 * turn, c, (m.s + m.d * s[5][u]) * self.p2(u // m.per_class, w, s), m.d) for (u, w), c in self.c.items()}
        c2 = self.now()[3]
        self.t2 = {(g, w): self.seat(seed(w, g), 3 * turn + 1, c, (m.s2 + m.d2 * s[6][g]) * self.p1(w, s), m.d2) for (g, w), c in c2.items()}
        c1 = self.now()[4]
        self.t1 = {w: self.seat(seed(w, 0), 3 * turn + 2, c, (m.s1 + m.d1 * s[8]) / (len(self.words) + 1), m.d1) for w, c in c1.items()}

    def score(self, text):
        total, before = 0.0, None
        for w in tokens(text):
            total += math.log10(sum(self.p(self.context(before), self.hash(w), s) for s in self.kept) / len(self.kept))
            before = w
        return total


def test_scores_equal_a_model_by_hand(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(["a", "b", "c", "dd", "Ee", "f"], p=[0.4, 0.2, 0.2, 0.1, 0.05, 0.05], size=rng.integers(0, 9)))) for i in range(12)] + [(None, None), (50, "unseen a b")]
    training = [t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    model = dict(contexts=8, per_class=4)
    hand = ByHand(training, Model(**model))
    got = score_documents(spark.createDataFrame(rows, "doc_id long, text string"), model=Model(**model)).collect()
    want = sorted(hand.score(t) for _, t in rows)
    assert max(abs(a - b) for a, b in zip(sorted(r.score for r in got), want)) < 1e-6


def rows_of_pieces(n, words, contexts, more=()):
    """n rows of bucket 3 with all contexts of all words, each twice, before those of other buckets; a batch each, made when read."""
    row = dict(bucket=3, words=words.tobytes(), per=_narrow(np.full(len(words), len(contexts))), contexts=np.tile(contexts, len(words)).tobytes(), counts=_narrow(np.full(len(words) * len(contexts), 2)))
    for r in [row] * n + [*more]:
        yield pa.RecordBatch.from_pylist([r])


def peak_mb(run):
    tracemalloc.start()
    out = run()
    mb = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return out, mb


def test_a_common_word_is_merged_and_served_in_bounded_memory():
    model, words, contexts = Model(contexts=1 << 12, per_class=64), np.array([5, 9], U), np.arange(1 << 12, dtype=np.uint16)
    last = dict(bucket=4, words=np.array([7], U).tobytes(), per=_narrow(np.array([1])), contexts=np.array([6], np.uint16).tobytes(), counts=_narrow(np.array([1])))
    merged, mb = peak_mb(lambda: [r for b in _merge(model, held=1 << 16)(rows_of_pieces(1000, words, contexts, [last])) for r in b.to_pylist()])
    assert [r["bucket"] for r in merged] == [3, 4] and mb < 20  # all its pairs at once: 8 million, 65 MB of hashes alone
    x = Dishes(model, merged[0])
    assert x.words.tolist() == [5, 9] and x.per.tolist() == [1 << 12] * 2 and (x.u == np.tile(contexts, 2)).all() and (x.c == 2000).all() and (x.tables == 1).all()

    model.n, model.v = 8 * 1000 * len(contexts) + 1, 3
    model.customers[: len(contexts)] = 4000
    model.samples.append(Totals(np.append(np.full(len(contexts), 2.0), 0), np.append(np.full(64, 2.0), 0), 3.0))

    def asked():
        for bucket in (2, 3):  # bucket 2 has no state
            if bucket == 3:
                yield pa.RecordBatch.from_pylist([dict(merged[0], part=-1)])
            for part in range(300):
                yield pa.RecordBatch.from_pylist([dict(bucket=bucket, part=part, words=np.array([5, 8], U).tobytes(), per=_narrow(np.array([len(contexts), 1])), contexts=np.append(contexts, np.uint16(part)).tobytes(), counts=None, tables=None, groups=None, roots=None)])

    def run():
        return [(r["bucket"], r["part"], _widened(r["counts"]).tolist(), len(r["logs"]), hash(r["logs"][: 4 * len(contexts)])) for b in _tell(model, held=1 << 14)(asked()) for r in b.to_pylist()]

    told, mb = peak_mb(run)
    assert mb < 20 and len(told) == 600 and all(n == 4 * len(contexts) + 4 for *_, n, _ in told)
    assert [t[:2] for t in told] == [(b, p) for b in (2, 3) for p in range(300)]
    assert all(t[2] == ([0, 0] if t[0] == 2 else [2000 * len(contexts), 0]) for t in told)
    assert len({t[-1] for t in told}) == 2  # all parts get the same answers, one kind from each bucket


def test_contexts_are_made_once_a_distinct_word(monkeypatch):
    made = []
    monkeypatch.setattr(lm, "mixed", lambda x: made.append(len(x)) or mixed(x))
    texts = ["Ab c abÉ " * 500, None, "", " c \t ab"]
    table = pa.table({"_text": texts})
    counts, words, word, context = lm._tokens(table, 64)
    assert sum(made) <= 4  # three words and the end; they were made for each of the 1506 tokens
    hand, want = ByHand([], Model(contexts=64)), []
    for t in texts:
        seen = tokens(t)
        want += [(hand.hash(w), hand.context(before)) if i else (hand.hash(w), 64) for i, (before, w) in enumerate(zip([None, *seen], seen))]
    assert counts.tolist() == [1501, 1, 1, 3] and list(zip(words[word].tolist(), context.tolist())) == want
    per, u, c, pair = lm._pairs(words, word, context, places=True)
    pairs = list(zip(np.repeat(words, per).tolist(), u.tolist()))
    assert sorted(words.tolist()) == words.tolist() and pairs == sorted(set(want)) and [pairs[i] for i in pair] == want and c.tolist() == [Counter(want)[p] for p in pairs]


def test_known_pairs_are_worked_out_once_however_many_parts_ask(monkeypatch):
    rng, model = np.random.default_rng(3), Model(contexts=64, per_class=8)
    words, contexts = np.sort(rng.integers(0, 1 << 32, 20).astype(U)), np.arange(0, 64, 3)
    n = len(words) * len(contexts)
    u, c = np.tile(contexts, len(words)), rng.integers(1, 9, n)
    groups = len(np.unique(contexts // 8))
    x = dict(bucket=3, part=-1, words=words.tobytes(), per=_narrow(np.full(len(words), len(contexts))), contexts=u.astype(np.uint16).tobytes(), counts=_narrow(c), tables=_narrow(np.minimum(rng.integers(1, 3, 2 * n), np.tile(c, 2))), groups=_narrow(np.ones(2 * len(words) * groups, np.int64)), roots=_narrow(np.ones(2 * len(words), np.int64)))
    model.n, model.v = int(c.sum()), len(words)
    model.customers[:64] = 40
    model.samples += [Totals(np.append(np.full(64, 9.0 + i), 0), np.append(np.full(8, 20.0), 0), 20.0) for i in range(2)]
    want_w, want_u = np.append(U(5), words), [np.array([1, 3])] + [np.arange(64) if i else np.arange(0, 64, 9) for i in range(len(words))]
    ask = dict(bucket=3, words=want_w.tobytes(), per=_narrow(np.array([len(v) for v in want_u])), contexts=np.concatenate(want_u).astype(np.uint16).tobytes(), counts=None, tables=None, groups=None, roots=None)
    done = []
    monkeypatch.setattr(lm, "predictive", lambda m, u, *more: done.append(len(u)) or predictive(m, u, *more))
    parts = 50
    told = [r for b in _tell(model)([pa.RecordBatch.from_pylist([x, *(dict(ask, part=p) for p in range(parts))])]) for r in b.to_pylist()]
    asked = sum(len(v) for v in want_u)
    met = sum(int(np.isin(v, contexts).sum()) for v in want_u[1:])
    assert sum(done) == n + parts * (asked - met)  # all that was asked before: parts * asked

    d = Dishes(model, x)
    c2, c1, got = d.group_customers(d.tables), d.root_customers(d.groups), []
    for w, us in zip(want_w, want_u):
        for k in us:
            i, g, o = np.flatnonzero((d.words[d.of] == w) & (d.u == k)), np.flatnonzero((d.words[d.word_of_group] == w) & (d.g == k // 8)), np.flatnonzero(d.words == w)
            one = lambda a, at: a[:, at] if len(at) else np.zeros((2, 1))
            got.append(predictive(model, np.array([k]), d.c[i] if len(i) else np.zeros(1), one(d.tables, i), one(c2, g), one(d.groups, g), one(c1, o), one(d.roots, o))[0])
    logs = np.rint(np.log10(got) * lm.STEP).astype(np.int32)
    assert len(told) == parts and all((np.frombuffer(r["logs"], np.int32) == logs).all() for r in told)
    assert all(_widened(r["counts"]).tolist() == [0, *c.reshape(len(words), -1).sum(axis=1)] for r in told)
