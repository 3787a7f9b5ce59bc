import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sightline.llm.toxicity import Model, Sentences, features_of, fit_toxicity, fitted, noisy_or, score_toxicity, toxicity

BAD = ["scumly", "scumbar", "morones", "vilefoo"]


def made(n, seed):
    """Documents of which some have a sentence with a bad word; labels, and the bad sentences' numbers."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("aeioubcdfgklmnprst") for _ in range(rnd.randint(2, 7))) for _ in range(300)]
    rows, labels, where = [], [], {}
    for i in range(n):
        sentences = [[rnd.choice(words) for _ in range(rnd.randint(3, 9))] for _ in range(rnd.randint(1, 12))]
        bad = rnd.random() < 0.3
        if bad:
            at = rnd.randrange(len(sentences))
            sentences[at][rnd.randrange(3)] = rnd.choice(BAD)
            where[i] = at
        rows.append((i, ". ".join(" ".join(s) for s in sentences)))
        if i % 2 == 0:
            labels.append((i, int(bad)))
    return rows, labels, where


def auc(pairs):
    bad, good = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / len(bad) / len(good)


def test_held_out_accuracy_and_sentences(spark):
    rows, labels, where = made(1200, 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    truth = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity(docs, truth).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for i, r in got.items())
    held = [(got[i].score, i in where) for i in got if got[i].held_out]
    assert auc(held) > 0.97 and sum((s >= 0.5) == y for s, y in held) / len(held) > 0.95
    right = [[x.number for x in got[i].offending] == [at] for i, at in where.items()]
    assert sum(right) / len(right) > 0.9  # found though only documents have labels
    assert sum(got[i].predicted for i in got if i not in where) < 0.03 * len(got)


def test_labels_of_held_out_rows_are_not_learnt_from(spark):
    rows, labels, _ = made(400, 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    other = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    a, b = ({r.doc_id: r.score for r in toxicity(docs, spark.createDataFrame(x, "doc_id long, toxic int").coalesce(1)).collect()} for x in (labels, other))
    assert a == b


def test_score_is_the_noisy_or_of_logistic_sentences(spark):
    model = Model({"=bad": 2.0, "bad": 0.5, "wor": 1.0}, -1.5)
    texts = ["Bad day. worse, worst!! Fine\nBADLY", "fine", None, "", "... !", "bad bad. " * 3000]

    def p(sentence):
        found = [model.weights[f] for w in re.findall(r"[a-z]+", sentence.lower()) for f in features_of(w) if f in model.weights]
        return 1 / (1 + math.exp(1.5 - sum(found))) if found else 0.0

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in score_toxicity(df, model).collect():
        pieces = re.split(r"[.!?\n]+", texts[r.doc_id] or "")
        want = 1 - math.prod(1 - p(x) for x in pieces)
        assert abs(r.score - want) < 1e-9 and r.n_sentences == sum(bool(re.search("[a-z]", x, re.I)) for x in pieces)
        assert [(x.number, x.sentence) for x in r.offending] == [(i, x) for i, x in enumerate(pieces) if p(x) >= 0.5] and r.n_offending == len(r.offending)


def test_fit_reaches_the_greatest_likelihood():
    sets = {"a": b"\0\0\0\0", "b": b"\1\0\0\0", "ab": b"\0\0\0\0\1\0\0\0"}
    kinds = [(1, {"a": 1, "b": 3}, 30), (0, {"b": 2}, 40), (0, {"a": 1}, 6), (1, {"b": 1}, 9), (1, {"ab": 1}, 5), (0, {"ab": 2, "b": 1}, 3)]
    ints = lambda x: np.array(x, np.int32).tobytes()
    rows = [(y, b"".join(sets[k] for k in bags), ints([len(k) for k in bags]), ints(list(bags.values()))) for y, bags, n in kinds for _ in range(n)] + [(0, b"", b"", b"")]
    table = pa.table([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["label", "features", "sizes", "times"])
    weight = {0: 1.0, 1: 2.0}
    model = fitted(["a", "b"], table, weight, 400, 0.05, part=16)
    assert fitted(["a", "b"], table, weight, 400, 0.05).weights == pytest.approx(model.weights)

    def likelihood(a, b, c):
        total = -0.025 * (a * a + b * b)
        for y, bags, n in kinds:
            clean = math.prod((1 - 1 / (1 + math.exp(-c - a * ("a" in k) - b * ("b" in k)))) ** t for k, t in bags.items())
            total += n * weight[y] * math.log(1 - clean if y else clean)
        return total

    a, b, c = model.weights["a"], model.weights["b"], model.bias
    best = likelihood(a, b, c)
    assert all(likelihood(a + x, b + y, c + w) < best + 1e-3 for x in (-0.3, 0, 0.3) for y in (-0.3, 0, 0.3) for w in (-0.3, 0, 0.3))


def test_without_two_labels_every_score_is_null_risk(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, "c"), (2, None)], "doc_id long, text string").withColumn("score", F.lit("own")).withColumn("_id", F.lit("own"))
    for rows in ([], [(1, 1)], [(1, None), (7, 0)], [(8, 0), (9, 1)]):
        labels = spark.createDataFrame(rows, "doc_id long, toxic int")
        out = toxicity(docs, labels, held=-1).collect()
        assert len(out) == 3 and all(r.score == 0 and r.predicted == 0 and r["_id"] == "own" for r in out)
    assert toxicity(docs.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).count() == 0


def test_repeated_rows_and_bounds(spark):
    rows, labels, where = made(600, 3)
    docs = spark.createDataFrame(rows + rows[:50] + [rows[0]] * 300, "doc_id long, text string").repartition(4)
    truth = spark.createDataFrame(labels + [(i, 0) for i, y in labels[:20] if y] + labels[:9], "doc_id long, toxic int")
    model = fit_toxicity(docs, truth, per_class=60)
    assert 0 < len(model.weights) and any(f.startswith(("scum", "=scum", "moron", "vile")) for f in model.weights)
    assert len(fit_toxicity(docs, truth, features=2).weights) == 2
    assert score_toxicity(docs, model).count() == 950


def test_sentences_and_noisy_or():
    s = Sentences(pa.array(["a b. c", None, "d"]))
    assert s.doc.tolist() == [0, 0, 1, 2] and s.per_doc.tolist() == [2, 0, 1]
    out = noisy_or(pa.array([0.5, 0.5, 0.0, 0.25]).to_numpy(), s.doc, 3)
    assert [round(x, 12) for x in out.tolist()] == [0.75, 0.0, 0.25]
