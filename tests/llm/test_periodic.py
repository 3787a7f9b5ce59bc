import hashlib
import random
import re
import zlib
from fractions import Fraction

from pyspark.sql import functions as F

from sightline.llm.periodic import least_overlap, periodic_runs, with_periods

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text, min_length=6, exponent=4):
    """Runs by trying every period at every place, and the words that stay."""
    w = W.findall(text or "")
    n, runs = len(w), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(min_length, exponent * q) and (i, j + q) not in runs:
                runs[i, j + q] = q  # the smallest comes first
            i = j
    rows = sorted((s, e - s, q) for (s, e), q in runs.items())
    gone = {i for s, length, q in rows for i in range(s + q, s + length)}
    best = min(rows, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if rows else None
    return rows, " ".join(x for i, x in enumerate(w) if i not in gone), best, n


def made(seed):
    rnd = random.Random(seed)
    out = []
    for i in range(150):
        words = rnd.choice([["a", "b"], ["a", "b", "c", "dé"], [f"w{k}" for k in range(40)]])
        w: list = []
        for _ in range(rnd.randint(0, 4)):
            w += [rnd.choice(words) for _ in range(rnd.randint(0, 25))]
            block = [rnd.choice(words) for _ in range(rnd.randint(1, 9))]
            w += (block * 9)[: rnd.randint(0, 8 * len(block))]
        out.append((i, rnd.choice([" ", "\n", "\t "]).join(w)))
    return out


def test_against_brute_force(spark):
    rows = made(1) + [(900, None), (901, ""), (902, " \n"), (None, "x x x x x x x"), (903, "x x x x x x"), (904, "x x x x x"), (903, "x x x x x x"), (905, "a b " * 3000), (906, " ".join(map(str, range(5000))))]
    for min_length, exponent in ((6, 4), (4, 2), (9, 3)):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = periodic_runs(df, min_length=min_length, exponent=exponent).collect()
        assert len(got) == len(rows)
        for r in got:
            if r.doc_id in (905, 906) and exponent == 2:
                continue  # too long for the brute force at that many periods
            runs, kept, best, n = brute(r.text, min_length, exponent)
            assert [tuple(x) for x in r.runs] == runs and r.collapsed == kept and r.n_runs == len(runs) and r.n_words == n, (r.text, min_length, exponent)
            assert (r.start, r.length, r.period) == (best or (None, None, None))
            assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)


def test_digests_and_columns(spark):
    df = spark.createDataFrame([(1, "a b a b a b a b c"), (2, None)], "doc_id long, text string").withColumn("runs", F.lit("own")).withColumn("start", F.lit("own")).withColumn("_words", F.lit("own"))
    out = {r.doc_id: r for r in periodic_runs(df, texts=False).collect()}
    assert out[1].runs_sha256 == hashlib.sha256(b"0,8,2\n").hexdigest() and out[1].collapsed_sha256 == hashlib.sha256(b"a b c").hexdigest()
    assert (out[1].start, out[1]["runs"], out[1]["_words"]) == (0, "own", "own")  # a result's name is replaced
    assert out[2].runs_sha256 == out[2].collapsed_sha256 == hashlib.sha256(b"").hexdigest() and out[2].start is None
    assert periodic_runs(df.limit(0)).count() == 0
    assert "runs" not in [c for c in periodic_runs(df).columns if c != "runs"] and periodic_runs(df).schema["runs"].dataType.typeName() == "array"


def test_ties_take_the_smallest_start(spark):
    r = periodic_runs(spark.createDataFrame([("x x x x x x y z z z z z z",)], "text string")).first()
    assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.collapsed) == (2, 0, 6, 1, 6000, "x y z")


def test_least_overlap():
    for least, exponent in ((6, 4), (4, 2), (9, 3), (50, 2), (2, 5)):
        assert least_overlap(least, exponent) == min(max(least, exponent * q) - q for q in range(1, 500))


def test_planted_periods(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 37))) for i in range(400)] + [(None, "a b c"), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_a", F.lit(1))
    some = 0
    for r, (i, text) in zip(with_periods(df).coalesce(1).collect(), rows):
        want = text
        h = zlib.crc32(str(i).encode())
        w = W.findall(text or "")
        if i is not None and h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            want = " ".join(w[j if j < a else a + (j - a) % p] for j in range(len(w)))
            some += 1
        assert (r.doc_id, r.text, r["_a"]) == (i, want, 1)
    assert some > 20
