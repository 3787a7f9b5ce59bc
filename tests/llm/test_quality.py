import math
import re
from collections import Counter

from pyspark.sql import functions as F

from sightline.llm.quality import GRID, RULES, SHARES, _shares, binomial_at_most, cutoffs, keep_good, labelled_measures, measures, quality_table

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    words = W.findall(t)
    wins = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    c, cover = Counter(wins), set()
    for i, w in enumerate(wins):
        if c[w] > 1:
            cover |= set(range(i, i + 8))
    lines = [x for x in t.split("\n") if W.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)


TEXTS = [None, "", " \n\t", "one", "a b c d e f g h a b c d e f g h", "x " * 30, "# a\n# a\n\n# a \n|||", "\u00a0nbsp\u2003wide\x1cfs", "é🙂 & <b>", " lead and trail ", "a b c d e f g h i a b c d e f g h", "w " * 5000 + "end"]


def test_measures_equal_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in measures(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(TEXTS[r.doc_id]), r


def test_measures_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for r in measures(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text)


def test_binomial(spark):
    for n, k, p in [(10, 0, 0.1), (500, 3, 0.02), (1000, 12, 0.02), (20000, 300, 0.02), (50, 2, 0.5), (7, 7, 0.1)]:
        want = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p)) for i in range(k + 1)) if k < n * p else 1.0
        got = spark.range(1).select(binomial_at_most(F.lit(k), F.lit(n), p)).first()[0]
        assert abs(got - want) <= 1e-9 * max(want, 1e-300), (n, k, p, got, want)
    a = spark.range(1).select(binomial_at_most(F.lit(300), F.lit(20000), 0.02, terms=20)).first()[0]
    assert a >= spark.range(1).select(binomial_at_most(F.lit(300), F.lit(20000), 0.02)).first()[0]


def labelled(spark, n, junk):
    rows = [(i, "en" if i % 3 else None, " ".join(f"w{j}" for j in range(30)) if i % 5 else junk) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, int(bool(i % 5)), 0) for i in range(n)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_certified_cutoffs_reject_bad_and_keep_good(spark):
    docs, labels = labelled(spark, 24000, " ".join(f"w{j}###" for j in range(30)))
    out = quality_table(docs, labels).groupBy((F.col("doc_id") % 5 == 0).alias("bad"), "kept").count().collect()
    assert {(r.bad, r.kept): r["count"] for r in out} == {(True, False): 4800, (False, True): 19200}


def test_too_few_labels_certify_nothing(spark):
    docs, labels = labelled(spark, 100, " ".join(f"w{j}###" for j in range(30)))
    assert quality_table(docs, labels).where("not kept and not base_failed").count() == 0


def test_no_labels_empty_and_clashing_columns(spark):
    docs, labels = labelled(spark, 20, "x")
    docs = docs.withColumn("n_words", F.lit("mine")).withColumn("stratum", F.lit(1)).withColumn("kept", F.lit(None).cast("int"))
    kept = keep_good(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == 16 and {r.n_words for r in kept.collect()} == {"mine"}
    assert keep_good(docs.limit(0), labels).count() == 0


def by_hand(rows, risk, delta):
    """The docstring's definition in plain Python, with exact binomials: stratum -> (step, cutoffs, n, k)."""
    strata, out = {r.stratum for r in rows}, {}
    for s in strata:
        mine = [r for r in rows if r.stratum == s]
        fit, held = [r for r in mine if r.fit], [r for r in mine if not r.fit and r.quality == 1]
        sets = []
        for q in SHARES:
            cut = {}
            for rule in RULES:
                goods = [r["s_" + rule] for r in fit if r.quality == 1]
                bads = [r["s_" + rule] for r in fit if r.quality == 0]
                could = [(sum(b >= g for b in bads), g) for g in GRID if sum(x >= g for x in goods) <= q * len(goods)]
                if could and max(could)[0] > 0:
                    cut[rule] = max(could)[1]
            sets.append(cut)
        best = None
        for step, cut in enumerate(sets):
            hit = lambda r: any(r["s_" + rule] >= g for rule, g in cut.items())
            k, n = sum(map(hit, held)), len(held)
            chance = 1.0 if n == 0 or k >= n * risk else sum(math.comb(n, i) * risk**i * (1 - risk) ** (n - i) for i in range(k + 1))
            if not n or chance > delta / len(strata):
                break
            caught = sum(hit(r) for r in fit if r.quality == 0)
            if caught and (best is None or caught > best[0]):
                best = caught, step, cut, n, k
        if best:
            out[s] = best[1:]
    return out


def test_cutoffs_equal_their_definition(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    marked = labelled_measures(measures(docs.join(labels.select("doc_id"), "doc_id", "left_semi")).drop("text"), labels)
    marked = marked.select("stratum", "quality", "fit", "id", "n_words", "word_chars", "n_symbols", "n_bangs", "n_capitals", "n_lines", "n_dup_lines", "n_repeat_words").persist()
    rows = marked.select("stratum", "quality", "fit", *(c.alias("s_" + r) for r, c in _shares().items())).collect()
    got = {r.stratum: (r.step, {k: v for k, v in r.cut.asDict().items() if v is not None}, r.holdout, r.rejected) for r in cutoffs(marked, 0.02, 0.05).collect()}
    assert got and got == by_hand(rows, 0.02, 0.05)
    # at this size some documents are judged by certified cutoffs
    assert quality_table(docs, labels).where("not kept and not base_failed").count() > 100


def test_repeated_rows_and_a_very_long_text(spark):
    docs = spark.createDataFrame([(1, "en", "b " * 300_000), (1, "en", "b " * 300_000), (2, None, None)], "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0)], "doc_id long, quality int")
    out = quality_table(docs, labels).collect()
    assert sorted((r.doc_id, r.n_words, r.n_repeat_words, r.base_failed) for r in out) == [(1, 300_000, 300_000, True)] * 2 + [(2, 0, 0, True)]
