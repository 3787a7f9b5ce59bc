"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

A rule rejects a document whose measure reaches a cutoff. Cutoffs are found per stratum (language):
labelled documents are split by a hash of the id. A quarter of them, the fitting part, proposes: for each
of a few shares q, from 0 up, every rule takes the cutoff that rejects at most q of the fitting part's
good documents and the most of its bad ones (of equal ones the highest; a rule that catches none is left
out). So each q gives one set of rules, and the sets are nested. The held-out rest certifies a set as a
whole: with k of n held-out good documents rejected by any of its rules, the chance of k or fewer at a
true rate of `risk` is the exact binomial distribution function, and the set passes if that chance is at
most `delta` over the number of strata (Bonferroni). Within a stratum the sets are tested in their order
and testing stops at the first that fails (fixed sequence), so trying several costs nothing more. Of the
certified sets the first is taken that catches the most bad documents of the fitting part. With a chance
of at least 1 - delta, no stratum's rules reject more than `risk` of its good documents.

Too few labels certify nothing, and then the stratum has no cutoff: with no false rejection at all it
takes ln(strata / delta) / -ln(1 - risk) held-out good documents, 217 for four strata at the defaults.

Null text counts no words. Null strata are one stratum. Labels that contradict count as bad; labels
with a null id or quality are ignored. Repeated rows of one id count as often as they occur. Columns of
the documents that have a measure's name don't clash: keep_good() works on renamed columns.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .mixing import WORDS
from .workspace import Workspace

#: Cutoffs that a rule may take, from the highest.
GRID = (0.9, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02)
RULES = ("symbols", "bangs", "capitals", "dup_lines", "repeats")
#: Shares of the fitting part's good documents that a rule may reject, in the order of testing.
SHARES = (0.0, 0.001, 0.002, 0.005, 0.01, 0.02)
#: One label in so many goes to the fitting part.
FIT = 4
WINDOW = 8


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_bangs, n_capitals (A-Z), n_lines, n_dup_lines, n_repeat_words, all long.

    n_repeat_words: words in windows of 8 that the text holds twice or more. Windows are compared by
    64-bit hashes within one text. Only texts with an equal pair of hashes are sorted.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    # zero-length pieces come from white space at either end only
    df = docs.withColumn("_words", F.regexp_extract_all(t, F.lit(WORDS), F.lit(0)))
    df = df.withColumn("_lines", F.filter(F.split(t, "\n", -1), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0))
    df = df.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w)))
    n = F.size("_words")
    pick = lambda i, k: F.get(F.col("_h"), i + k)
    df = df.withColumn("_win", F.when(n > WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(pick(i, k) for k in range(WINDOW))))).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("_twice", F.size(F.array_distinct("_win")) < F.size("_win"))
    # of (hash, place) in order, a place counts if a neighbour has the same hash
    df = df.withColumn("_sorted", F.when(F.col("_twice"), F.array_sort(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, j: x["h"].eqNullSafe(F.get(F.col("_sorted"), j - 1)["h"]) | x["h"].eqNullSafe(F.get(F.col("_sorted"), j + 1)["h"])
    df = df.withColumn("_places", F.array_sort(F.transform(F.filter("_sorted", same), lambda x: x["i"])))
    covered = F.aggregate("_places", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")), lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.alias("last")), lambda acc: acc["n"])
    count = lambda chars: (F.length(t) - F.length(F.translate(t, chars, ""))).cast("long")
    return df.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": count("#*$%&|<>"),
        "n_bangs": count("!?"),
        "n_capitals": count("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0).cast("long")),
    }).drop("_words", "_lines", "_h", "_win", "_twice", "_sorted", "_places")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _shares() -> dict[str, Column]:
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {"symbols": per("n_symbols", "word_chars"), "bangs": per("n_bangs", "word_chars"), "capitals": per("n_capitals", "word_chars"), "dup_lines": per("n_dup_lines", "n_lines"), "repeats": per("n_repeat_words", "n_words")}


def _log_gamma(x: Column) -> Column:
    """Stirling's series at x + 8, brought back by a product."""
    y = x + F.lit(8.0)
    down = F.ln(x)
    for k in range(1, 8):
        down = down + F.ln(x + F.lit(float(k)))
    return (y - 0.5) * F.ln(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5))) - down


def binomial_at_most(k: Column, n: Column, p: float, terms: int = 5000) -> Column:
    """The chance of k or fewer among n at rate p; above the mean, 1.

    Terms are added from k down, each a known ratio of the last. Beyond `terms` of them the rest is
    bounded by a geometric series, so the result is never too small.
    """
    k, n = k.cast("double"), n.cast("double")
    first = F.exp(_log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * F.ln(F.lit(p)) + (n - k) * F.ln(F.lit(1 - p)))
    start = F.struct(first.alias("term"), first.alias("sum"))
    step = lambda acc, j: F.struct((acc["term"] * (k - j) * (1 - p) / ((n - k + j + 1) * p)).alias("term"), (acc["sum"] + acc["term"] * (k - j) * (1 - p) / ((n - k + j + 1) * p)).alias("sum"))
    ratio = k * (1 - p) / ((n - k + 1) * p)
    rest = lambda acc: acc["sum"] + F.when(k > terms, acc["term"] * ratio / (1 - ratio)).otherwise(F.lit(0.0))
    steps = F.when(k >= 1, F.sequence(F.lit(0), F.least(k, F.lit(float(terms))).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.aggregate(steps, start, step, rest)))


def proposals(labelled: DataFrame) -> DataFrame:
    """The fitting part -> stratum, path: for each of SHARES in order a struct of each rule's cutoff, null if unused."""
    level = lambda c: sum(F.when(c >= g, 1).otherwise(0) for g in GRID)  # noqa: E731  how many cutoffs the share reaches
    long = labelled.where("fit").select("stratum", "quality", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), level(c).alias("level")) for r, c in _shares().items()))).alias("x"))
    hist = long.groupBy("stratum", "x.rule", "x.level").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))
    # cutoff number g (0 the highest) rejects what reaches more than len(GRID) - 1 - g of them
    steps = hist.select("stratum", "rule", F.explode(F.sequence(F.lit(0), F.lit(len(GRID) - 1))).alias("g"), "level", "good", "bad")
    hit = F.col("level") >= len(GRID) - F.col("g")
    steps = steps.groupBy("stratum", "rule", "g").agg(F.sum(F.when(hit, F.col("good")).otherwise(0)).alias("k"), F.sum("good").alias("n"), F.sum(F.when(hit, F.col("bad")).otherwise(0)).alias("caught"))
    best = lambda q, r: F.max(F.when((F.col("rule") == r) & (F.col("caught") > 0) & (F.col("k") <= q * F.col("n")), F.struct("caught", (-F.col("g")).alias("up"))))["up"]
    value = lambda up: F.get(F.array(*map(F.lit, GRID)), (-up).cast("int"))
    return steps.groupBy("stratum").agg(F.array(*(F.struct(*(value(best(q, r)).alias(r) for r in RULES)) for q in SHARES)).alias("path"))


def _any(cut: Column) -> Column:
    """Whether a document reaches one of a set's cutoffs."""
    hit = F.lit(False)
    for r, c in _shares().items():
        hit = hit | F.coalesce(c >= cut[r], F.lit(False))
    return hit


def few(df: DataFrame, most: int = 100_000) -> DataFrame:
    """For a broadcast join if it has at most so many rows, which are counted; else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def cutoffs(labelled: DataFrame, risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """labelled: id, stratum, quality, fit, the measures -> a row for each stratum with a certified set.

    cut: struct of each rule's cutoff; step: its place in SHARES; holdout, rejected: n and k; chance: of k or fewer at `risk`.
    """
    paths = labelled.select("stratum").distinct().join(few(proposals(labelled)).withColumnRenamed("stratum", "_s"), F.col("stratum").eqNullSafe(F.col("_s")), "left").drop("_s")
    paths = few(paths).withColumnRenamed("stratum", "_s")
    # one pass: of each label, which sets reject it
    marked = labelled.join(paths, F.col("stratum").eqNullSafe(F.col("_s"))).select("stratum", "fit", "quality", "path", F.transform("path", _any).alias("hits"))
    held = ~F.col("fit") & (F.col("quality") == 1)
    per = [F.struct(F.lit(j).alias("j"), F.count_if(held & F.col("hits")[j]).alias("k"), F.count_if(held).alias("n"), F.count_if(F.col("fit") & (F.col("quality") == 0) & F.col("hits")[j]).alias("caught")) for j in range(len(SHARES))]
    tests = marked.groupBy("stratum").agg(F.array(*per).alias("t"), F.first("path").alias("path"))
    strata = tests.agg(F.count("*").alias("strata"))  # one row
    tests = tests.crossJoin(F.broadcast(strata)).select("stratum", "path", "strata", F.explode("t").alias("t")).select("stratum", "path", "strata", "t.*")
    tests = tests.withColumn("chance", binomial_at_most(F.col("k"), F.col("n"), risk))
    ok = (F.col("n") > 0) & (F.col("chance") <= delta / F.col("strata"))
    tests = tests.withColumn("ok", F.min(ok).over(Window.partitionBy("stratum").orderBy("j"))).where("ok and caught > 0")
    pick = F.max(F.struct("caught", (-F.col("j")).alias("up"), "k", "n", "chance"))
    out = tests.groupBy("stratum").agg(pick.alias("p"), F.first("path").alias("path"))
    return out.select("stratum", F.get("path", (-F.col("p.up")).cast("int")).alias("cut"), (-F.col("p.up")).cast("int").alias("step"), F.col("p.n").alias("holdout"), F.col("p.k").alias("rejected"), F.col("p.chance").alias("chance"))


def judged(measured: DataFrame, found: DataFrame, stratum: Column) -> DataFrame:
    """measured with base_failed, kept, reason (base, the first rule that rejects it, or null), that rule's cutoff, and
    of the stratum's certificate holdout, rejected and chance (null where none was certified)."""
    sets = few(found.select(F.col("stratum").alias("_stratum"), F.col("cut").alias("_cut"), "holdout", "rejected", "chance"))
    df = measured.withColumn("_own", stratum).join(sets, F.col("_own").eqNullSafe(F.col("_stratum")), "left")
    reason, cutoff = F.when(base_failed(), "base"), F.when(base_failed(), F.lit(None).cast("double"))
    for r, c in _shares().items():
        reason, cutoff = reason.when(c >= F.col("_cut")[r], r), cutoff.when(c >= F.col("_cut")[r], F.col("_cut")[r])
    df = df.withColumn("base_failed", base_failed()).withColumn("reason", reason).withColumn("cutoff", cutoff).withColumn("kept", F.col("reason").isNull())
    return df.drop("_own", "_stratum", "_cut")


def labelled_measures(measured: DataFrame, labels: DataFrame, stratum: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """Measures of labelled documents with id, stratum, quality and fit."""
    marks = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("quality"))
    fit = F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(FIT)) == 0
    return measured.join(marks, F.col(id_col) == F.col("_id")).withColumn("id", F.col(id_col)).withColumn("stratum", F.col(stratum)).withColumn("fit", fit)


def quality_table(docs: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """One row a document: doc_id, lang, measures and verdict. Texts are read once; the measures are written and read twice."""
    space = Workspace(docs.sparkSession, "quality")
    measured = space.keep(measures(docs.select("doc_id", "lang", "text")).drop("text"))
    found = space.keep(cutoffs(labelled_measures(measured, labels), risk, delta))
    return judged(measured, found, F.col("lang"))


def keep_good(docs: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.05, space: Workspace | None = None) -> DataFrame:
    """The documents that pass, all columns unchanged. Texts are measured once, written with their measures and never shuffled.

    space: where; its caller clears it when the result was used.
    """
    space = space or Workspace(docs.sparkSession, "quality")
    names = [f"_c{i}" for i in range(len(docs.columns))]  # own columns may have the measures' names
    inner = docs.select(*(F.col(c).alias(n) for c, n in zip(docs.columns, names)))
    text, lang, ids = (names[docs.columns.index(c)] for c in ("text", "lang", "doc_id"))
    measured = space.keep(measures(inner, text))
    found = space.keep(cutoffs(labelled_measures(measured.drop(text), labels, lang, ids), risk, delta))
    out = judged(measured, found, F.col(lang)).where("kept")
    return out.select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names)))
