"""Mixing sources to target weights, in DataFrame functions only.

Every document gets a hash-random key. Within its source the documents are ordered by key; a prefix
sum of their sizes tells which of them an epoch's budget reaches, and the budget is cut exactly: the
document at the cut gives only its first words. A budget above the source's size is repeated epochs.

The prefix sums are distributed: keys of a source fall into ranges of some thousand documents
(keys are random, so ranges are even however large a source is), each range is summed, the range sums
are added up per source, and only then are rows added up within their range. No task holds a source.

Targets: weights share the total of all sizes; a target stops at max_epochs times its source's size,
and the excess is reshared by weight until none is above. That is min(cap, weight * level): with the
sources in order of cap / weight, the level is (total - caps before) / (weights from here on) at the
first source that stays below its cap.

Null text counts 0 words; null sources form one source, last in order. Rows with equal ids have equal
keys and are ordered by size; sources of size 0 have target 0 and give nothing. An empty table gives an
empty table.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace, aside, shuffle_partitions

WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, max_epochs: int = 3, weights: tuple = (1, 2, 3)) -> DataFrame:
    """sizes: source, size -> one row a source: source, n_docs, source_size, weight, target.

    Ordering and levels are windows over the sources, one row each, not over documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("long"))
    per = per.withColumn("_cap", F.lit(max_epochs) * F.col("source_size"))
    up = Window.orderBy((F.col("_cap") / F.col("weight")), F.col("source").asc_nulls_last())
    before, everything = up.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("_caps", F.coalesce(F.sum("_cap").over(before), F.lit(0))).withColumn("_rest", F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing)))
    per = per.withColumn("_level", (F.sum("source_size").over(everything) - F.col("_caps")) / F.col("_rest"))
    level = F.min(F.when(F.col("_level") * F.col("weight") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("weight"), F.col("_level").alias("level"))))
    per = per.withColumn("_at", level.over(everything)["level"])
    target = F.when(F.col("_at").isNull() | (F.col("_at") * F.col("weight") > F.col("_cap")), F.col("_cap").cast("double")).otherwise(F.col("_at") * F.col("weight"))
    return per.select("source", "n_docs", "source_size", "weight", target.alias("target"))


def mix(sizes: DataFrame, id_col: str = "doc_id", per_range: int | None = None, max_epochs: int = 3, max_sources_shipped: int = 20_000, whole: bool = False) -> DataFrame:
    """sizes (id, source, size) with source_size, target, taken; other columns come back under any name, those with the new names are replaced.

    whole: the document at the cut is taken whole if that comes nearer to the budget than leaving it.
    per_range: documents of a range; by default a quarter of a shuffle partition's share, between 2,000 and 50,000. Ranges spread
    the work and never change the result. sizes is read four times: pass a written table.
    """
    own, back = aside(sizes, id_col, "source", "size", "source_size", "target", "taken")
    names = [c for c in sizes.columns if c not in ("source_size", "target", "taken")]
    rest = iter(back)
    named = {c: F.col("_id").alias(c) if c == id_col else F.col(c) if c in ("source", "size") else next(rest) for c in names}
    sizes = sizes.select(*own, F.col(f"`{id_col}`").alias("_id"), "source", "size")
    goals = source_targets(sizes.select("source", "size"), max_epochs)
    if per_range is None:
        per_range = min(50_000, max(2_000, sizes.count() // (4 * shuffle_partitions(sizes.sparkSession))))
    few = goals.limit(max_sources_shipped + 1).count() <= max_sources_shipped
    goals = goals.withColumn("_ranges", F.greatest(F.lit(1), F.ceil(F.col("n_docs") / per_range))).withColumnRenamed("source", "_source")
    key = F.substring(F.md5(F.coalesce(F.col("_id").cast("string"), F.lit(""))), 1, 15)
    rows = sizes.withColumn("_key", key)
    if few:  # a bounded number of rows, counted above
        rows = rows.join(F.broadcast(goals), F.col("source").eqNullSafe(F.col("_source")))
    else:  # many sources: salted, so that one large source is not one task
        salted = goals.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
        rows = rows.withColumn("_own", F.conv(F.substring("_key", 1, 1), 16, 10).cast("int")).join(salted, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_own") == F.col("_salt"))).drop("_own", "_salt")
    part = F.floor(F.conv(F.substring("_key", 1, 7), 16, 10).cast("double") / F.lit(float(16**7)) * F.col("_ranges"))
    rows = rows.withColumn("_range", part).withColumn("source", F.col("source"))
    sums = rows.groupBy("source", "_range").agg(F.sum("size").alias("_sum"))
    ahead = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("_s"), F.col("_range").alias("_r"), F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    within = Window.partitionBy("source", "_range").orderBy("_key", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_start", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
    start, budget = F.col("_start") + F.col("_ahead"), F.floor("target")
    epochs = F.floor(budget / F.greatest(F.col("source_size"), F.lit(1)))
    left = budget - epochs * F.col("source_size") - start
    part = F.when(left * 2 >= F.col("size"), F.col("size")).otherwise(F.lit(0)) if whole else F.least(F.col("size"), left)
    taken = epochs * F.col("size") + F.when(left > 0, part).otherwise(F.lit(0))
    return rows.select(*named.values(), "source_size", "target", taken.cast("long").alias("taken"))


def document_sizes(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    return docs.select(id_col, "source", word_count(text).alias("size"))


def mixed_documents(docs: DataFrame, max_epochs: int = 3, space: Workspace | None = None) -> DataFrame:
    """docs (doc_id, source, text and any others) with each row repeated as often as the mix takes it, whole documents only.

    Decisions are made on (id, source, size); the texts themselves move only in the join by id, whose
    keys are even. Rows with equal ids and different texts are told apart by source and size.
    """
    space = space or Workspace(docs.sparkSession, "mix")
    sizes = space.keep(document_sizes(docs))
    taken = mix(sizes, max_epochs=max_epochs, whole=True)
    times = taken.where("taken > 0").groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size")).agg(F.sum("taken").alias("_taken"), F.count("*").alias("_same"))
    own, back = aside(docs)
    inner = docs.select(*own, F.col("doc_id").alias("_doc"), F.col("source").alias("_from"), word_count("text").alias("_n"))
    joined = inner.join(times, F.col("_doc").eqNullSafe(F.col("_id")) & F.col("_from").eqNullSafe(F.col("_source")) & (F.col("_n") == F.col("_size")))
    n = F.ceil(F.col("_taken") / (F.col("_size") * F.col("_same"))).cast("int")
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), n))).select(*back)
