"""A corpus from documents: good ones, one of each near-duplicate group, without repeats, mixed, encoded.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. run() writes each
stage's rows to the shared folder and reads them for the next.
"""
from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.bpe import encode_documents
from sightline.llm.mixing import mixed_documents
from sightline.llm.near_dup import near_duplicates
from sightline.llm.quality import keep_good
from sightline.llm.queries import vocabulary
from sightline.llm.repeats import strip_repeats
from sightline.llm.workspace import Workspace, table

_left = threading.local()


def _space(spark: SparkSession, sf_dir: str, name: str) -> Workspace:
    """A stage's tables; those of the stage before go, as its rows are written by now. Each thread has its own, so that two runs over one folder
    don't take each other's; within a thread a stage's rows must be written before the next stage of the same folder is called."""
    mine = _left.__dict__.setdefault("spaces", {})
    before = mine.pop((spark.sparkContext.applicationId, sf_dir), None)
    if before is not None:
        before.clear()
    space = mine[spark.sparkContext.applicationId, sf_dir] = Workspace(spark, f"pipeline-{name}")
    return space


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a certified cutoff reject go. Null and empty texts have under 20 words, so they go; a null
    language is a stratum of its own; without labels only the base rules reject."""
    return keep_good(docs, table(spark, sf_dir, "labels"), space=_space(spark, sf_dir, "quality"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the document of smallest id stays, with all rows that have this id; rows without an id stay. Shingles of five words, similarity 0.8."""
    space = _space(spark, sf_dir, "near")
    gone = space.keep(near_duplicates(docs, space=space).where("not kept").select(F.col("doc_id").alias("_gone")).distinct())
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars follows the text where words went. Rows without text or words stay as they are."""
    _space(spark, sf_dir, "substrings")
    out = strip_repeats(docs)
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, whole; those it doesn't take go."""
    return mixed_documents(docs, space=_space(spark, sf_dir, "mixing"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids instead of text, with their number and digests. Null texts are empty: no ids."""
    _space(spark, sf_dir, "encode")
    return encode_documents(docs, *vocabulary(), keep_machine=False)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substrings", substrings), ("mixing", mixing), ("encode", encode)]

#: Cutoffs by exact binomial bounds and BPE can't be expressed in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    space, docs = Workspace(spark, "pipeline"), table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = space.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
