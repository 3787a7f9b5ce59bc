"""Line-delimited JSON journals."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CORRUPT = "_corrupt"


def jsonl_rows(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """lines (value) -> the fields of schema and _bad: whether the line isn't a JSON object. Blank lines are left out; an object of other keys is a row of nulls."""
    full = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    parsed = lines.where(F.trim("value") != "").select("value", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}).alias("r"))
    bad = F.col("r").isNull() | F.col(f"r.{_CORRUPT}").isNotNull() | ~F.ltrim("value").startswith("{")
    return parsed.select(*(F.col(f"r.`{f.name}`") for f in schema.fields), bad.alias("_bad"))


def jsonl_scan(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Rows of the journal, and one row with corrupt_count.

    Blank lines are skipped, lines that aren't a JSON object are counted and skipped, bytes that aren't
    UTF-8 are replaced. An object of other keys is a row of nulls, not a corrupt line.
    """
    rows = jsonl_rows(spark.read.text(path), schema)
    return rows.where("NOT _bad").drop("_bad"), rows.agg(F.count_if("_bad").alias("corrupt_count"))


def jsonl_append(df: DataFrame, path: str) -> None:
    """Each append adds whole files, so a torn write never joins two records."""
    df.write.mode("append").json(path)


def journal_tail(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """New journal files as a stream; the checkpoint of its query remembers what was read. Files that grow: tail.tail()."""
    return spark.readStream.schema(schema).json(path)
