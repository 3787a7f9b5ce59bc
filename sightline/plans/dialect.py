"""One text for both engines: plans are Spark SQL, and a few @ marks have a spelling for DuckDB."""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: mark -> (Spark, DuckDB)
MARKS = {
    "@UNNEST(": ("explode(", "unnest("),
    "@PCT(": ("percentile(", "quantile_cont("),
    "@SIZE(": ("size(", "len("),
    "@LIST(": ("collect_list(", "list("),
    "@SORTED(": ("array_sort(", "list_sort("),
    "@EL(": ("element_at(", "list_extract("),
    "@BYTES(": ("octet_length(", "strlen("),
    "@JSONK": ("CAST(get_json_object(props, '$.k') AS BIGINT)", "CAST(json_extract_string(props, '$.k') AS BIGINT)"),
}


def round6(x: str) -> str:
    """DuckDB's round(x, 6) of a double: of x times a million, halves away from zero; x itself where that is infinite. Spark's own rounds the decimal that x prints as."""
    y = f"(({x}) * 1E6D)"
    whole = f"(rint({y}) + CASE WHEN {y} > 0 AND {y} - rint({y}) = 0.5D THEN 1 WHEN {y} < 0 AND rint({y}) - {y} = 0.5D THEN -1 ELSE 0 END)"
    return f"CASE WHEN abs({y}) = double('Infinity') THEN {x} ELSE {whole} / 1E6D END"


def _marks(sql: str, duck: bool) -> str:
    sql = re.sub(r"@MICROS\(([\w.]+)\)", r"epoch_us(\1)" if duck else r"unix_micros(CAST(\1 AS TIMESTAMP))", sql)
    sql = re.sub(r"@AT\((\d)\)", r"CAST(embedding[\1] AS DOUBLE)" if duck else r"CAST(element_at(embedding, \1) AS DOUBLE)", sql)
    sql = re.sub(r"@TOKENS\(([\w.]+)\)", r"regexp_extract_all(lower(coalesce(\1, '')), '[a-z0-9]+')" if duck else r"regexp_extract_all(lower(coalesce(\1, '')), '[a-z0-9]+', 0)", sql)
    for mark, pattern in (("@WORDS2", "[a-z0-9][a-z0-9]+"), ("@NUMBERS", "[0-9]+")):
        sql = re.sub(mark + r"\(([\w.]+)\)", rf"regexp_extract_all(lower(coalesce(\1, '')), '{pattern}'{'' if duck else ', 0'})", sql)
    sql = re.sub(r"@XOR\((\w+), (\w+)\)", r"xor(\1, \2)" if duck else r"(\1 ^ \2)", sql)
    sql = re.sub(r"@EMA\((\w+), ([\d.]+)\)", r"list_reduce(\1, lambda y, x: y + \2 * (x - y))" if duck else r"reduce(slice(\1, 2, size(\1)), element_at(\1, 1), (y, x) -> y + CAST(\2 AS DOUBLE) * (x - y))", sql)
    sql = re.sub(r"@ROUND6\(([^()]+)\)", lambda m: f"round({m[1]}, 6)" if duck else round6(m[1]), sql)
    if duck:
        sql = re.sub(r"sha2\((.*), 256\) AS", r"sha256(\1) AS", sql).replace("LEFT ANTI JOIN", "ANTI JOIN")
    for mark, spelt in MARKS.items():
        sql = sql.replace(mark, spelt[duck])
    return sql


def used(sql: str) -> list[str]:
    return [t for t in TABLES if re.search(rf"\{{{t}\}}", sql)]


def run(sql: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_marks(sql, False), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used(sql)})


def oracle(sql: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", _marks(sql, True))
