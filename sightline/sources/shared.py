"""The folder that driver and executors share."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only where that is unset on one machine, a folder of this process."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="sightline-")
    return _own[app]


def hadoop(spark: SparkSession, path: str):
    """(file system, path) of a path in any store that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


class Bucketed:
    """Tables in the shared folder, bucketed by keys: joins and groups by these keys take no exchange. Their names go when they are dropped."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.tag, self.n = f"_{name}_{uuid.uuid4().hex[:12]}", 0
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def keep(self, df: DataFrame, *keys: str) -> DataFrame:
        self.n += 1
        name = f"{self.tag}_{self.n}"
        df.write.bucketBy(self.buckets, *keys).sortBy(*keys).option("path", f"{self.root}/{self.n}").format("parquet").saveAsTable(name)
        out = self.spark.table(name)
        out._table = name, f"{self.root}/{self.n}"
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            name, path = df._table
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            fs, p = hadoop(self.spark, path)
            fs.delete(p, True)
