"""Intermediate tables in the folder that driver and executors share."""
from __future__ import annotations

import gc
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


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python workers in batches of 8 MB at most, where the session leaves Spark's 64 MB."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).rstrip("b") == str(64 << 20):
        spark.conf.set(key, str(8 << 20))


class Workspace:
    """Written tables that cut lineage and survive lost executors.

    keep() writes a table once and reads it back; drop() removes tables that no later plan reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        small_batches(spark)

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._kept_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            self._delete(df._kept_path)

    def drop_but(self, *frames: DataFrame) -> None:
        """All tables so far but these."""
        stay = {df._kept_path for df in frames}
        for n in range(1, self.n + 1):
            if f"{self.root}/{n}" not in stay:
                self._delete(f"{self.root}/{n}")

    def clear(self) -> None:
        """All tables; frames that read them are used no more."""
        self._delete(self.root)

    def settle(self) -> None:
        """Has Spark remove exchanges that no plan can read any more; it does so for those that the driver's collector finds."""
        gc.collect()
        self.spark._jvm.System.gc()

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def aside(df: DataFrame, *replaced: str) -> tuple[list, list]:
    """(columns of df under plain names _c0, _c1, ..., the same back under their own) but for those that an operator replaces: so no column
    of the caller's meets a name of ours."""
    from pyspark.sql import functions as F

    own = [c for c in df.columns if c not in replaced]
    return [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(own)], [F.col(f"_c{i}").alias(c) for i, c in enumerate(own)]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(df: DataFrame, text: str, part_mb: int) -> int:
    """Parts of about part_mb of text, and at least the session's shuffle partitions."""
    from pyspark.sql import functions as F

    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(shuffle_partitions(df.sparkSession), -(-total // (part_mb << 20)))


def dealt(df: DataFrame, n: int, id_col: str, text: str) -> DataFrame:
    """df with _part, n parts of about equal text, each whole in one partition.

    Rows go by a hash of id and text. Rows that are repeated more than a part should hold would all go to
    one, so each part of the scan deals its own rows on: the hash is salted by the row's place there, in
    steps of 64 rows. The place is part of the row once it is written by the exchange, and the exchange is
    read again, not made again, by every pass over the parts of one job.
    """
    from pyspark.sql import functions as F

    salt = F.shiftright(F.monotonically_increasing_id(), 6)
    return df.withColumn("_part", F.pmod(F.xxhash64(id_col, text, salt), F.lit(n)).cast("int")).repartition(n, "_part")
