"""Shared-folder tables that cut lineage, and small helpers all operators use."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from millrace.session import shared_dir

BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes: long texts would else fill tens of megabytes, twice, in the JVM and in Python.

    A smaller bound set by the user stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    bytes_now = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)))
    if bytes_now <= 0 or bytes_now > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


_LEFT: list[tuple[SparkSession, str]] = []


@atexit.register
def _tidy() -> None:
    """At the end of the program results are read: what operators wrote on their way goes."""
    for spark, base in _LEFT:
        if spark.sparkContext._jsc is not None:
            _delete(spark, base)


class Scratch:
    """Writes tables to the shared folder and rereads them, so that a lost executor costs no recomputation.

    ``keep`` returns the reread table; ``drop`` deletes a table that nothing reads any more. The rest goes when the
    program ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        small_batches(spark)
        self.spark = spark
        self.base = f"{shared_dir(spark)}/millrace-{label}-{uuid.uuid4().hex[:12]}"
        _LEFT.append((spark, self.base))
        self.n = 0
        self.paths: dict[int, str] = {}

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.base}/{self.n:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = self.paths.pop(id(df), None)
        if path:
            _delete(self.spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
