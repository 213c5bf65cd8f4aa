"""Point reads of stored tables, and raw SQL: the calls of a client library, as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def load_flags(flags: DataFrame) -> DataFrame:
    return flags.orderBy("name")


def load_flag(flags: DataFrame, name: str) -> Row | None:
    return flags.filter(F.col("name") == name).first()


def load_checkpoint(checkpoints: DataFrame, pattern: str, pipeline: str) -> Row | None:
    """The checkpoint of a pattern's pipeline; the filter reaches the scan."""
    return checkpoints.filter((F.col("pattern_name") == pattern) & (F.col("pipeline_name") == pipeline)).first()


def dead_letters(dlq: DataFrame, topic: str) -> DataFrame:
    return dlq.filter(F.col("dlq_topic") == topic)


def execute(spark: SparkSession, sql: str, **params) -> int:
    """Runs a statement with named parameters; how many rows it gives."""
    return spark.sql(sql, args=params).count()


def fetch_optional(spark: SparkSession, sql: str, **params) -> str | None:
    """First column of the first row as a string, or None."""
    row = spark.sql(sql, args=params).first()
    return None if row is None or row[0] is None else str(row[0])


def foreign_key_report(children: dict[str, tuple[DataFrame, DataFrame, str]]) -> dict[str, int]:
    """Rows that break each named foreign key, as (children, parents, key)."""
    out = {}
    for name, (child, parent, key) in children.items():
        out[name] = child.filter(F.col(key).isNotNull()).join(parent.select(key).distinct(), key, "left_anti").count()
    return out


def check_report(table: DataFrame, **checks) -> dict[str, int]:
    """Rows that fail each named condition; unknown (null) passes, as in SQL."""
    row = table.agg(*(F.count_if(~condition).alias(name) for name, condition in checks.items())).first()
    return {name: row[name] for name in checks}
