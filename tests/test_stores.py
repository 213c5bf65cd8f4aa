"""Point reads, raw SQL and constraint reports."""

from pyspark.sql import functions as F

from millrace.sources import stores


def test_point_reads_and_sql(spark):
    flags = spark.createDataFrame([("b", True, 10), ("a", False, None), ("c", True, 200)], "name string, enabled boolean, rollout int")
    assert [r.name for r in stores.load_flags(flags).collect()] == ["a", "b", "c"]
    assert stores.load_flag(flags, "b").rollout == 10 and stores.load_flag(flags, "x") is None
    checkpoints = spark.createDataFrame([("outbox", "p", 3, "1/6AF6A8F4")], "pattern_name string, pipeline_name string, version long, pg_lsn string")
    assert stores.load_checkpoint(checkpoints, "outbox", "p").version == 3
    assert stores.load_checkpoint(checkpoints, "outbox", "q") is None
    flags.createOrReplaceTempView("flags_for_test")
    assert stores.execute(spark, "SELECT * FROM flags_for_test WHERE enabled = :on", on=True) == 2
    assert stores.fetch_optional(spark, "SELECT rollout FROM flags_for_test WHERE name = :n", n="b") == "10"
    assert stores.fetch_optional(spark, "SELECT rollout FROM flags_for_test WHERE name = :n", n="a") is None
    assert stores.fetch_optional(spark, "SELECT 1 WHERE false") is None
    assert stores.check_report(flags, rollout=F.col("rollout").between(0, 100)) == {"rollout": 1}


def test_foreign_keys(spark):
    sagas = spark.createDataFrame([("s1",)], "saga_id string")
    steps = spark.createDataFrame([("s1", 0), ("s2", 0), (None, 1)], "saga_id string, step int")
    assert stores.foreign_key_report({"steps": (steps, sagas, "saga_id")}) == {"steps": 1}
    dlq = spark.createDataFrame([("t.dlq.a", 1), ("t.dlq.b", 2)], "dlq_topic string, n int")
    assert [r.n for r in stores.dead_letters(dlq, "t.dlq.b").collect()] == [2]
