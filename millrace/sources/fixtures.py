"""The driver's tables seen as the engine's concepts: outbox, change stream, deliveries, sagas and so on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest(df: DataFrame, ts: str) -> Column:
    """The last time of a table as a literal without zone: bounds made of it reach the scan, as those of a joined maximum do not."""
    found = df.agg(F.max(F.col(ts).cast("timestamp_ntz")).cast("string")).first()[0]
    return F.lit(found).cast("timestamp_ntz")


def outbox(spark: SparkSession, sf_dir: str, waiting: bool = False) -> DataFrame:
    """Orders as outbox rows: open orders wait to be published; urgent ones name their topic.

    ``waiting``: only open orders, stated on the stored column, as a filter on the derived one does not reach the scan.
    """
    orders = table(spark, sf_dir, "orders")
    if waiting:
        orders = orders.filter(F.col("o_orderstatus") == "O")
    cents = F.round(F.col("o_totalprice") * 100).cast("long").cast("string")
    return orders.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("evt-"), F.col("o_orderkey").cast("string")).alias("event_id"),
        F.lit("order").alias("aggregate_type"),
        F.col("o_custkey").cast("string").alias("aggregate_id"),
        F.concat(F.lit("Order"), F.col("o_orderstatus")).alias("event_type"),
        F.concat(F.lit('{"cents":'), cents, F.lit(',"priority":"'), F.col("o_orderpriority"), F.lit('"}')).alias("payload"),
        F.when(F.col("o_orderstatus") == "O", "pending").otherwise("published").alias("status"),
        F.when(F.col("o_orderpriority").startswith("1"), "orders-urgent").alias("kafka_topic"),
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("k-"), F.col("o_orderkey").cast("string"))).alias("kafka_key"),
        F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate") + F.expr("interval 1 hour")).alias("published_at"),
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a change stream keyed by user: signups create, errors delete, the rest updates."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("key"),
        F.col("event_id").alias("lsn"),
        F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("table"),
        F.when(kind == "signup", "c").when(kind == "error", "d").otherwise("u").alias("op"),
        F.when(kind != "error", F.col("value")).alias("after"),
        F.col("ts").alias("occurred_at"),
    )


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages, with copies of every seventh half a day and a day and a half later."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", (F.col("event_id") * 10).alias("offset"))
    some = e.filter(F.col("event_id") % 7 == 0)
    copy = lambda hours, n: some.withColumns({"ts": F.col("ts") + F.expr(f"interval {hours} hours"), "offset": F.col("offset") + n})
    return e.unionByName(copy(12, 1)).unionByName(copy(36, 2))


DELIVERIES_SQL = """
deliveries AS (
  SELECT event_id, ts, user_id, event_type, value, event_id * 10 AS "offset" FROM events
  UNION ALL SELECT event_id, ts + INTERVAL 12 HOUR, user_id, event_type, value, event_id * 10 + 1 FROM events WHERE event_id % 7 = 0
  UNION ALL SELECT event_id, ts + INTERVAL 36 HOUR, user_id, event_type, value, event_id * 10 + 2 FROM events WHERE event_id % 7 = 0
)"""

OUTBOX_SQL = """
outbox AS (
  SELECT o_orderkey AS id, 'evt-' || o_orderkey AS event_id, CAST(o_custkey AS VARCHAR) AS aggregate_id,
    '{"cents":' || CAST(round(o_totalprice * 100) AS BIGINT) || ',"priority":"' || o_orderpriority || '"}' AS payload,
    CASE WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'published' END AS status,
    CASE WHEN starts_with(o_orderpriority, '1') THEN 'orders-urgent' END AS kafka_topic,
    CASE WHEN o_orderkey % 3 = 0 THEN 'k-' || o_orderkey END AS kafka_key,
    CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL 1 HOUR END AS published_at, o_orderdate AS created_at
  FROM orders
)"""

CHANGES_SQL = """
changes AS (
  SELECT user_id AS key, event_id AS lsn, 't' || (user_id % 3) AS "table",
    CASE event_type WHEN 'signup' THEN 'c' WHEN 'error' THEN 'd' ELSE 'u' END AS op,
    CASE WHEN event_type <> 'error' THEN value END AS after, ts AS occurred_at
  FROM events
)"""


def saga_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as steps of their order's saga; returned ones failed."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("saga_id"), (F.row_number().over(w) - 1).cast("long").alias("step"), (F.col("l_returnflag") == "R").alias("failed")
    )


SAGA_SQL = """
steps AS (
  SELECT l_orderkey AS saga_id, row_number() OVER (PARTITION BY l_orderkey
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS step, l_returnflag = 'R' AS failed
  FROM lineitem
)"""

FLAGS = [("click", True, 50), ("error", False, 100), ("purchase", True, None), ("signup", True, 25), ("view", True, 0)]
FLAGS_SQL = "flags(name, enabled, rollout) AS (VALUES ('click', TRUE, 50), ('error', FALSE, 100), ('purchase', TRUE, NULL), ('signup', TRUE, 25), ('view', TRUE, 0))"
SUBSCRIPTIONS = [
    ("s1", "https://a.example/hook", ["purchase", "signup"], True, "webhook-secret"),
    ("s2", "https://b.example/hook", ["error"], True, "second"),
    ("s3", "https://c.example/hook", ["click", "view", "purchase"], False, "third"),
    ("s4", "https://d.example/hook", ["purchase"], True, "a secret that is much longer than the sixty-four bytes of one hash block"),
]
SUBSCRIPTIONS_SQL = """subscriptions(subscription_id, endpoint_url, event_types, enabled) AS (VALUES
  ('s1', 'https://a.example/hook', ['purchase', 'signup'], TRUE), ('s2', 'https://b.example/hook', ['error'], TRUE),
  ('s3', 'https://c.example/hook', ['click', 'view', 'purchase'], FALSE), ('s4', 'https://d.example/hook', ['purchase'], TRUE))"""


def flags(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FLAGS, "name string, enabled boolean, rollout int")


def subscriptions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SUBSCRIPTIONS, "subscription_id string, endpoint_url string, event_types array<string>, enabled boolean, secret string")


def utc_text_sql(ts: str) -> str:
    """SQL for a time in UTC as text, with 0, 3 or 6 digits of its fraction."""
    us = f"epoch_us({ts}) % 1000000"
    return f"""strftime({ts}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN {us} = 0 THEN '' WHEN {us} % 1000 = 0 THEN '.' || lpad(CAST({us} // 1000 AS VARCHAR), 3, '0')
    ELSE '.' || lpad(CAST({us} AS VARCHAR), 6, '0') END || 'Z'"""
