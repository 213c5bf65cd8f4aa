"""Queries over the driver's tables, each with the SQL that states its result: relay, dedup, change data, lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import scalars as S
from millrace.operators import dedup, lookup, metrics, outbox
from millrace.sources import fixtures as X

NOW = "(SELECT max(ts) FROM events)"


def _now(spark, d):
    return X.latest(X.table(spark, d, "events"), "ts")


def outbox_relay_batch(spark, d):
    return outbox.to_messages(outbox.pending(X.outbox(spark, d, waiting=True), 100), "orders")


def outbox_backlog_by_topic(spark, d):
    waiting = outbox.pending(X.outbox(spark, d, waiting=True))
    return outbox.to_messages(waiting, "orders").groupBy("topic").agg(F.count("*").alias("pending"))


def outbox_mark_published(spark, d):
    box = X.outbox(spark, d)
    sent = outbox.pending(box).filter("id % 2 = 0").select("id")
    out = outbox.mark_published(box, sent, F.col("created_at") + F.expr("interval 2 hours"))
    return out.select("id", "status", "published_at")


def outbox_reap(spark, d):
    box = X.outbox(spark, d)
    return outbox.reap(box, X.latest(box, "created_at"), 7 * 86_400).select("id", "status", "created_at")


def inbox_dedup_first(spark, d):
    return dedup.firsts(X.deliveries(spark, d).select("event_id", "ts", "offset"), ["event_id"], ["offset"])


def inbox_dedup_ttl(spark, d):
    out = dedup.ttl_dedup(X.table(spark, d, "events").select("user_id", "event_id", "ts"), ["user_id"], "ts", ["event_id"], 6 * 3600)
    return out.select("user_id", "event_id", "ts", "is_new")


def inbox_redelivery_ttl(spark, d):
    out = dedup.ttl_dedup(X.deliveries(spark, d).select("event_id", "offset", "ts"), ["event_id"], "ts", ["offset"], 86_400)
    return out.select("event_id", "offset", "is_new")


def inbox_anti_join(spark, d):
    seen = X.table(spark, d, "events").filter("event_id % 5 = 0").select("event_id")
    return dedup.not_seen(X.table(spark, d, "events").select("event_id", "user_id"), seen, ["event_id"])


def idempotent_responses(spark, d):
    m = X.deliveries(spark, d).select("event_id", "offset", "ts").withColumns(
        {"request": F.concat(F.lit("payments:"), F.col("event_id").cast("string")), "response": F.concat(F.lit("r-"), F.col("offset").cast("string"))}
    )
    out = dedup.idempotent_responses(m, "request", "ts", ["offset"], "response", 86_400)
    return out.select("request", "offset", "is_new", "given", dedup.http_gate(F.col("is_new"), F.col("request")).alias("status"))


def idempotency_unexpired(spark, d):
    now = _now(spark, d)
    # A record lives a day: the bound on the stored column prunes the scan, the one on the expiry states the rule.
    recent = X.table(spark, d, "events").filter(F.col("ts") > now - F.expr("interval 24 hours"))
    records = recent.select("event_id", (F.col("ts") + F.expr("interval 24 hours")).alias("expires_at"))
    return dedup.unexpired(records, now).select("event_id", "expires_at")


def cdc_latest_state(spark, d):
    return dedup.latest_state(X.changes(spark, d), ["key"], "lsn", "op", "after")


def cdc_latest_nullify(spark, d):
    return dedup.latest_state(X.changes(spark, d), ["key"], "lsn", "op", "after", "nullify")


def cdc_truncate_aware(spark, d):
    c = X.changes(spark, d).withColumn("op", F.when(F.col("lsn") % 1000 == 500, "t").otherwise(F.col("op")))
    return dedup.after_truncate(c, "table", "lsn", "op").select("table", "lsn", "op")


def cdc_max_lsn_by_batch(spark, d):
    c = X.changes(spark, d).withColumn("batch", F.floor(F.col("lsn") / 500))
    return c.groupBy("batch").agg(F.count("*").alias("published"), F.greatest(F.max("lsn"), F.lit(100)).alias("position"))


def cdc_table_topics(spark, d):
    c = X.changes(spark, d).filter(F.col("table").isin("t0", "t2"))
    return c.withColumn("topic", F.concat_ws(".", F.lit("cdc"), F.lit("public"), "table")).groupBy("topic", "op").agg(F.count("*").alias("n"))


def lsn_text_roundtrip(spark, d):
    big = F.col("event_id") * 4_294_967_311 + 12_345
    out = X.table(spark, d, "events").select("event_id", big.alias("lsn")).withColumn("text", S.lsn_to_text(F.col("lsn")))
    return out.withColumn("back", S.text_to_lsn(F.col("text")))


def dual_read_merge(spark, d):
    c = X.changes(spark, d).filter("op <> 'd'").select("key", "lsn", "after")
    snap, replay = c.filter("lsn % 3 = 0"), c.filter("lsn % 3 <> 0")
    latest = lambda x: x.groupBy("key").agg(F.max_by("after", "lsn").alias("after"), F.max("lsn").alias("lsn"))
    return dedup.newest(latest(snap), latest(replay), ["key"], "lsn").select("key", "lsn", "after")


def _probes(spark, d):
    customer = X.table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"))
    requests = X.table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") + F.col("o_orderkey") % 2 * 1_000_000_000 * (F.col("o_orderkey") % 10 == 1).cast("int")).alias("key"))
    return lookup.cache_aside(requests, customer.filter("key % 3 <> 0"), customer, "key", "value")


def cache_aside_outcomes(spark, d):
    return _probes(spark, d).select("o_orderkey", "key", "value", "outcome")


def cache_hit_ratio(spark, d):
    return lookup.hit_ratio(_probes(spark, d))


def feature_lookup_ladder(spark, d):
    e = X.table(spark, d, "events")
    latest = lambda x: x.groupBy(F.col("user_id").alias("key")).agg(F.max_by("value", "event_id").alias("value"), F.max("ts").alias("computed_at"))
    keys = e.select(F.col("user_id").alias("key")).distinct()
    online = latest(e.filter("event_type = 'view' and user_id % 4 <> 0"))
    offline = latest(e.filter("event_type = 'click' and user_id % 3 <> 0"))
    return lookup.feature_lookup(keys, online, offline, "key", _now(spark, d), 3 * 86_400).select("key", "value", "source", "write_back")


def feature_point_in_time(spark, d):
    e = X.table(spark, d, "events")
    labels = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("label_id"), F.col("ts").alias("label_ts"))
    features = e.filter("event_type = 'view'").select("user_id", F.col("ts").alias("feature_ts"), F.col("value").alias("feature"), "event_id")
    return lookup.point_in_time(labels, features, "user_id", "label_ts", "feature_ts", "feature", "label_id", "event_id")


def feature_freshness(spark, d):
    e = X.table(spark, d, "events").withColumn("now", _now(spark, d))
    return metrics.staleness(e, "event_type", "ts", "now")


def stream_enrichment(spark, d):
    customer = X.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"), "c_nationkey").filter("o_custkey % 11 <> 0")
    nation = X.table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))
    o = X.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return lookup.enrich(lookup.enrich(o, customer, "o_custkey", ["segment", "c_nationkey"]), nation, "c_nationkey", ["nation"]).select("o_orderkey", "segment", "nation")


def flag_rollout_md5(spark, d):
    names = F.array(*(F.lit(name) for name, _, _ in X.FLAGS))
    requests = X.table(spark, d, "events").select("user_id").distinct().withColumn("name", F.explode(names))
    return lookup.flag_for_entity(requests, X.flags(spark), "user_id").select("name", "user_id", "bucket", "is_on")


def flag_enabled_bytesum(spark, d):
    types = X.table(spark, d, "events").select(F.col("event_type").alias("name")).distinct()
    return lookup.flag_by_name(X.flags(spark).join(types, "name")).select("name", "bucket", "is_on")


def flag_cache_fallback(spark, d):
    names = X.table(spark, d, "events").select(F.col("event_type").alias("name")).distinct()
    store = X.flags(spark).filter("name <> 'view'")
    return lookup.flag_with_fallback(names, store.filter("name < 'e'"), store)


def webhook_fanout(spark, d):
    e = X.table(spark, d, "events").select("event_id", "event_type")
    return lookup.fan_out(e, X.subscriptions(spark), "event_type").select("event_id", "event_type", "subscription_id", "endpoint_url")


def webhook_orphans(spark, d):
    log = X.table(spark, d, "events").select("event_id", F.concat(F.lit("s"), (F.col("event_id") % 6).cast("string")).alias("subscription_id"))
    return lookup.missing_parents(log, X.subscriptions(spark), "subscription_id").select("event_id", "subscription_id")


def webhook_signatures(spark, d):
    rows = [(s[0], *map(bytearray, S.hmac_pads(s[4]))) for s in X.SUBSCRIPTIONS]
    pads = spark.createDataFrame(rows, "subscription_id string, inner_pad binary, outer_pad binary")
    sent = webhook_fanout(spark, d).withColumn("body", F.concat(F.lit('{"event_id":'), F.col("event_id").cast("string"), F.lit("}")))
    digest = S.hmac_sha256(F.col("inner_pad"), F.col("outer_pad"), F.col("body"))
    return sent.join(pads, "subscription_id").select("event_id", "subscription_id", S.signature_header(digest).alias("signature"))


_LATEST = f"""
WITH {X.CHANGES_SQL}, last AS (
  SELECT key, max(lsn) AS lsn, arg_max(op, lsn) AS op, arg_max(coalesce(after, 'NaN'), lsn) AS after FROM changes
  WHERE op = 'd' OR after IS NOT NULL GROUP BY key
)"""
_PROBE_SQL = """
WITH requests AS (SELECT o_orderkey, o_custkey + CASE WHEN o_orderkey % 10 = 1 THEN o_orderkey % 2 * 1000000000 ELSE 0 END AS key FROM orders),
probes AS (SELECT o_orderkey, key, c_name AS value, CASE WHEN c_custkey IS NULL THEN 'miss_absent' WHEN c_custkey % 3 <> 0 THEN 'hit' ELSE 'miss_filled' END AS outcome
  FROM requests LEFT JOIN customer ON c_custkey = key)"""

_PADS_SQL = ", ".join("('{}', '{}', '{}')".format(s[0], *(pad.hex() for pad in S.hmac_pads(s[4]))) for s in X.SUBSCRIPTIONS)

QUERIES = {
    "outbox_relay_batch": (
        outbox_relay_batch,
        f"""WITH {X.OUTBOX_SQL} SELECT id, coalesce(kafka_topic, 'orders') AS topic, coalesce(kafka_key, aggregate_id) AS key, payload AS value
        FROM outbox WHERE status = 'pending' ORDER BY id LIMIT 100""",
    ),
    "outbox_backlog_by_topic": (
        outbox_backlog_by_topic,
        f"WITH {X.OUTBOX_SQL} SELECT coalesce(kafka_topic, 'orders') AS topic, count(*) AS pending FROM outbox WHERE status = 'pending' GROUP BY 1",
    ),
    "outbox_mark_published": (
        outbox_mark_published,
        f"""WITH {X.OUTBOX_SQL} SELECT id, CASE WHEN status = 'pending' AND id % 2 = 0 THEN 'published' ELSE status END AS status,
        CASE WHEN status = 'pending' AND id % 2 = 0 THEN created_at + INTERVAL 2 HOUR ELSE published_at END AS published_at FROM outbox""",
    ),
    "outbox_reap": (
        outbox_reap,
        f"""WITH {X.OUTBOX_SQL} SELECT id, status, created_at FROM outbox
        WHERE NOT coalesce(status = 'published' AND published_at < (SELECT max(created_at) FROM outbox) - INTERVAL 7 DAY, FALSE)""",
    ),
    "inbox_dedup_first": (
        inbox_dedup_first,
        f'WITH {X.DELIVERIES_SQL} SELECT event_id, ts, "offset" FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY "offset") AS n FROM deliveries) WHERE n = 1',
    ),
    "inbox_dedup_ttl": (
        inbox_dedup_ttl,
        """WITH RECURSIVE s AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
        f AS (SELECT user_id, event_id, ts, n, TRUE AS is_new, ts AS anchor FROM s WHERE n = 1
          UNION ALL SELECT s.user_id, s.event_id, s.ts, s.n, s.ts >= f.anchor + INTERVAL 6 HOUR,
            CASE WHEN s.ts >= f.anchor + INTERVAL 6 HOUR THEN s.ts ELSE f.anchor END FROM f JOIN s ON s.user_id = f.user_id AND s.n = f.n + 1)
        SELECT user_id, event_id, ts, is_new FROM f""",
    ),
    "inbox_redelivery_ttl": (
        inbox_redelivery_ttl,
        f'WITH {X.DELIVERIES_SQL} SELECT event_id, "offset", "offset" % 10 <> 1 AS is_new FROM deliveries',
    ),
    "inbox_anti_join": (inbox_anti_join, "SELECT event_id, user_id FROM events WHERE event_id % 5 <> 0"),
    "idempotent_responses": (
        idempotent_responses,
        f"""WITH {X.DELIVERIES_SQL} SELECT 'payments:' || event_id AS request, "offset", "offset" % 10 <> 1 AS is_new,
        'r-' || CASE WHEN "offset" % 10 = 1 THEN "offset" - 1 ELSE "offset" END AS given, CASE WHEN "offset" % 10 <> 1 THEN 200 ELSE 208 END AS status FROM deliveries""",
    ),
    "idempotency_unexpired": (
        idempotency_unexpired,
        f"SELECT event_id, ts + INTERVAL 24 HOUR AS expires_at FROM events WHERE ts + INTERVAL 24 HOUR > {NOW}",
    ),
    "cdc_latest_state": (cdc_latest_state, f"{_LATEST} SELECT key, lsn, after FROM last WHERE op <> 'd'"),
    "cdc_latest_nullify": (cdc_latest_nullify, f"{_LATEST} SELECT key, lsn, CASE WHEN op <> 'd' THEN after END AS after FROM last"),
    "cdc_truncate_aware": (
        cdc_truncate_aware,
        f"""WITH {X.CHANGES_SQL}, c AS (SELECT "table", lsn, CASE WHEN lsn % 1000 = 500 THEN 't' ELSE op END AS op FROM changes),
        t AS (SELECT "table", max(lsn) AS cut FROM c WHERE op = 't' GROUP BY 1)
        SELECT "table", lsn, op FROM c LEFT JOIN t USING ("table") WHERE op <> 't' AND (cut IS NULL OR lsn > cut)""",
    ),
    "cdc_max_lsn_by_batch": (
        cdc_max_lsn_by_batch,
        "SELECT CAST(floor(event_id / 500) AS BIGINT) AS batch, count(*) AS published, greatest(max(event_id), 100) AS position FROM events GROUP BY 1",
    ),
    "cdc_table_topics": (
        cdc_table_topics,
        f"""WITH {X.CHANGES_SQL} SELECT 'cdc.public.' || "table" AS topic, op, count(*) AS n FROM changes WHERE "table" IN ('t0', 't2') GROUP BY ALL""",
    ),
    "lsn_text_roundtrip": (
        lsn_text_roundtrip,
        """SELECT event_id, l AS lsn, upper(to_hex(l >> 32)) || '/' || lpad(upper(to_hex(l & 4294967295)), 8, '0') AS text, l AS back
        FROM (SELECT event_id, event_id * 4294967311 + 12345 AS l FROM events)""",
    ),
    "dual_read_merge": (
        dual_read_merge,
        f"WITH {X.CHANGES_SQL} SELECT key, max(lsn) AS lsn, arg_max(after, lsn) AS after FROM changes WHERE op <> 'd' GROUP BY key",
    ),
    "cache_aside_outcomes": (cache_aside_outcomes, f"{_PROBE_SQL} SELECT o_orderkey, key, value, outcome FROM probes"),
    "cache_hit_ratio": (
        cache_hit_ratio,
        f"""{_PROBE_SQL} SELECT count(*) FILTER (outcome = 'hit') AS hits, count(*) FILTER (outcome <> 'hit') AS misses,
        count(*) FILTER (outcome = 'hit') / nullif(count(*), 0) AS hit_ratio FROM probes""",
    ),
    "feature_lookup_ladder": (
        feature_lookup_ladder,
        f"""WITH o AS (SELECT user_id AS key, arg_max(value, event_id) AS v, max(ts) AS at FROM events WHERE event_type = 'view' AND user_id % 4 <> 0 GROUP BY 1),
        f AS (SELECT user_id AS key, arg_max(value, event_id) AS v, max(ts) AS at FROM events WHERE event_type = 'click' AND user_id % 3 <> 0 GROUP BY 1),
        j AS (SELECT k.key, o.v AS ov, f.v AS fv, o.at AS oa, f.at AS fa, coalesce(floor(epoch({NOW} - o.at)) <= 259200, FALSE) AS fresh
          FROM (SELECT DISTINCT user_id AS key FROM events) k LEFT JOIN o USING (key) LEFT JOIN f USING (key))
        SELECT key, CASE WHEN fresh THEN ov WHEN fa IS NOT NULL THEN fv ELSE ov END AS value,
          CASE WHEN fresh THEN 'online' WHEN fa IS NOT NULL THEN 'offline' WHEN oa IS NOT NULL THEN 'stale' ELSE 'absent' END AS source,
          NOT fresh AND fa IS NOT NULL AS write_back FROM j""",
    ),
    "feature_point_in_time": (
        feature_point_in_time,
        """SELECT l.user_id, l.event_id AS label_id, l.ts AS label_ts, f.ts AS feature_ts, f.value AS feature
        FROM (SELECT * FROM events WHERE event_type = 'purchase') l
        ASOF JOIN (SELECT user_id, ts, arg_max(value, event_id) AS value FROM events WHERE event_type = 'view' GROUP BY ALL) f ON l.user_id = f.user_id AND l.ts >= f.ts""",
    ),
    "feature_freshness": (
        feature_freshness,
        f"""SELECT event_type, max(lag) AS max_lag_ms, min(lag) AS min_lag_ms, CAST(sum(lag) AS BIGINT) AS sum_lag_ms, count(*) AS n
        FROM (SELECT event_type, CAST(floor((epoch_us({NOW}) - epoch_us(ts)) / 1000) AS BIGINT) AS lag FROM events) GROUP BY 1""",
    ),
    "stream_enrichment": (
        stream_enrichment,
        """SELECT o_orderkey, coalesce(c_mktsegment, 'unknown') AS segment, coalesce(n_name, 'unknown') AS nation
        FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 11 <> 0) ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey""",
    ),
    "flag_rollout_md5": (
        flag_rollout_md5,
        f"""WITH {X.FLAGS_SQL}, b AS (SELECT name, enabled, rollout, user_id, md5(name || ':' || user_id) AS h FROM flags, (SELECT DISTINCT user_id FROM events)),
        w AS (SELECT *, CAST('0x' || h[1:8] AS BIGINT) AS a, CAST('0x' || h[9:16] AS BIGINT) AS b, CAST('0x' || h[17:24] AS BIGINT) AS c, CAST('0x' || h[25:32] AS BIGINT) AS d FROM b),
        k AS (SELECT name, enabled, rollout, user_id, (((a % 100 * 96 + b) % 100 * 96 + c) % 100 * 96 + d) % 100 AS bucket FROM w)
        SELECT name, user_id, bucket, enabled AND (rollout IS NULL OR bucket < rollout) AS is_on FROM k""",
    ),
    "flag_enabled_bytesum": (
        flag_enabled_bytesum,
        f"""WITH {X.FLAGS_SQL}, b AS (SELECT name, enabled, rollout, CAST(list_sum(list_transform(string_split(name, ''), lambda c: ascii(c))) % 100 AS BIGINT) AS bucket
          FROM flags WHERE name IN (SELECT event_type FROM events))
        SELECT name, bucket, enabled AND (rollout IS NULL OR rollout >= 100 OR bucket < rollout) AS is_on FROM b""",
    ),
    "flag_cache_fallback": (
        flag_cache_fallback,
        f"""WITH {X.FLAGS_SQL} SELECT n.name, f.enabled, CASE WHEN f.name IS NULL THEN 'not_found' WHEN n.name < 'e' THEN 'cache' ELSE 'store' END AS found_in
        FROM (SELECT DISTINCT event_type AS name FROM events) n LEFT JOIN (SELECT * FROM flags WHERE name <> 'view') f ON f.name = n.name""",
    ),
    "webhook_fanout": (
        webhook_fanout,
        f"""WITH {X.SUBSCRIPTIONS_SQL} SELECT event_id, event_type, subscription_id, endpoint_url
        FROM events JOIN subscriptions ON enabled AND list_contains(event_types, event_type)""",
    ),
    "webhook_orphans": (
        webhook_orphans,
        "SELECT event_id, 's' || (event_id % 6) AS subscription_id FROM events WHERE event_id % 6 NOT BETWEEN 1 AND 4",
    ),
    "webhook_signatures": (
        webhook_signatures,
        f"""WITH {X.SUBSCRIPTIONS_SQL}, pads(subscription_id, inner_pad, outer_pad) AS (VALUES {_PADS_SQL}),
        sent AS (SELECT event_id, subscription_id, '{{"event_id":' || event_id || '}}' AS body FROM events JOIN subscriptions ON enabled AND list_contains(event_types, event_type))
        SELECT event_id, subscription_id, 'sha256=' || sha256(unhex(outer_pad || sha256(unhex(inner_pad || hex(encode(body)))))) AS signature FROM sent JOIN pads USING (subscription_id)""",
    ),
}
