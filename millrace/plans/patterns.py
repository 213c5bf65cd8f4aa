"""Queries over the driver's tables, each with the SQL that states its result: sources, sinks, stores, handlers, administration."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from millrace.functions import scalars as S
from millrace.operators import dedup, handlers, machines, metrics, outbox
from millrace.operators.aggregate import folded
from millrace.plans.catalogue import webhook_fanout
from millrace.plans.monitoring import Counter, _events
from millrace.plans.pipeline import Pipeline, of_tenant, rendered_key, topic_name
from millrace.session import shared_dir
from millrace.sources import fixtures as X
from millrace.sources import sinks, stores, streams, webhooks
from millrace.streaming import queries as Q


def _base(spark, name):
    return f"{shared_dir(spark)}/pattern-{name}-{uuid.uuid4().hex[:12]}"


def source_counted_log(spark, d):
    streams.register(spark)
    stream = spark.readStream.format("counted_log").options(total=1000, per_batch=1000, slices=3).load()
    return Q.drain(stream, _base(spark, "log"))


def cdc_incremental_poll(spark, d):
    """Four polls of the change stream, each published before the position advances; the last one finds what is left."""
    base = _base(spark, "poll")
    poller = streams.ChangePoller(X.changes(spark, d).select("lsn", "key", "op"), "lsn", f"{base}/position", batch=300)
    for n in range(4):
        batch = poller.poll()
        if batch is None:
            break
        sinks.write_once(batch.withColumn("poll", F.lit(n).cast("long")), f"{base}/out", n)
        poller.advance()
    return sinks.written(spark, f"{base}/out").select("poll", "lsn", "key", "op")


def cdc_publish(spark, d):
    """Changes of a stream as messages, tombstones for deletes, through the batch-numbered sink."""
    base = _base(spark, "cdc")
    X.changes(spark, d).write.parquet(f"{base}/in")
    rows = streams.file_stream(spark, f"{base}/in", X.changes(spark, d).schema)
    return Q.drain(rows, base, lambda df: sinks.change_messages(df, "cdc.public", "table", "key", "op", "after", "lsn"))


def flag_scan(spark, d):
    return stores.load_flags(X.flags(spark))


def _checkpoints(spark, d):
    e = _events(spark, d)
    keys = [F.col("event_type").alias("pattern_name"), F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("pipeline_name")]
    return e.groupBy(*keys).agg(F.max("event_id").alias("position"), F.count("*").alias("version"))


def checkpoint_load(spark, d):
    row = stores.load_checkpoint(_checkpoints(spark, d), "purchase", "p1")
    return spark.createDataFrame([tuple(row)] if row else [], "pattern_name string, pipeline_name string, position long, version long")


def checkpoint_list(spark, d):
    return handlers.checkpoint_list(_checkpoints(spark, d))


def _sagas(spark, d):
    out = machines.saga_outcomes(X.saga_steps(spark, d), "saga_id", "step", F.col("failed"))
    tag = F.when(F.col("failed_at").isNull(), F.when(F.col("saga_id") % 5 == 0, "StepPending").otherwise("Completed")).otherwise(F.when(F.col("saga_id") % 2 == 0, "Compensating").otherwise("RolledBack"))
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("saga_id") % 997)
    step = F.when(tag == "Compensating", F.col("failed_at") - 1).when(tag == "StepPending", F.col("executed") - 1)
    return out.withColumns({"status": S.encode_status(tag, step), "version": F.col("executed"), "updated_at": at}).select("saga_id", "status", "version", "updated_at")


def saga_list(spark, d):
    return handlers.saga_list(_sagas(spark, d), 50)


def saga_cancel(spark, d):
    return handlers.cancel_saga(_sagas(spark, d).filter("saga_id <= 40"), 5).select("saga_id", "status", "version")


def saga_resume_points(spark, d):
    found = _sagas(spark, d).withColumn("r", machines.resume_point(S.decode_status(F.col("status"))))
    return found.filter("r.direction <> 'none'").select("saga_id", F.col("r.direction").alias("direction"), F.col("r.step").cast("long").alias("step"))


def _lost(state):
    error = RuntimeError("no stock")
    error.expected = True
    raise error


def saga_runner(spark, d):
    """A saga built step by step, run for each order: reserving fails from a price on, and what was done is undone backwards."""
    note = lambda name: lambda s: s | {"trail": s.get("trail", "") + name}
    saga = handlers.Saga("order").step("check", note("c"), note("C")).step("reserve", lambda s: _lost(s) if s["cents"] > 20_000_000 else note("r")(s), note("R")).step("pay", lambda s: _lost(s) if s["id"] % 4 == 0 else note("p")(s))
    orders = X.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    out = handlers.run_sagas(orders, saga, "id")
    return out.select("id", "status", F.get_json_object("state", "$.trail").alias("trail"))


def inbox_handler(spark, d):
    """New messages handled once each; the handler's rows and the ids are one batch."""
    seen = _events(spark, d).filter("event_id % 5 = 0").select("event_id")
    handled, _ = handlers.inbox(X.deliveries(spark, d).select("event_id", "offset", "value"), seen, "event_id", ["offset"], lambda m: m.withColumn("cents", F.round(F.col("value") * 100).cast("long")))
    return handled.select("event_id", "offset", "cents")


def _two_tier(spark, d, breaker_open):
    m, e = X.deliveries(spark, d).select("event_id", "offset"), _events(spark, d).select("event_id")
    out = handlers.inbox_two_tier(m, e.filter("event_id % 5 = 0"), e.filter("event_id % 3 = 0"), "event_id", ["offset"], breaker_open)
    return out.select("event_id", "offset", "outcome")


def inbox_two_tier(spark, d):
    return _two_tier(spark, d, False)


def inbox_breaker_open(spark, d):
    return _two_tier(spark, d, True)


def outbox_appended(spark, d):
    box = X.outbox(spark, d).select("id", "event_id", "status", "payload")
    fresh = _events(spark, d).filter("event_type = 'signup'").select((-F.col("event_id")).alias("id"), F.concat(F.lit("new-"), F.col("event_id").cast("string")).alias("event_id"))
    return outbox.appended(box, fresh).groupBy("status", F.col("payload").isNull().alias("bare")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def audit_rows(spark, d):
    kind = F.col("event_type")
    operation = F.when(kind == "error", "dlq.produce").when(kind == "purchase", "outbox.relay").when(kind == "signup", "not.audited").otherwise("inbox.consume")
    out = handlers.audit(_events(spark, d), operation, F.col("ts"), "orders", "orders-to-log", F.when(kind == "error", "failure").otherwise("success"), event_id=F.col("event_id").cast("string"), kafka_offset=F.col("event_id"))
    return out.select("operation", "timestamp", "value")


def fan_out_targets(spark, d):
    """One source, several filtered targets, each written once."""
    base = _base(spark, "fan")
    kinds = ("click", "purchase", "error")
    write = sinks.routed({k: (lambda df, k=k: df.filter(F.col("event_type") == k)) for k in kinds}, base)
    for _ in range(2):
        write(_events(spark, d).select("event_id", "event_type"), 0)
    both = [sinks.written(spark, f"{base}/{k}").withColumn("target", F.lit(k)) for k in kinds]
    out = both[0].unionByName(both[1]).unionByName(both[2])
    return out.groupBy("target", "event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


def kv_set_del(spark, d):
    """A key-value table after sets with a lifetime and deletes, as seen a while later."""
    zero = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    kv = X.table(spark, d, "customer").select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("key"), F.col("c_name").alias("value"), F.lit(None).cast("timestamp_ntz").alias("expires_at"))
    sets = X.table(spark, d, "orders").select(F.concat(F.lit("c:"), F.col("o_custkey").cast("string")).alias("key"), F.col("o_orderpriority").alias("value"), F.col("o_orderkey").alias("seq"))
    after = sinks.put(kv, sets.filter("seq % 3 = 0"), zero, 60)
    kept = sinks.delete(after, sets.filter("seq % 7 = 0").select("key"))
    return sinks.live(kept, zero + F.expr("interval 30 seconds")).select("key", "value", "expires_at")


def kv_hset(spark, d):
    kind = "key string, fields map<string,string>, expires_at timestamp_ntz"
    maps = _events(spark, d).filter("user_id % 2 = 0").groupBy(F.col("user_id").cast("string").alias("key")).agg(F.create_map(F.lit("old"), F.lit("1"), F.lit("view"), F.lit("0")).alias("fields"))
    maps = spark.createDataFrame([], kind).unionByName(maps.withColumn("expires_at", F.lit(None).cast("timestamp_ntz")))
    changes = _events(spark, d).select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("field"), F.col("event_id").cast("string").alias("value"), F.col("event_id").alias("seq"))
    out = sinks.hset(maps, changes.filter("seq % 2 = 0"))
    return out.select("key", F.explode("fields").alias("field", "value"))


def write_behind(spark, d):
    store = X.table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"))
    pending = X.table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("value"), F.col("o_orderkey").alias("seq"))
    return handlers.write_behind(pending, store, "key", "seq")


def _through(spark, d):
    store = X.table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"))
    writes = X.table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("value"), F.col("o_orderkey").alias("seq"))
    return handlers.write_through(store, store.filter("key % 10 = 0").withColumn("value", F.lit("stale")), writes.filter("seq % 2 = 0"), "key", "seq")


def write_through(spark, d):
    store, cache = _through(spark, d)
    return store.withColumn("held_in", F.lit("store")).unionByName(cache.withColumn("held_in", F.lit("cache")))


def snapshot_upsert(spark, d):
    """Snapshots of aggregates: each key's newest one stays, and older ones change nothing."""
    e = _events(spark, d).select(F.col("user_id").alias("aggregate_id"), F.col("event_id").alias("version"), F.col("event_type").alias("state"))
    kept = e.filter("version % 2 = 0").groupBy("aggregate_id").agg(F.max("version").alias("version"), F.max_by("state", "version").alias("state"))
    return dedup.newest(kept, e.filter("version % 3 = 0").groupBy("aggregate_id").agg(F.max("version").alias("version"), F.max_by("state", "version").alias("state")), ["aggregate_id"], "version")


def aggregate_from_snapshots(spark, d):
    """Aggregates rebuilt from a snapshot and the events after it."""
    e = _events(spark, d).select("user_id", "event_id", "event_type")
    early = folded(e.filter("event_id <= 500"), Counter, "user_id", ["event_id"])
    out = folded(e.filter("event_id > 500"), Counter, "user_id", ["event_id"], early)
    return out.select("user_id", F.get_json_object("state", "$.n").cast("long").alias("value"), "version")


def cache_ddl_flush(spark, d):
    kv = X.changes(spark, d).select(F.concat_ws(":", "table", F.col("key").cast("string")).alias("key"), "lsn").groupBy("key").agg(F.max("lsn").alias("value"))
    return dedup.drop_prefix(kv, "t1:")


def scoped_keys(spark, d):
    e = _events(spark, d)
    saga, attempt = F.concat(F.lit("saga-"), F.col("user_id").cast("string")), F.col("event_id") % 4
    return e.select("event_id", S.step_key(saga, F.col("event_type"), attempt).alias("step_key"), S.scoped_key("payments", F.col("event_id").cast("string")).alias("scoped"), S.lsn_order(-F.col("event_id")).cast("string").alias("unsigned"))


def pipeline_dsl(spark, d):
    """Source, dead letters, enrichment, transform and filter, as one chain."""
    bad = F.when(F.col("event_id") % 13 == 0, "poison_pill")
    nation = X.table(spark, d, "nation").select((F.col("n_nationkey")).alias("bucket"), "n_name")
    p = Pipeline(_events(spark, d).select("event_id", "user_id", "event_type", (F.col("user_id") % 30).cast(nation.schema["bucket"].dataType).alias("bucket")))
    p = p.with_dlq(bad, "orders").enrich(nation, "bucket", ["n_name"]).transform(lambda df: df.withColumn("key", rendered_key("user:{id}:{kind}", {"id": F.col("user_id"), "kind": F.col("event_type")}))).filter(F.col("event_type") != "view")
    good = p.source.select("event_id", "key", "n_name", F.lit(None).cast("string").alias("dlq_topic"))
    none = F.lit(None).cast("string")
    return good.unionByName(p.dead[0].select("event_id", none.alias("key"), none.alias("n_name"), "dlq_topic"))


def event_router(spark, d):
    kind = F.col("event_type")
    routes = Pipeline(_events(spark, d)).route(money=kind == "purchase", trouble=kind == "error", browsing=kind.isin("click", "view"))
    parts = [df.groupBy(F.lit(name).alias("route")).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids")) for name, df in routes.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def tenant_scope(spark, d):
    """A tenant's events with their topics; events without a tenant are never seen, and have no topic."""
    e = _events(spark, d).withColumn("tenant_id", F.when(F.col("user_id") % 4 > 0, F.concat(F.lit("t"), (F.col("user_id") % 4).cast("string"))))
    mine = of_tenant(e, "t2").withColumn("topic", topic_name("prod", F.col("tenant_id"), "shop", F.col("event_type")))
    none = e.filter("tenant_id is null").withColumn("topic", topic_name("prod", F.col("tenant_id"), "shop", F.col("event_type")))
    return mine.unionByName(none).groupBy("topic").agg(F.count("*").alias("n"))


def flag_distribution(spark, d):
    cache = X.flags(spark).filter("name < 'f'").withColumn("enabled", F.lit(False)).unionByName(spark.createDataFrame([("zombie", True, 5)], X.flags(spark).schema))
    return handlers.distribute_flags(X.flags(spark), cache)


def feature_refresh(spark, d):
    e = _events(spark, d)
    latest = lambda x: x.groupBy(F.col("user_id").alias("key")).agg(F.max_by("value", "event_id").alias("value"), F.max("ts").alias("computed_at"))
    online, offline = latest(e.filter("event_type = 'view'")), latest(e.filter("event_type = 'click'"))
    entities = e.select(F.col("user_id").alias("key")).distinct()
    return handlers.refresh_features(entities, online, offline, "key", X.latest(e, "ts"), 3 * 86_400)


def cold_start(spark, d):
    c = X.changes(spark, d).filter("op <> 'd'").select("key", "lsn", "after")
    latest = lambda x: x.groupBy("key").agg(F.max("lsn").alias("lsn"), F.max_by("after", "lsn").alias("after"))
    snapshot, log = latest(c.filter("lsn <= 400")), c.filter("lsn > 300")
    parts = [handlers.cold_start(how, snapshot, log, ["key"], "lsn", 700).withColumn("strategy", F.lit(how)) for how in ("pg_snapshot", "kafka_replay", "dual_read")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("strategy", "key", "lsn", "after")


def pattern_controls(spark, d):
    kind = F.col("event_type")
    command = F.when(kind == "view", "pause").when(kind == "click", "resume").when(kind == "error", "replay").when(kind == "signup", "reload").otherwise("stop")
    out = handlers.controlled(_events(spark, d).select("event_id", "user_id", command.alias("command")), "user_id", ["event_id"], "command")
    return out.select("event_id", "user_id", "command", "state", "applied")


def half_open_gate(spark, d):
    calls = _events(spark, d).select("event_id", "user_id", "ts", (F.col("ts") + F.expr("interval 2 days")).alias("ended"))
    return machines.half_open_gate(calls, "user_id", "ts", "ended", ["event_id"], 1).select("event_id", "user_id", "admitted")


def raw_sql(spark, d):
    _events(spark, d).createOrReplaceTempView("raw_sql_events")
    n = stores.execute(spark, "SELECT * FROM raw_sql_events WHERE event_type = :kind AND user_id > :low", kind="purchase", low=3)
    top = stores.fetch_optional(spark, "SELECT max(event_id) FROM raw_sql_events WHERE event_type = :kind", kind="purchase")
    none = stores.fetch_optional(spark, "SELECT event_id FROM raw_sql_events WHERE event_type = :kind", kind="nothing")
    return spark.createDataFrame([(n, top, none)], "affected long, top string, none string")


def retry_policy(spark, d):
    names = F.array(*(F.lit(x) for x in (*S.RETRY_POLICY, "kafka_consumer")))
    rows = spark.range(1, 22).select(F.col("id").alias("attempt"), F.explode(names).alias("backend"))
    plain = S.retry_delay_ms(F.col("backend"), F.col("attempt"))
    drawn = S.retry_delay_ms(F.col("backend"), F.col("attempt"), F.lit("k"))
    return rows.select("backend", "attempt", plain.alias("delay_ms"), (F.abs(drawn - plain) <= plain * 0.5).alias("near"))


def windowed_rate(spark, d):
    samples = _events(spark, d).select("event_type", "user_id", "event_id", "ts", (F.col("event_id") % 1000).alias("total"))
    out = metrics.windowed_rate(samples, ["event_type"], "user_id", "ts", "total", "1 day")
    return out.select("event_type", "window_start", "increase", F.round("rate", 9).alias("rate"))


def gauge_over_time(spark, d):
    out = metrics.over_time(_events(spark, d).select("event_type", "ts", "value", "event_id").filter("value is not null"), ["event_type"], "ts", "value", "6 hours")
    return out.select("event_type", "window_start", "min_over_time", "max_over_time", F.round("avg_over_time", 6).alias("avg_over_time"))


def times_rfc3339(spark, d):
    part = F.col("event_id") % 3
    micros = F.when(part == 0, 0).when(part == 1, 120_000).otherwise(F.col("event_id") + 1)
    ts = F.col("ts").cast("timestamp_ntz") + F.make_dt_interval(secs=(micros / 1_000_000).cast("decimal(18,6)"))
    return _events(spark, d).select("event_id", S.rfc3339(ts).alias("text"))


def _endpoint_answers(spark, d):
    """What each attempt of a delivery would meet: a refused connection, errors, then success, by the event's id."""
    sent = webhook_fanout(spark, d).select("event_id", "subscription_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("attempt"))
    good = F.col("attempt") > F.col("event_id") % 5
    return sent.withColumn("status", F.when(good, 200).when((F.col("event_id") + F.col("attempt")) % 3 == 0, F.lit(None).cast("int")).otherwise(500))


def webhook_delivery_log(spark, d):
    return machines.delivery_log(_endpoint_answers(spark, d), ["event_id", "subscription_id"], "attempt", "status", 3)


def _sends(spark, d):
    sent = webhook_fanout(spark, d).join(X.subscriptions(spark).select("subscription_id", "secret"), "subscription_id")
    return sent.select("event_id", "event_type", F.concat(F.lit('{"event_id":'), F.col("event_id").cast("string"), F.lit("}")).alias("payload"), "subscription_id", "endpoint_url", "secret", F.col("event_id").alias("offset"))


def _receiver():
    """An endpoint that answers an event's attempts with errors first, event_id % 4 times, and checks that they are signed."""
    tries = {}

    def post(url, body, headers):
        n = json.loads(body)["event_id"]
        tries[url, n] = tries.get((url, n), 0) + 1
        if not headers["X-Signature"].startswith("sha256=") or len(headers["X-Signature"]) != 71:
            return 401
        if tries[url, n] > n % 4:
            return 204
        if n % 3 == 0:
            raise ConnectionError("refused")
        return 500

    return post


def _posted(spark, d):
    sends = _sends(spark, d)
    base = _base(spark, "webhook")
    found = webhooks.deliver(sends, _receiver(), max_attempts=3, sleep=lambda _: None, clock=lambda: 0.0, failures=10**9)
    sinks.write_once(found, base, 0)
    return sends, sinks.written(spark, base)


def webhook_posts(spark, d):
    """Deliveries posted with retries, as they were logged."""
    return _posted(spark, d)[1].select(F.col("event_id").cast("long").alias("event_id"), "subscription_id", "outcome", "attempts", "status", "success", "error", "waited_s")


def webhook_dead_letters(spark, d):
    sends, found = _posted(spark, d)
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    dead = webhooks.undelivered(found, sends, "webhooks", at)
    return dead.select(F.col("event_id").cast("long").alias("event_id"), "subscription_id", "dlq_topic", "value", F.explode("headers").alias("h")).select("event_id", "subscription_id", "dlq_topic", "value", F.col("h.key").alias("header"), F.col("h.value").alias("content"))


def eos_marked_first(spark, d):
    m = X.deliveries(spark, d).select("event_id", "offset", ((F.col("offset") % 10 == 0) & (F.col("event_id") % 2 == 0)).alias("fails"))
    return machines.exactly_once_marked_first(m, "event_id", ["offset"], "fails").select("event_id", "offset", "outcome")


def leader_leases(spark, d):
    e = _events(spark, d).select("event_id", (F.col("user_id") % 3).alias("lease"), F.col("event_type").alias("holder"), "ts")
    return machines.lease_holders(e, "lease", "holder", "ts", ["event_id"], 12 * 3600).select("event_id", "lease", "leads", "holder_now")


def consumer_options(spark, d):
    """What a consumer group asks of a broker, as the options of the source; what is not set is left to the broker."""
    consumer = streams.Consumer(group_id="orders", max_poll_records=500, fetch_max_bytes=1 << 20, session_timeout_ms=45_000)
    return spark.createDataFrame(sorted(streams.kafka_options("broker:9092", "orders", consumer).items()), "option string, value string")


def primary_names(spark, d):
    n = F.col("event_id") % 4
    tail = F.when(n == 0, "/").when(n == 1, F.concat(F.lit("/p"), F.col("user_id").cast("string"))).when(n == 2, F.concat(F.lit("/q"), F.col("user_id").cast("string"), F.lit("/0"))).otherwise("")
    url = F.concat(F.lit("store://host:26379"), tail)
    return _events(spark, d).select("event_id", S.path_name(url, "mymaster").alias("name"))


_CHECKPOINTS_SQL = "SELECT event_type AS pattern_name, 'p' || (user_id % 3) AS pipeline_name, max(event_id) AS position, count(*) AS version FROM events GROUP BY ALL"
_SAGAS_SQL = f"""WITH {X.SAGA_SQL}, o AS (SELECT saga_id, min(step) FILTER (failed) AS k, count(*) AS steps FROM steps GROUP BY 1),
  s AS (SELECT saga_id, coalesce(k, steps) AS version, TIMESTAMP '2024-01-01' + to_seconds(saga_id % 997) AS updated_at, k,
    CASE WHEN k IS NULL THEN CASE WHEN saga_id % 5 = 0 THEN 'StepPending(' || (steps - 1) || ')' ELSE 'Completed' END
      WHEN saga_id % 2 = 0 THEN 'Compensating(' || (k - 1) || ')' ELSE 'RolledBack' END AS status FROM o)"""
_POSTS_SQL = f"""{X.SUBSCRIPTIONS_SQL}, sent AS (SELECT event_id, subscription_id FROM events JOIN subscriptions ON enabled AND list_contains(event_types, event_type))"""

QUERIES = {
    "source_counted_log": (source_counted_log, "SELECT i AS position, 'key-' || (i % 7) AS key, i * i % 101 AS value FROM range(1000) t(i)"),
    "cdc_incremental_poll": (
        cdc_incremental_poll,
        f"""WITH {X.CHANGES_SQL}, n AS (SELECT lsn, key, op, (row_number() OVER (ORDER BY lsn) - 1) // 300 AS poll FROM changes) SELECT poll, lsn, key, op FROM n WHERE poll < 4""",
    ),
    "cdc_publish": (
        cdc_publish,
        f"""WITH {X.CHANGES_SQL} SELECT 'cdc.public.' || "table" AS topic, CAST(key AS VARCHAR) AS key, lsn, op,
          CASE WHEN op <> 'd' THEN '{{"key":' || key || ',"op":"' || op || '","lsn":' || lsn || '}}' END AS value FROM changes""",
    ),
    "flag_scan": (flag_scan, f"WITH {X.FLAGS_SQL} SELECT name, enabled, rollout FROM flags"),
    "checkpoint_load": (checkpoint_load, f"SELECT * FROM ({_CHECKPOINTS_SQL}) WHERE pattern_name = 'purchase' AND pipeline_name = 'p1'"),
    "checkpoint_list": (checkpoint_list, _CHECKPOINTS_SQL),
    "saga_list": (saga_list, f"{_SAGAS_SQL} SELECT saga_id, status, version, updated_at FROM s ORDER BY updated_at DESC, saga_id LIMIT 50"),
    "saga_cancel": (
        saga_cancel,
        f"""{_SAGAS_SQL} SELECT saga_id, CASE WHEN saga_id = 5 AND (status LIKE 'StepP%' OR status LIKE 'Comp%(%') THEN 'Cancelled' ELSE status END AS status,
          version + CASE WHEN saga_id = 5 AND (status LIKE 'StepP%' OR status LIKE 'Comp%(%') THEN 1 ELSE 0 END AS version FROM s WHERE saga_id <= 40""",
    ),
    "saga_resume_points": (
        saga_resume_points,
        f"""{_SAGAS_SQL} SELECT saga_id, CASE WHEN status LIKE 'StepP%' THEN 'forward' ELSE 'backward' END AS direction,
          CAST(regexp_extract(status, '(-?[0-9]+)', 1) AS BIGINT) AS step FROM s WHERE status LIKE 'StepP%' OR status LIKE 'Compensating%'""",
    ),
    "saga_runner": (
        saga_runner,
        """SELECT o_orderkey AS id, CASE WHEN round(o_totalprice * 100) > 20000000 OR o_orderkey % 4 = 0 THEN 'RolledBack' ELSE 'Completed' END AS status,
          CASE WHEN round(o_totalprice * 100) > 20000000 THEN 'cC' WHEN o_orderkey % 4 = 0 THEN 'crRC' ELSE 'crp' END AS trail FROM orders""",
    ),
    "inbox_handler": (
        inbox_handler,
        'SELECT event_id, event_id * 10 AS "offset", CAST(round(value * 100) AS BIGINT) AS cents FROM events WHERE event_id % 5 <> 0',
    ),
    "inbox_two_tier": (
        inbox_two_tier,
        f"""WITH {X.DELIVERIES_SQL} SELECT event_id, "offset", CASE WHEN "offset" % 10 > 0 OR event_id % 5 = 0 THEN 'duplicate_cache' WHEN event_id % 3 = 0 THEN 'duplicate_store' ELSE 'new' END AS outcome FROM deliveries""",
    ),
    "inbox_breaker_open": (
        inbox_breaker_open,
        f"""WITH {X.DELIVERIES_SQL} SELECT event_id, "offset", CASE WHEN "offset" % 10 > 0 OR event_id % 3 = 0 THEN 'duplicate_store' ELSE 'new' END AS outcome FROM deliveries""",
    ),
    "outbox_appended": (
        outbox_appended,
        f"""WITH {X.OUTBOX_SQL} SELECT status, payload IS NULL AS bare, count(*) AS n, min(id) AS first_id
          FROM (SELECT id, status, payload FROM outbox UNION ALL SELECT -event_id, 'pending', NULL FROM events WHERE event_type = 'signup') GROUP BY ALL""",
    ),
    "audit_rows": (
        audit_rows,
        f"""WITH a AS (SELECT event_id, {X.utc_text_sql('ts')} AS t, CASE event_type WHEN 'error' THEN 'dlq.produce' WHEN 'purchase' THEN 'outbox.relay' ELSE 'inbox.consume' END AS operation,
            CASE event_type WHEN 'error' THEN 'failure' ELSE 'success' END AS outcome FROM events WHERE event_type <> 'signup')
        SELECT operation, t AS timestamp, '{{"log_type":"audit","schema_version":"1","timestamp":"' || t || '","pattern_name":"orders","pipeline_name":"orders-to-log","operation":"' || operation || '","outcome":"' || outcome
          || '","event_id":"' || event_id || '","kafka_offset":' || event_id || '}}' AS value FROM a""",
    ),
    "fan_out_targets": (
        fan_out_targets,
        "SELECT event_type AS target, event_type, count(*) AS n, max(event_id) AS last FROM events WHERE event_type IN ('click', 'purchase', 'error') GROUP BY ALL",
    ),
    "kv_set_del": (
        kv_set_del,
        """WITH s AS (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS v FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1),
          a AS (SELECT coalesce(c_custkey, o_custkey) AS k, coalesce(v, c_name) AS value, CASE WHEN v IS NOT NULL THEN TIMESTAMP '2024-01-01 00:01:00' END AS expires_at FROM customer FULL JOIN s ON o_custkey = c_custkey)
        SELECT 'c:' || k AS key, value, expires_at FROM a WHERE k NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 7 = 0)""",
    ),
    "kv_hset": (
        kv_hset,
        """WITH n AS (SELECT CAST(user_id AS VARCHAR) AS key, event_type AS field, CAST(max(event_id) AS VARCHAR) AS value FROM events WHERE event_id % 2 = 0 GROUP BY ALL),
          o AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS key, x.f AS field, x.v AS value FROM events, (SELECT unnest([{'f': 'old', 'v': '1'}, {'f': 'view', 'v': '0'}]) AS x) WHERE user_id % 2 = 0)
        SELECT key, field, coalesce(n.value, o.value) AS value FROM n FULL JOIN o USING (key, field)""",
    ),
    "write_behind": (
        write_behind,
        """WITH p AS (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS v FROM orders GROUP BY 1)
        SELECT coalesce(c_custkey, o_custkey) AS key, coalesce(v, c_name) AS value FROM customer FULL JOIN p ON o_custkey = c_custkey""",
    ),
    "write_through": (
        write_through,
        """WITH p AS (SELECT o_custkey AS key, arg_max(o_orderpriority, o_orderkey) AS v FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1)
        SELECT coalesce(c_custkey, p.key) AS key, coalesce(v, c_name) AS value, 'store' AS held_in FROM customer FULL JOIN p ON p.key = c_custkey
        UNION ALL SELECT coalesce(c_custkey, p.key), coalesce(v, 'stale'), 'cache' FROM (SELECT * FROM customer WHERE c_custkey % 10 = 0) FULL JOIN p ON p.key = c_custkey""",
    ),
    "snapshot_upsert": (
        snapshot_upsert,
        "SELECT user_id AS aggregate_id, max(event_id) AS version, arg_max(event_type, event_id) AS state FROM events WHERE event_id % 2 = 0 OR event_id % 3 = 0 GROUP BY 1",
    ),
    "aggregate_from_snapshots": (
        aggregate_from_snapshots,
        """WITH r AS (SELECT user_id, max(event_id) FILTER (event_type = 'signup') AS r, count(*) AS version, max(event_id) AS last FROM events GROUP BY 1)
        SELECT user_id, CAST(coalesce(sum(event_id % 10) FILTER (event_type <> 'signup' AND (r IS NULL OR event_id > r)), 0) AS BIGINT) AS value, version FROM events JOIN r USING (user_id) WHERE last > 500 GROUP BY ALL""",
    ),
    "cache_ddl_flush": (
        cache_ddl_flush,
        f"""WITH {X.CHANGES_SQL} SELECT "table" || ':' || key AS key, max(lsn) AS value FROM changes WHERE "table" <> 't1' GROUP BY 1""",
    ),
    "scoped_keys": (
        scoped_keys,
        """SELECT event_id, 'saga-' || user_id || '/' || event_type || '/' || (event_id % 4) AS step_key, 'payments:' || event_id AS scoped,
          CASE WHEN event_id > 0 THEN CAST(18446744073709551616::HUGEINT - event_id AS VARCHAR) ELSE '0' END AS unsigned FROM events""",
    ),
    "pipeline_dsl": (
        pipeline_dsl,
        """SELECT event_id, CASE WHEN event_id % 13 <> 0 THEN 'user:' || user_id || ':' || event_type END AS key, CASE WHEN event_id % 13 <> 0 THEN n_name END AS n_name,
          CASE WHEN event_id % 13 = 0 THEN 'events.dlq.orders' END AS dlq_topic FROM events LEFT JOIN nation ON n_nationkey = user_id % 30 WHERE event_id % 13 = 0 OR event_type <> 'view'""",
    ),
    "event_router": (
        event_router,
        """SELECT CASE event_type WHEN 'purchase' THEN 'money' WHEN 'error' THEN 'trouble' ELSE 'browsing' END AS route, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids
        FROM events WHERE event_type <> 'signup' GROUP BY 1""",
    ),
    "tenant_scope": (
        tenant_scope,
        "SELECT CASE WHEN user_id % 4 = 2 THEN 'prod.t2.shop.' || event_type END AS topic, count(*) AS n FROM events WHERE user_id % 4 IN (0, 2) GROUP BY 1",
    ),
    "flag_distribution": (flag_distribution, f"WITH {X.FLAGS_SQL} SELECT name, enabled, rollout FROM flags UNION ALL SELECT 'zombie', TRUE, 5"),
    "feature_refresh": (
        feature_refresh,
        """WITH n AS (SELECT max(ts) AS now FROM events), o AS (SELECT user_id AS key, arg_max(value, event_id) AS v, max(ts) AS at FROM events WHERE event_type = 'view' GROUP BY 1),
          f AS (SELECT user_id AS key, arg_max(value, event_id) AS v, max(ts) AS at FROM events WHERE event_type = 'click' GROUP BY 1),
          j AS (SELECT key, o.v AS ov, f.v AS fv, o.at AS oa, f.at AS fa, f.at IS NOT NULL AND NOT coalesce(floor(epoch(now - o.at)) <= 259200, FALSE) AS copied FROM o FULL JOIN f USING (key), n)
        SELECT key, CASE WHEN copied THEN fv ELSE ov END AS value, CASE WHEN copied THEN fa ELSE oa END AS computed_at FROM j""",
    ),
    "cold_start": (
        cold_start,
        f"""WITH {X.CHANGES_SQL}, c AS (SELECT key, lsn, after FROM changes WHERE op <> 'd'), s AS (SELECT unnest(['pg_snapshot', 'kafka_replay', 'dual_read']) AS strategy)
        SELECT strategy, key, max(lsn) AS lsn, arg_max(after, lsn) AS after FROM c, s
        WHERE CASE strategy WHEN 'pg_snapshot' THEN lsn <= 400 WHEN 'kafka_replay' THEN lsn > 300 AND lsn <= 700 ELSE lsn <= 700 END GROUP BY ALL""",
    ),
    "pattern_controls": (
        pattern_controls,
        """WITH RECURSIVE e AS (SELECT event_id, user_id, CASE event_type WHEN 'view' THEN 'pause' WHEN 'click' THEN 'resume' WHEN 'error' THEN 'replay' WHEN 'signup' THEN 'reload' ELSE 'stop' END AS c,
            row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
          t(f, c, g) AS (VALUES ('Running', 'pause', 'Paused'), ('Paused', 'resume', 'Running'), ('Running', 'replay', 'Replaying'), ('Paused', 'replay', 'Replaying'), ('Replaying', 'resume', 'Running'), ('Running', 'reload', 'Running'), ('Paused', 'reload', 'Paused')),
          r AS (SELECT e.*, coalesce(g, 'Running') AS s, g IS NOT NULL AS applied FROM e LEFT JOIN t ON t.f = 'Running' AND t.c = e.c WHERE n = 1
            UNION ALL SELECT e.*, coalesce(g, r.s), g IS NOT NULL FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1 LEFT JOIN t ON t.f = r.s AND t.c = e.c)
        SELECT event_id, user_id, c AS command, s AS state, applied FROM r""",
    ),
    "half_open_gate": (
        half_open_gate,
        """WITH RECURSIVE e AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
          r AS (SELECT *, ts AS began, TRUE AS ok FROM e WHERE n = 1
            UNION ALL SELECT e.*, CASE WHEN e.ts >= r.began + INTERVAL 2 DAY THEN e.ts ELSE r.began END, e.ts >= r.began + INTERVAL 2 DAY FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
        SELECT event_id, user_id, ok AS admitted FROM r""",
    ),
    "raw_sql": (
        raw_sql,
        "SELECT count(*) FILTER (user_id > 3) AS affected, CAST(max(event_id) AS VARCHAR) AS top, CAST(NULL AS VARCHAR) AS none FROM events WHERE event_type = 'purchase'",
    ),
    "retry_policy": (
        retry_policy,
        """WITH p(backend, base, most, n) AS (VALUES ('postgres_write', 100, 30000, 10), ('postgres_reconnect', 500, 60000, 20), ('kafka_producer', 100, 10000, 5),
            ('redis_read', 50, 5000, 8), ('redis_write', 50, 5000, 8), ('http_webhook', 1000, 3600000, 10), ('kafka_consumer', NULL, NULL, NULL)),
          d AS (SELECT backend, a AS attempt, CASE WHEN a < n THEN least(base * 2.0::DOUBLE ** (a - 1), most::DOUBLE) END AS delay_ms FROM p, range(1, 22) t(a))
        SELECT backend, attempt, delay_ms, CASE WHEN delay_ms IS NOT NULL THEN TRUE END AS near FROM d""",
    ),
    "windowed_rate": (
        windowed_rate,
        """WITH l AS (SELECT event_type, ts, event_id % 1000 AS v, lag(event_id % 1000) OVER (PARTITION BY event_type, user_id ORDER BY ts) AS b FROM events)
        SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS window_start, CAST(sum(CASE WHEN b IS NULL THEN 0 WHEN v >= b THEN v - b ELSE v END) AS BIGINT) AS increase,
          round(sum(CASE WHEN b IS NULL THEN 0 WHEN v >= b THEN v - b ELSE v END) / 86400, 9) AS rate FROM l GROUP BY ALL""",
    ),
    "gauge_over_time": (
        gauge_over_time,
        """SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, min(value) AS min_over_time, max(value) AS max_over_time,
          round(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(value), 6) AS avg_over_time FROM events WHERE value IS NOT NULL GROUP BY ALL""",
    ),
    "times_rfc3339": (
        times_rfc3339,
        f"""WITH t AS (SELECT event_id, ts + to_microseconds(CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 120000 ELSE event_id + 1 END) AS ts FROM events)
        SELECT event_id, {X.utc_text_sql('ts')} AS text FROM t""",
    ),
    "webhook_delivery_log": (
        webhook_delivery_log,
        f"""WITH {_POSTS_SQL}, a AS (SELECT event_id, subscription_id, CAST(t AS INTEGER) AS attempt, CASE WHEN t > event_id % 5 THEN 200 WHEN (event_id + t) % 3 <> 0 THEN 500 END AS status FROM sent, range(1, 4) r(t) WHERE t <= event_id % 5 + 1)
        SELECT event_id, subscription_id, attempt, status, coalesce(status = 200, FALSE) AS success, CASE WHEN status IS NULL THEN 'transport error' WHEN status = 500 THEN 'HTTP 500' END AS error,
          CASE WHEN coalesce(status, 0) <> 200 AND attempt < 3 THEN CAST(2 ** attempt AS BIGINT) END AS wait_s FROM a""",
    ),
    "webhook_posts": (
        webhook_posts,
        f"""WITH {_POSTS_SQL} SELECT event_id, subscription_id, CASE WHEN event_id % 4 < 3 THEN 'delivered' ELSE 'dlq' END AS outcome, CAST(least(event_id % 4 + 1, 3) AS INTEGER) AS attempts,
          CASE WHEN event_id % 4 < 3 THEN 204 END AS status, event_id % 4 < 3 AS success, CASE WHEN event_id % 4 = 3 THEN CASE WHEN event_id % 3 = 0 THEN 'refused' ELSE 'HTTP 500' END END AS error,
          CAST(2 ** (event_id % 4 + 1) - 2 AS BIGINT) AS waited_s FROM sent""",
    ),
    "webhook_dead_letters": (
        webhook_dead_letters,
        f"""WITH {_POSTS_SQL}, h AS (SELECT event_id, subscription_id, unnest([{{'k': 'original-topic', 'v': 'webhooks'}}, {{'k': 'original-offset', 'v': CAST(event_id AS VARCHAR)}},
          {{'k': 'failure-reason', 'v': CASE WHEN event_id % 3 = 0 THEN 'refused' ELSE 'HTTP 500' END}}, {{'k': 'attempt-count', 'v': '3'}}, {{'k': 'error-type', 'v': 'WebhookDeliveryFailed'}},
          {{'k': 'failed-at', 'v': '2024-01-01T00:00:00Z'}}]) AS x FROM sent WHERE event_id % 4 = 3)
        SELECT event_id, subscription_id, 'events.dlq.webhooks' AS dlq_topic, '{{"event_id":' || event_id || '}}' AS value, x.k AS header, x.v AS content FROM h""",
    ),
    "eos_marked_first": (
        eos_marked_first,
        f"""WITH {X.DELIVERIES_SQL} SELECT event_id, "offset", CASE WHEN "offset" % 10 > 0 THEN 'duplicate' WHEN event_id % 2 = 0 THEN 'aborted' ELSE 'committed' END AS outcome FROM deliveries""",
    ),
    "leader_leases": (
        leader_leases,
        """WITH RECURSIVE e AS (SELECT event_id, user_id % 3 AS lease, event_type AS h, ts, row_number() OVER (PARTITION BY user_id % 3 ORDER BY ts, event_id) AS n FROM events),
          r AS (SELECT *, h AS held, ts + INTERVAL 12 HOUR AS until FROM e WHERE n = 1
            UNION ALL SELECT e.*, CASE WHEN r.held = e.h OR e.ts >= r.until THEN e.h ELSE r.held END, CASE WHEN r.held = e.h OR e.ts >= r.until THEN e.ts + INTERVAL 12 HOUR ELSE r.until END
            FROM r JOIN e ON e.lease = r.lease AND e.n = r.n + 1)
        SELECT event_id, lease, h = held AS leads, held AS holder_now FROM r""",
    ),
    "consumer_options": (
        consumer_options,
        """SELECT * FROM (VALUES ('kafka.bootstrap.servers', 'broker:9092'), ('subscribe', 'orders'), ('kafka.isolation.level', 'read_committed'), ('startingOffsets', 'earliest'), ('kafka.group.id', 'orders'),
          ('maxOffsetsPerTrigger', '500'), ('kafka.fetch.max.bytes', '1048576'), ('kafka.session.timeout.ms', '45000')) t(option, value)""",
    ),
    "primary_names": (
        primary_names,
        "SELECT event_id, CASE event_id % 4 WHEN 1 THEN 'p' || user_id WHEN 2 THEN 'q' || user_id ELSE 'mymaster' END AS name FROM events",
    ),
}
