"""State machines over logs: sagas, circuit breakers, deliveries, exactly-once outcomes, backpressure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.scalars import doubling_backoff

from .folds import sorted_fold


def saga_outcomes(steps: DataFrame, saga: str, index: str, failed: Column) -> DataFrame:
    """Final status per saga from its step log: the first failing step decides, in closed form.

    Completed without a failure; else the steps before it are compensated and the saga is RolledBack.
    """
    at = F.when(failed, F.col(index))
    return steps.groupBy(saga).agg(F.min(at).alias("failed_at"), F.count("*").alias("steps")).select(
        saga,
        F.when(F.col("failed_at").isNull(), "Completed").otherwise("RolledBack").alias("status"),
        "failed_at",
        F.coalesce("failed_at", "steps").cast("long").alias("executed"),
        F.col("failed_at").isNotNull().alias("compensation_mode"),
    )


def saga_compensations(outcomes: DataFrame, saga: str) -> DataFrame:
    """Compensations in their order: strictly backwards from the step before the failing one, which is not compensated."""
    failed = outcomes.filter("failed_at > 0")
    steps = F.posexplode(F.sequence(F.col("failed_at") - 1, F.lit(0), F.lit(-1))).alias("nth", "step")
    return failed.select(saga, steps)


def resume_point(status: Column) -> Column:
    """Where a restarted saga goes on: its pending step forward, its compensation backward, or nowhere."""
    tag, step = status["tag"], status["step"]
    return F.struct(
        F.when(tag == "StepPending", "forward").when(tag == "Compensating", "backward").when(tag == "Started", "forward").otherwise("none").alias("direction"),
        F.when(tag.isin("StepPending", "Compensating"), step).when(tag == "Started", 0).alias("step"),
    )


def circuit_breaker(calls: DataFrame, key: str, ts: str, order: list[str], ok: str, failures: int = 5, successes: int = 2, timeout_seconds: int = 60) -> DataFrame:
    """``admitted`` and ``state`` after each call outcome.

    Closed opens after consecutive failures. Open rejects until the timeout has passed since it opened, then probes:
    half-open closes after enough successes, and one failure opens it again.
    """
    timeout = timeout_seconds * 1_000_000

    def step(held, row):
        state, n, since = held
        us, good = row
        if state == "Open":
            if us < since + timeout:
                return held, (False, state)
            state, n = "HalfOpen", 0
        if state == "HalfOpen":
            if not good:
                state, n, since = "Open", 0, us
            else:
                n += 1
                if n >= successes:
                    state, n = "Closed", 0
        elif good:
            n = 0
        else:
            n += 1
            if n >= failures:
                state, n, since = "Open", 0, us
        return (state, n, since), (True, state)

    timed = calls.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    return sorted_fold(timed, [key], [ts, *order], ["_us", ok], lambda: ("Closed", 0, 0), step, "admitted boolean, state string").drop("_us")


def endpoint_breaker(attempts: DataFrame, key: str, ts: str, order: list[str], transport_ok: str, failures: int = 5, block_seconds: int = 60) -> DataFrame:
    """``outcome`` per attempt: after enough transport failures in a row an endpoint is blocked for a time.

    Any answer counts as transport success, whatever its status. Blocked attempts are skipped.
    """
    block = block_seconds * 1_000_000

    def step(held, row):
        n, until = held
        us, good = row
        if us < until:
            return held, ("skipped_cb_open",)
        if good:
            return (0, 0), ("sent",)
        n += 1
        return ((0, us + block) if n >= failures else (n, 0)), ("transport_error",)

    timed = attempts.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    return sorted_fold(timed, [key], [ts, *order], ["_us", transport_ok], lambda: (0, 0), step, "outcome string").drop("_us")


def transitions(samples: DataFrame, key: str, ts: str, active: Column) -> DataFrame:
    """Samples at which a condition changes; before the first one it is off."""
    w = Window.partitionBy(key).orderBy(ts)
    marked = samples.withColumn("active", active)
    before = F.lag("active", 1, False).over(w)
    return marked.withColumn("_before", before).filter("active <> _before").drop("_before")


def delivery_log(tries: DataFrame, keys: list[str], attempt: str, status: str, max_attempts: int) -> DataFrame:
    """The attempts that a delivery with retries makes: up to its first 2xx answer or the limit, with the wait after each.

    ``tries`` holds what each attempt would meet, null where the transport fails. ``error`` is what a failed attempt
    leaves, ``wait_s`` null where no attempt follows.
    """
    good = F.col(status).between(200, 299)
    w = Window.partitionBy(*keys)
    done = F.coalesce(F.min(F.when(good, F.col(attempt))).over(w), F.lit(max_attempts))
    error = F.when(F.col(status).isNull(), "transport error").when(~good, F.concat(F.lit("HTTP "), F.col(status).cast("string")))
    made = tries.filter(F.col(attempt) <= max_attempts).withColumn("_done", done).filter(F.col(attempt) <= F.col("_done"))
    wait = F.when((F.col(attempt) < F.col("_done")), doubling_backoff(F.col(attempt)))
    return made.select(*keys, attempt, status, F.coalesce(good, F.lit(False)).alias("success"), error.alias("error"), wait.alias("wait_s"))


def delivery_outcomes(attempts: DataFrame, keys: list[str], attempt: str, status: str, max_attempts: int) -> DataFrame:
    """Per delivery, from its logged attempts: delivered at the first 2xx within the limit, dlq once they are used up."""
    tried = attempts.filter(F.col(attempt) <= max_attempts)
    good = F.when(F.col(status).between(200, 299), F.col(attempt))
    return tried.groupBy(*keys).agg(F.min(good).alias("delivered_at"), F.max(attempt).alias("last")).select(
        *keys,
        F.when(F.col("delivered_at").isNotNull(), "delivered").when(F.col("last") >= max_attempts, "dlq").otherwise("retrying").alias("outcome"),
        F.coalesce("delivered_at", "last").cast("long").alias("attempts"),
    )


def retry_tracker(log: DataFrame, key: str, order: list[str], ok: Column, max_attempts: int = 3) -> DataFrame:
    """``attempts`` since the last success and ``action``: done, retry, or dlq from the limit on; a success clears.

    Successes start new stretches, so the count is a row number in each: no fold.
    """
    w = Window.partitionBy(key).orderBy(*order)
    stretch = F.sum(F.when(ok, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = log.withColumn("_ok", ok).withColumn("_stretch", stretch)
    in_stretch = F.sum(F.when(F.col("_ok"), 0).otherwise(1)).over(
        Window.partitionBy(key, "_stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    counted = marked.withColumn("attempts", in_stretch)
    action = F.when(F.col("_ok"), "done").when(F.col("attempts") >= max_attempts, "dlq").otherwise("retry")
    return counted.withColumn("action", action).drop("_ok", "_stretch")


def exactly_once(messages: DataFrame, key: str, order: list[str], fails: str) -> DataFrame:
    """``outcome`` per message: committed, duplicate, or aborted; only a commit claims the id, so an aborted one may come again.

    The first message that does not fail commits, so whether one came before is a running maximum: a window, no fold.
    """
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    done = F.coalesce(F.max(~F.col(fails)).over(before), F.lit(False))
    return messages.withColumn("outcome", F.when(done, "duplicate").when(F.col(fails), "aborted").otherwise("committed"))


def exactly_once_marked_first(messages: DataFrame, key: str, order: list[str], fails: str) -> DataFrame:
    """As ``exactly_once``, but the id is marked before the transaction begins: after an abort it counts as a duplicate."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order)) == 1
    return messages.withColumn("outcome", F.when(~first, "duplicate").when(F.col(fails), "aborted").otherwise("committed"))


def since_reset(events: DataFrame, key: str, order: list[str], is_reset: Column, amount: Column) -> DataFrame:
    """A counter aggregate folded in closed form: what was added since its last reset, and the events seen.

    One read and one shuffle: the last reset is a window's maximum, and the sums that follow stay in its partitions.
    """
    last = F.max(F.when(is_reset, F.struct(*order))).over(Window.partitionBy(key))
    added = F.when(~is_reset & (F.col("_reset").isNull() | (F.struct(*order) > F.col("_reset"))), amount)
    marked = events.withColumn("_reset", last)
    return marked.groupBy(key).agg(F.coalesce(F.sum(added), F.lit(0)).cast("long").alias("value"), F.count("*").alias("version"))


def half_open_gate(calls: DataFrame, key: str, began: str, ended: str, order: list[str], most: int) -> DataFrame:
    """``admitted`` per probe of a half-open breaker: at most ``most`` admitted ones run at a time, the others are turned away.

    A call runs from ``began`` to ``ended``, its end not included.
    """

    def step(running, row):
        start, end = row
        running = [x for x in running if x > start]
        ok = len(running) < most
        return (running + [end] if ok else running), (ok,)

    timed = calls.withColumns({"_b": F.unix_micros(F.col(began).cast("timestamp")), "_e": F.unix_micros(F.col(ended).cast("timestamp"))})
    return sorted_fold(timed, [key], [began, *order], ["_b", "_e"], list, step, "admitted boolean").drop("_b", "_e")


def lease_holders(attempts: DataFrame, lease: str, holder: str, ts: str, order: list[str], seconds: int = 15) -> DataFrame:
    """``leads`` and ``holder_now`` after each attempt to acquire or renew a lease: one holder at a time, until it stops renewing."""
    term = seconds * 1_000_000

    def step(held, row):
        name, until = held
        who, now = row
        if name is None or name == who or now >= until:
            name, until = who, now + term
        return (name, until), (name == who, name)

    timed = attempts.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    return sorted_fold(timed, [lease], [ts, *order], [holder, "_us"], lambda: (None, 0), step, "leads boolean, holder_now string").drop("_us")
