"""Scalar functions as Catalyst expressions: hashing, signing, positions, backoff, codecs."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW_WORD = 0xFFFFFFFF


def md5_bucket(text: Column, buckets: int = 100) -> Column:
    """The 128-bit md5 of a text modulo ``buckets``, folded word by word as no integer type holds it."""
    factor = (1 << 32) % buckets
    out = F.lit(0).cast("long")
    for k in range(4):
        word = F.conv(F.substring(F.md5(text), 8 * k + 1, 8), 16, 10).cast("long")
        out = (out * factor + word % buckets) % buckets
    return out


def byte_sum_bucket(text: Column, buckets: int = 100) -> Column:
    """Sum of a text's UTF-8 bytes, wrapping at 32 bits, modulo ``buckets``."""
    digits = F.hex(F.encode(text, "UTF-8"))
    pairs = F.when(F.length(digits) > 0, F.sequence(F.lit(1), F.length(digits) - 1, F.lit(2)))
    values = F.transform(pairs, lambda i: F.conv(F.substr(digits, i, F.lit(2)), 16, 10).cast("long"))
    return F.coalesce(F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)) % (1 << 32) % buckets


def hmac_pads(secret: str) -> tuple[bytes, bytes]:
    """Inner and outer pad of a secret for HMAC-SHA256."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_sha256(inner: Column, outer: Column, message: Column) -> Column:
    """HMAC-SHA256 in hex from precomputed pads (binary columns) and a message."""
    digest = F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))
    return F.sha2(F.concat(outer, digest), 256)


def signature_header(digest: Column) -> Column:
    return F.concat(F.lit("sha256="), digest)


def lsn_to_text(lsn: Column) -> Column:
    """A log position as HIGH/LOW in upper-case hex, the low word padded to eight digits."""
    return F.concat(
        F.hex(F.shiftrightunsigned(lsn, 32)), F.lit("/"), F.lpad(F.hex(lsn.bitwiseAND(F.lit(LOW_WORD))), 8, "0")
    )


def text_to_lsn(text: Column) -> Column:
    """The inverse, for padded and unpadded texts; null if the text is no position."""
    word = lambda k: F.conv(F.split_part(text, F.lit("/"), F.lit(k)), 16, 10).cast("decimal(20,0)")
    high = F.when(word(1) >= (1 << 31), word(1) - F.lit(1 << 32).cast("decimal(20,0)")).otherwise(word(1))
    whole = (high * F.lit(1 << 32).cast("decimal(20,0)") + word(2)).cast("long")
    return F.when(text.rlike("^[0-9A-Fa-f]{1,8}/[0-9A-Fa-f]{1,8}$"), whole)


def lsn_order(lsn: Column) -> Column:
    """A key that orders 64-bit positions as unsigned."""
    d = lsn.cast("decimal(20,0)")
    return F.when(lsn < 0, d + F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(d)


def path_name(url: Column, default: str) -> Column:
    """The first path segment of a URL, which names a primary among its replicas; the default without one."""
    segments = F.filter(F.split(url, "/"), lambda x: (x != "") & ~x.endswith(":"))
    return F.coalesce(F.get(segments, 1), F.lit(default))


def step_key(saga_id: Column, step: Column, attempt: Column) -> Column:
    return F.concat_ws("/", saga_id, step, attempt)


def scoped_key(scope: Column | str, key: Column) -> Column:
    return F.concat_ws(":", F.lit(scope) if isinstance(scope, str) else scope, key)


def doubling_backoff(attempt: Column, cap: int = 6) -> Column:
    """Seconds to wait after an attempt: two to the attempt, which counts up to ``cap``."""
    return F.expr("1L") * F.pow(F.lit(2), F.least(attempt, F.lit(cap))).cast("long")


def spread(key: Column, percent: int | Column) -> Column:
    """A factor within ``percent`` of one, by a hash of the key, so that reruns agree: jitter for delays."""
    unit = F.pmod(F.xxhash64(key, F.lit("jitter")), F.lit(20_001)) / 10_000 - 1
    return 1 + unit * percent / 100


#: Retry policy by back end: base and longest delay in milliseconds, attempts, jitter in percent. Fixed values.
RETRY_POLICY = {
    "postgres_write": (100, 30_000, 10, 20),
    "postgres_reconnect": (500, 60_000, 20, 30),
    "kafka_producer": (100, 10_000, 5, 25),
    "redis_read": (50, 5_000, 8, 20),
    "redis_write": (50, 5_000, 8, 20),
    "http_webhook": (1_000, 3_600_000, 10, 50),
}


def retry_delay_ms(backend: Column, attempt: Column, key: Column | None = None) -> Column:
    """Milliseconds before the retry that follows an attempt, counted from 1: doubling up to the longest delay, with the back end's
    jitter if there is a key to draw it by. Null from the last attempt on, and for back ends without retries."""
    table = F.create_map(*(x for k, (base, most, n, jitter) in RETRY_POLICY.items() for x in (F.lit(k), F.struct(F.lit(base).alias("base"), F.lit(most).alias("most"), F.lit(n).alias("n"), F.lit(jitter).alias("jitter")))))
    policy = F.try_element_at(table, backend)
    delay = F.least(policy["base"] * F.pow(F.lit(2.0), attempt - 1), policy["most"].cast("double"))
    factor = F.lit(1.0) if key is None else spread(F.concat_ws("/", key, attempt.cast("string")), policy["jitter"])
    return F.when(attempt < policy["n"], delay * factor)


def capped_backoff(attempt: Column, base_ms: int, multiplier: float, max_ms: int) -> Column:
    return F.least(F.lit(float(base_ms)) * F.pow(F.lit(multiplier), attempt - 1), F.lit(float(max_ms)))


def rfc3339(ts: Column) -> Column:
    """A time in UTC as text, whatever the session's zone, with 0, 3 or 6 digits of its fraction. Times without zone are UTC."""
    seconds = (F.unix_micros(ts.cast("timestamp")).cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)")
    zoned = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)
    clock = F.when(F.typeof(ts) == "timestamp", zoned).otherwise(ts.cast("timestamp_ntz")).cast("string")
    fraction = F.when(F.contains(clock, F.lit(".")), F.rpad(F.substring_index(clock, ".", -1), 6, "0"))
    short = F.regexp_replace(fraction, "^([0-9]{3})000$", "$1")
    whole = F.replace(F.substring_index(clock, ".", 1), F.lit(" "), F.lit("T"))
    return F.concat(whole, F.coalesce(F.concat(F.lit("."), short), F.lit("")), F.lit("Z"))


def freshness_seconds(computed_at: Column, now: Column) -> Column:
    """Whole seconds between two times."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return F.floor((micros(now) - micros(computed_at)) / 1_000_000).cast("long")


def dlq_headers(topic: Column, offset: Column, reason: Column, attempts: Column, error: Column, at: Column, trace: Column) -> Column:
    """Headers of a dead letter as an array of (key, value); the trace header only if there is one."""
    pairs = {
        "original-topic": topic,
        "original-offset": offset,
        "failure-reason": reason,
        "attempt-count": attempts,
        "error-type": error,
        "failed-at": rfc3339(at),
        "traceparent": trace,
    }
    made = F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in pairs.items()))
    return F.filter(made, lambda h: (h["key"] != "traceparent") | h["value"].isNotNull())


def encode_status(tag: Column, step: Column) -> Column:
    """A saga's status as text: the tag, with the step in brackets if there is one."""
    return F.when(step.isNull(), tag).otherwise(F.concat(tag, F.lit("("), step.cast("string"), F.lit(")")))


def decode_status(text: Column) -> Column:
    step = F.regexp_extract(text, r"\((-?\d+)\)$", 1)
    return F.struct(
        F.regexp_extract(text, r"^[A-Za-z]+", 0).alias("tag"), F.when(step != "", step.cast("int")).alias("step")
    )


def error_class(code: Column) -> Column:
    """Transient errors are retried, permanent ones are not, ambiguous ones need an idempotent retry."""
    return (
        F.when(code.isNull(), "ambiguous")
        .when((code == 429) | (code >= 500), "transient")
        .when(code >= 400, "permanent")
        .otherwise("none")
    )


_UNITS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}


def duration_ms(text: str) -> int:
    """Milliseconds of a duration such as 500ms, 60s, 5m, 24h, 7d, or of several in a row."""
    parts = re.findall(r"(\d+)(ms|[smhd])", text)
    if not parts or "".join(n + u for n, u in parts) != text.strip():
        raise ValueError(f"no duration: {text!r}")
    return sum(int(n) * _UNITS[u] for n, u in parts)
