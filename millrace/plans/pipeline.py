"""A fluent pipeline over DataFrames and streams, and configuration with durations."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalars import duration_ms
from millrace.operators.outbox import dead_letters


@dataclass(frozen=True)
class Pipeline:
    """Source, steps and targets; each method gives a new pipeline. Works on batches and streams alike."""

    source: DataFrame
    dead: tuple[DataFrame, ...] = ()
    attempts: int = 1

    def filter(self, predicate: Column) -> Pipeline:
        return replace(self, source=self.source.filter(predicate))

    def transform(self, step: Callable[[DataFrame], DataFrame]) -> Pipeline:
        return replace(self, source=step(self.source))

    def enrich(self, reference: DataFrame, key: str, columns: list[str]) -> Pipeline:
        return replace(self, source=self.source.join(reference.select(key, *columns), key, "left"))

    def with_retry(self, attempts: int) -> Pipeline:
        """Write attempts of ``to``; Spark retries tasks by itself."""
        return replace(self, attempts=attempts)

    def with_dlq(self, reason: Column, topic: str) -> Pipeline:
        """Rows with a reason leave for the dead-letter topic of ``topic``; the others go on."""
        marked = self.source.withColumn("reason", reason)
        bad = dead_letters(marked.filter(F.col("reason").isNotNull()).withColumn("topic", F.lit(topic)), "topic")
        return replace(self, source=marked.filter(F.col("reason").isNull()).drop("reason"), dead=(*self.dead, bad))

    def route(self, **branches: Column) -> dict[str, DataFrame]:
        return {name: self.source.filter(predicate) for name, predicate in branches.items()}

    def to(self, write: Callable[[DataFrame], None]) -> None:
        """Hands the rows to a writer, again if it fails, as often as ``with_retry`` allows."""
        for left in range(self.attempts - 1, -1, -1):
            try:
                return write(self.source)
            except Exception:
                if not left:
                    raise


def topic_name(env: str, tenant: Column, domain: str, event: Column) -> Column:
    """Topic of a tenant's events; null without a tenant, so that nothing is published beyond one."""
    return F.when(F.coalesce(tenant, F.lit("")) != "", F.concat_ws(".", F.lit(env), tenant, F.lit(domain), event))


def of_tenant(table: DataFrame, tenant: str, column: str = "tenant_id") -> DataFrame:
    """A tenant's rows: the filter every read of a shared table goes through. A table without the column, or no tenant, is an error."""
    if not tenant:
        raise ValueError("a tenant is required")
    if column not in table.columns:
        raise ValueError(f"the table has no {column}")
    return table.filter(F.col(column) == tenant)


def rendered_key(template: str, columns: dict[str, Column]) -> Column:
    """A key from a template such as ``user:{id}``."""
    parts: list[Column] = []
    rest = template
    while "{" in rest:
        text, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(text), columns[name].cast("string")]
    return F.concat(*parts, F.lit(rest))


KINDS = ("outbox", "inbox", "cdc", "saga", "cache", "eos", "webhook", "feature_flag", "feature_store", "rate_limit", "idempotency", "dlq")


@dataclass
class Pattern:
    name: str
    kind: str
    options: dict = field(default_factory=dict)

    def millis(self, option: str, default: str) -> int:
        return duration_ms(str(self.options.get(option, default)))


def load(text: str) -> list[Pattern]:
    """Patterns of a JSON configuration ``{"patterns": [{"name", "type", ...}]}``; unknown types and bad durations are errors."""
    out = []
    for entry in json.loads(text).get("patterns", []):
        options = {k: v for k, v in entry.items() if k not in ("name", "type")}
        if entry.get("type") not in KINDS:
            raise ValueError(f"unknown pattern type: {entry.get('type')!r}")
        for key, value in options.items():
            if key.endswith(("_interval", "_ttl", "_window", "_timeout")):
                duration_ms(str(value))
        out.append(Pattern(entry["name"], entry["type"], options))
    if len({p.name for p in out}) < len(out):
        raise ValueError("pattern names repeat")
    return out
