"""Sources: bounded replays of files as streams, Kafka options, incremental reads, and a Python source of a counted log."""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from millrace.sources.sinks import exists, published_snapshot


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream; the limit of files per batch is its backpressure."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


@dataclass(frozen=True)
class Consumer:
    """What a consumer group asks of a broker. Offsets are committed in the query's checkpoint, never to the broker."""

    isolation_level: str = "read_committed"
    offset_reset: str = "earliest"
    group_id: str | None = None
    max_poll_records: int | None = None
    fetch_max_bytes: int | None = None
    max_poll_interval_ms: int | None = None
    session_timeout_ms: int | None = None
    heartbeat_interval_ms: int | None = None


def kafka_options(servers: str, topic: str, consumer: Consumer = Consumer()) -> dict[str, str]:
    """Options of Spark's Kafka source; records per poll bound a batch."""
    plain = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "kafka.isolation.level": consumer.isolation_level,
        "startingOffsets": consumer.offset_reset,
        "kafka.group.id": consumer.group_id,
        "maxOffsetsPerTrigger": consumer.max_poll_records,
        "kafka.fetch.max.bytes": consumer.fetch_max_bytes,
        "kafka.max.poll.interval.ms": consumer.max_poll_interval_ms,
        "kafka.session.timeout.ms": consumer.session_timeout_ms,
        "kafka.heartbeat.interval.ms": consumer.heartbeat_interval_ms,
    }
    return {k: str(v) for k, v in plain.items() if v is not None}


def after_position(table: DataFrame, position: str, last: int, upto: int | None = None) -> DataFrame:
    """Rows beyond the last position, and up to a high mark taken at the start; both bounds reach the scan."""
    out = table.filter(F.col(position) > last)
    return out if upto is None else out.filter(F.col(position) <= upto)


class ChangePoller:
    """Incremental reads of a growing table: each poll gives the next rows by position, and advancing makes that lasting.

    The position is a numbered table below ``base``, so a restarted poller goes on where the last advance left it, and a batch that was
    not published in full comes again.
    """

    def __init__(self, table: DataFrame, position: str, base: str, batch: int):
        self.table, self.position, self.base, self.batch = table, position, base, batch
        self.high: int | None = None

    def last(self) -> tuple[int, int]:
        """Version and position of the last advance."""
        spark = self.table.sparkSession
        if not exists(spark, self.base):
            return 0, -(1 << 63)
        row = spark.read.option("recursiveFileLookup", "true").schema("version long, position long").parquet(self.base).agg(F.max(F.struct("version", "position"))).first()[0]
        return row["version"], row["position"]

    def poll(self) -> DataFrame | None:
        """At most ``batch`` positions beyond the last, none if there are none; both bounds reach the scan."""
        last = self.last()[1]
        highest = after_position(self.table, self.position, last).select(self.position).distinct().orderBy(self.position).limit(self.batch)
        self.high = highest.agg(F.max(self.position)).first()[0]
        return None if self.high is None else after_position(self.table, self.position, last, self.high)

    def advance(self) -> None:
        """Makes the last poll's position lasting; called after its rows are published."""
        if self.high is None:
            return
        version = self.last()[0] + 1
        spark = self.table.sparkSession
        published_snapshot(spark.range(1).select(F.lit(version).cast("long").alias("version"), F.lit(self.high).cast("long").alias("position")), self.base, version)
        self.high = None


class _Range(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class _LogReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.total = int(options.get("total", 1000))
        self.per_batch = int(options.get("per_batch", 250))
        self.slices = int(options.get("slices", 4))
        self.at = 0

    def initialOffset(self) -> dict:
        return {"position": 0}

    def latestOffset(self) -> dict:
        self.at = min(self.total, self.at + self.per_batch)
        return {"position": self.at}

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        lo, hi = start["position"], end["position"]
        step = max(1, -(-(hi - lo) // self.slices))
        return [_Range(k, min(hi, k + step)) for k in range(lo, hi, step)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        for n in range(partition.start, partition.end):
            yield n, f"key-{n % 7}", n * n % 101

    def commit(self, end: dict) -> None:
        self.at = max(self.at, end["position"])


class CountedLog(DataSource):
    """A deterministic log (position, key, value) with seekable positions: the pattern for own sources."""

    @classmethod
    def name(cls) -> str:
        return "counted_log"

    def schema(self) -> str:
        return "position bigint, key string, value bigint"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _LogReader(dict(self.options))


class _Page(InputPartition):
    def __init__(self, after: int, upto: int):
        self.after, self.upto = after, upto


class _HttpReader(DataSourceStreamReader):
    """Offsets are positions of the endpoint's records; a batch is cut into pages, which tasks fetch."""

    def __init__(self, options: dict[str, str]):
        self.url = options["url"]
        self.page, self.start = int(options.get("page", 100)), int(options.get("start", 0))

    def _get(self, **query: int) -> list[dict]:
        with urllib.request.urlopen(f"{self.url}?{urllib.parse.urlencode(query)}", timeout=30) as answer:
            return json.loads(answer.read())

    def initialOffset(self) -> dict:
        return {"position": self.start}

    def latestOffset(self) -> dict:
        last = self._get(last=1)
        return {"position": int(last[0]["position"]) if last else self.start}

    def partitions(self, start: dict, end: dict) -> list[_Page]:
        lo, hi = start["position"], end["position"]
        return [_Page(k, min(hi, k + self.page)) for k in range(lo, hi, self.page)]

    def read(self, partition: _Page) -> Iterator[tuple]:
        for row in self._get(after=partition.after, upto=partition.upto):
            yield int(row["position"]), json.dumps(row["body"], sort_keys=True)

    def commit(self, end: dict) -> None:
        pass


class HttpEndpoint(DataSource):
    """Records ``(position, body)`` of an HTTP endpoint. ``url?after=a&upto=b`` answers with those beyond a up to b, as a JSON array of
    objects with position and body; ``url?last=1`` with the last one. Positions are counted up by the endpoint, and may have gaps."""

    @classmethod
    def name(cls) -> str:
        return "http_endpoint"

    def schema(self) -> str:
        return "position bigint, body string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _HttpReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CountedLog)
    spark.dataSource.register(HttpEndpoint)
