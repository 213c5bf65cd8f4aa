"""Progress of streaming queries as counters in Prometheus text form."""

from __future__ import annotations

import threading
from collections import defaultdict

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener


class Metrics(StreamingQueryListener):
    """Counts batches and rows per query, and keeps the observed metrics of the last batch (``df.observe``)."""

    def __init__(self):
        self.lock = threading.Lock()
        self.counts: dict[tuple[str, str], float] = defaultdict(float)
        self.gauges: dict[tuple[str, str], float] = {}

    def onQueryStarted(self, event) -> None:
        with self.lock:
            self.counts["queries_started_total", event.name or "unnamed"] += 1

    def onQueryProgress(self, event) -> None:
        p = event.progress
        name = p.name or "unnamed"
        with self.lock:
            self.counts["batches_total", name] += 1
            self.counts["input_rows_total", name] += p.numInputRows
            self.gauges["rows_per_second", name] = p.processedRowsPerSecond or 0.0
            for row in p.observedMetrics.values():
                for key, value in row.asDict().items():
                    if isinstance(value, int | float):
                        self.gauges[key, name] = value

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self.lock:
            self.counts["queries_failed_total" if event.exception else "queries_ended_total", str(event.id)] += 1

    def text(self) -> str:
        with self.lock:
            rows = [(n, "counter", q, v) for (n, q), v in self.counts.items()] + [(n, "gauge", q, v) for (n, q), v in self.gauges.items()]
        out, seen = [], set()
        for name, kind, query, value in sorted(rows):
            if name not in seen:
                seen.add(name)
                out.append(f"# TYPE {name} {kind}")
            out.append(f'{name}{{query="{query}"}} {value:g}')
        return "\n".join(out) + "\n"


def listen(spark: SparkSession) -> Metrics:
    metrics = Metrics()
    spark.streams.addListener(metrics)
    return metrics
