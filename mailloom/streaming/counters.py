"""Counters of streaming runs, from the metrics that each micro-batch observes."""

from __future__ import annotations

import threading
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


class StreamCounters(StreamingQueryListener):
    """Sums of what the micro-batches of a run have observed (``DataFrame.observe``).

    Only batches that were committed report, so one that failed and was repeated
    counts once. Counts may be read while a stream goes on.
    """

    def __init__(self) -> None:
        self._totals: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
        self._ended: dict[str, threading.Event] = defaultdict(threading.Event)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        totals = self._totals[str(event.progress.runId)]
        for row in event.progress.observedMetrics.values():
            for name, value in row.asDict().items():
                totals[name] += value or 0

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._ended[str(event.runId)].set()

    def so_far(self, query: StreamingQuery) -> dict[str, int]:
        return dict(self._totals[str(query.runId)])

    def of(self, query: StreamingQuery, patience: float = 60.0) -> dict[str, int]:
        """The counts of a whole run; waits for its end."""
        query.awaitTermination()
        if not self._ended[str(query.runId)].wait(patience):
            raise TimeoutError("the end of the stream was not reported")
        return self.so_far(query)


@contextmanager
def stream_counters(spark: SparkSession) -> Iterator[StreamCounters]:
    """Counters of the streams that start within the block."""
    counters = StreamCounters()
    spark.streams.addListener(counters)
    try:
        yield counters
    finally:
        spark.streams.removeListener(counters)
