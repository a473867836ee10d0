"""A log line for every so many requests of a stream."""

from __future__ import annotations

import logging
import time

from pyspark.sql.streaming.listener import StreamingQueryListener

LOG = logging.getLogger("vicinity.stream")


class Progress(StreamingQueryListener):
    """Logs the total, the rate since the last line, and the 99th percentile of batch times, once `every` requests more
    have come in. Register it with spark.streams.addListener()."""

    def __init__(self, every: int = 10_000, log=LOG.info, clock=time.monotonic) -> None:
        self.every, self.log, self.clock = every, log, clock
        self.total = self.since = 0
        self.began = clock()
        self.times: list[float] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.add(p.numInputRows, float(p.durationMs.get("triggerExecution", 0)))

    def add(self, rows: int, millis: float) -> None:
        self.total += rows
        self.since += rows
        if rows:
            self.times.append(millis)
        if self.since < self.every:
            return
        now, times = self.clock(), sorted(self.times)
        p99 = times[max(1, int(len(times) * 0.99)) - 1] if times else 0.0
        elapsed = now - self.began
        self.log(f"requests={self.total} per_second={self.since / elapsed if elapsed > 0 else 0:.0f} | batch p99={p99:.3f}ms")
        self.since, self.began, self.times = 0, now, []
