"""A list that is looked at again and again until nothing on it is pending."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

PENDING = ("uploaded", "processing")


class Watch(StreamingQueryListener):
    """Notes what the batches of one query have observed, and when a batch with rows had nothing pending."""

    def __init__(self, name: str) -> None:
        self.name, self.seen = name, []
        self.done, self.told = threading.Event(), threading.Condition()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        row = p.observedMetrics.get("poll")
        if p.name != self.name or row is None or not p.numInputRows or self.done.is_set():
            return
        with self.told:
            self.seen.append((p.batchId, row.listed, row.pending))
            self.told.notify_all()
        if row.pending == 0:
            self.done.set()

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        with self.told:
            self.told.notify_all()


def poll(changes: DataFrame, *, key: str, status: str, order: tuple[str, ...], checkpoint: str, every: str = "5 seconds", sources: Iterable = (), longest: float = 1200.0) -> list[tuple[int, int, int]]:
    """[(batch, keys listed, keys pending)] of a stream of status changes, looked at at an interval, up to and with the first batch after which no key's last status, by order, is pending.

    The query is stopped by its listener's word then, or after so many seconds, by TimeoutError. sources is gone through beside it, one step for each batch that the listener has seen: what feeds the
    stream, if the caller has to. Where sources end with something pending, the query is stopped after what there is.
    """
    spark = changes.sparkSession
    latest = changes.groupBy(key).agg(F.max_by(status, F.struct(*order)).alias(status))
    counted = latest.observe("poll", F.count("*").alias("listed"), F.count_if(F.col(status).isin(*PENDING)).alias("pending"))
    watch, end = Watch(f"poll-{uuid.uuid4().hex}"), time.monotonic() + longest
    spark.streams.addListener(watch)
    query = counted.writeStream.queryName(watch.name).format("noop").outputMode("complete").option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
    try:
        fed, count = False, 0
        for _ in sources:
            fed, count = True, count + 1
            with watch.told:
                while len(watch.seen) < count and query.isActive:
                    watch.told.wait(min(1.0, max(0.0, end - time.monotonic())))
                    _in_time(end)
            if watch.done.is_set() or not query.isActive:
                break
        while not fed and not watch.done.wait(0.2) and query.isActive:
            _in_time(end)
        if query.exception() is not None:
            raise query.exception()
    finally:
        query.stop()
        spark.streams.removeListener(watch)
    return list(watch.seen)


def _in_time(end: float) -> None:
    if time.monotonic() > end:
        raise TimeoutError("something is still pending")
