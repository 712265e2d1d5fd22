"""Concurrent clients: a session, a scheduler pool and a job tag for each request.

Pools share the cluster fairly where ``spark.scheduler.mode`` is FAIR.  Job tags are
Spark's own, so cancelling one request leaves the others alone.  What waits is bounded
(``Busy`` beyond it), a request has a time limit, and results come as a list of at most
``max_rows`` rows, or as a stream of which one partition at a time is in memory.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import DataFrame, Row, SparkSession


class Busy(Exception):
    """Too many requests wait."""


class TooLarge(Exception):
    """A result has more rows than a list may have; ask for a stream."""


class Server:
    """Runs requests side by side; each sees its own views and settings."""

    def __init__(self, spark: SparkSession, threads: int = 4, waiting: int = 64, max_rows: int = 1_000_000, timeout: float | None = None):
        self.spark, self.max_rows, self.timeout = spark, max_rows, timeout
        self.pool = ThreadPoolExecutor(threads)
        self.room = threading.BoundedSemaphore(threads + waiting)
        self.tags: dict[Future, str] = {}  # of requests that haven't ended

    def submit(self, request: Callable[[SparkSession], DataFrame], client: str = "default", timeout: float | None = None) -> Future:
        """The request's rows, later; it is cancelled if it runs for longer than ``timeout`` seconds, or the server's limit."""
        return self.run(lambda s: self._listed(request(s)), client, timeout)

    def run(self, work: Callable[[SparkSession], object], client: str = "default", timeout: float | None = None, session: SparkSession | None = None) -> Future:
        """What ``work`` returns, later; in a new session or in that of a client who has one."""
        if not self.room.acquire(blocking=False):
            raise Busy("too many requests wait")
        tag = f"request-{uuid.uuid4().hex}"
        limit = min((t for t in (timeout, self.timeout) if t), default=None)

        def guarded():
            sc = self.spark.sparkContext
            sc.setLocalProperty("spark.scheduler.pool", client)
            sc.addJobTag(tag)
            clock = threading.Timer(limit, sc.cancelJobsWithTag, [tag]) if limit else None
            if clock:
                clock.daemon = True
                clock.start()
            try:
                return work(session or self.spark.newSession())
            finally:
                if clock:
                    clock.cancel()
                sc.removeJobTag(tag)
                sc.setLocalProperty("spark.scheduler.pool", None)

        try:
            f = self.pool.submit(guarded)
        except RuntimeError:
            self.room.release()
            raise
        self.tags[f] = tag
        f.add_done_callback(self._ended)
        return f

    def _ended(self, f: Future) -> None:
        self.tags.pop(f, None)
        self.room.release()

    def _listed(self, df: DataFrame) -> list[Row]:
        rows = df.limit(self.max_rows + 1).collect()
        if len(rows) > self.max_rows:
            raise TooLarge(f"more than {self.max_rows} rows")
        return rows

    def stream(self, df: DataFrame, rows: int = 1000) -> Iterator[list[Row]]:
        """Batches of rows; the driver holds one partition at a time."""
        batch: list[Row] = []
        for r in df.toLocalIterator():
            batch.append(r)
            if len(batch) == rows:
                yield batch
                batch = []
        if batch:
            yield batch

    def cancel(self, f: Future) -> None:
        """Stops the request's jobs, and no other's."""
        f.cancel()
        if tag := self.tags.get(f):
            self.spark.sparkContext.cancelJobsWithTag(tag)

    def close(self) -> None:
        self.pool.shutdown()
