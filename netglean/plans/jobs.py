"""Analyses that run beside each other and are stopped one by one."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery


class Stopped(Exception):
    """stop() ended the action."""


class Running:
    """An action (a function without arguments that starts Spark jobs) in a thread of its own, whose jobs carry a tag that no other has."""

    def __init__(self, spark: SparkSession, action: Callable[[], Any]):
        self.spark, self.tag = spark, f"netglean-{uuid.uuid4().hex}"
        self._stopped, self._out, self._error = threading.Event(), None, None

        def run() -> None:
            spark.sparkContext.addJobTag(self.tag)
            try:
                if not self._stopped.is_set():
                    self._out = action()
            except Exception as e:  # handed to result()
                self._error = e
            finally:
                spark.sparkContext.removeJobTag(self.tag)

        self._thread = InheritableThread(target=run, daemon=True)
        self._thread.start()

    def stop(self) -> None:
        """Ends the action's jobs, and those that it starts later. Other actions go on. Returns when the action has ended."""
        self._stopped.set()
        while self._thread.is_alive():
            self.spark.sparkContext.cancelJobsWithTag(self.tag)
            self._thread.join(0.2)

    def result(self, timeout: float | None = None) -> Any:
        """What the action gave; its error, or Stopped."""
        self._thread.join(timeout)
        if self._thread.is_alive():
            raise TimeoutError(self.tag)
        if self._error is not None or self._stopped.is_set():
            raise Stopped(self.tag) if self._stopped.is_set() else self._error
        return self._out


def drain(query: StreamingQuery) -> None:
    """Stops a stream after the batches of what has come."""
    if query.isActive:
        query.processAllAvailable()
    query.stop()
