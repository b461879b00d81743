"""Time budgets and retries around Spark actions."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator
from typing import TypeVar

from pyspark.sql import SparkSession

T = TypeVar("T")


class OutOfTime(TimeoutError):
    """The budget was spent in ``stage``."""

    def __init__(self, stage: str, budget: float):
        super().__init__(f"{stage} ran beyond the budget of {budget:g} s")
        self.stage, self.budget = stage, budget


class Deadline:
    """A time budget that several stages share: a stage that is out of time has its Spark
    jobs cancelled, and those after it don't start."""

    def __init__(self, spark: SparkSession, budget: float = float("inf")):
        self.spark, self.budget, self.began = spark, budget, time.monotonic()

    def left(self) -> float:
        return self.budget - (time.monotonic() - self.began)

    def run(self, stage: str, action: Callable[[], T]) -> T:
        if self.left() <= 0:
            raise OutOfTime(stage, self.budget)
        context, tag = self.spark.sparkContext, f"deadline-{uuid.uuid4().hex}"
        watch = None
        if self.left() != float("inf"):
            watch = threading.Timer(self.left(), context.cancelJobsWithTag, [tag])
            watch.daemon = True
            watch.start()
        context.addJobTag(tag)
        try:
            out = action()
        except Exception as e:
            if self.left() <= 0:
                raise OutOfTime(stage, self.budget) from e
            raise
        finally:
            context.removeJobTag(tag)
            if watch:
                watch.cancel()
        if self.left() <= 0:
            raise OutOfTime(stage, self.budget)
        return out


def waits(first: float, most: float) -> Iterator[float]:
    """Seconds before each retry: doubled each time, up to ``most``."""
    wait = min(first, most)
    while True:
        yield wait
        wait = min(2 * wait, most)


def retried(action: Callable[[], T], attempts: int, first: float = 1.0, most: float = 30.0, errors: tuple[type[Exception], ...] = (Exception,), sleep: Callable[[float], None] = time.sleep) -> T:
    """``action``, tried up to ``attempts`` times; the last error is raised."""
    for turn, wait in enumerate(waits(first, most), 1):
        try:
            return action()
        except errors:
            if turn >= attempts:
                raise
            sleep(wait)
    raise AssertionError("unreachable")
