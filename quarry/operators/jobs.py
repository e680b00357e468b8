"""Independent small jobs side by side, so that their planning and scheduling overlap."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import SparkSession
from pyspark.util import inheritable_thread_target

#: Jobs in flight; each is an aggregation, whose tasks share the cluster's slots as those of one job would.
AT_ONCE = 8


def together(*calls: Callable[[], Any]) -> list[Any]:
    """The results of the calls, in order.  The first error is raised once all have ended.  Calls may nest: each level
    has threads of its own, so that none waits for a thread that waits for it."""
    if len(calls) < 2:
        return [call() for call in calls]
    with ThreadPoolExecutor(min(len(calls), AT_ONCE)) as pool:
        # a wrapper per call, as each copies the caller's job properties
        keep = inheritable_thread_target(SparkSession.active())
        running = [pool.submit(keep(call)) for call in calls]
    return [r.result() for r in running]
