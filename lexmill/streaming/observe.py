"""Observation: spans of steps and micro-batches, and counts taken while rows pass, without a second pass over them.

A sink is a function of one span, a mapping. Where none is set nothing is measured, and a sink that fails never stops the
work it watches. A span holds names, times, counts and the class of an error, never content.
"""

from __future__ import annotations

import contextlib
import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

Sink = Callable[[dict], None]


def _send(sink: Sink | None, found: dict) -> None:
    if sink is not None:
        with contextlib.suppress(Exception):
            sink(found)


@contextlib.contextmanager
def span(name: str, sink: Sink | None = None, **notes: str | int | float | None) -> Iterator[dict]:
    """A step of the driver: what the block adds to the mapping it is given goes into the span, too. Errors pass."""
    found: dict = dict(notes)
    if sink is None:
        yield found
        return
    began, error = time.time(), None
    try:
        yield found
    except BaseException as e:
        error = type(e).__name__
        raise
    finally:
        _send(sink, {"span": name, "began": began, "ms": round(1000 * (time.time() - began)), "error": error, **found})


def counts(**more: Column) -> list[Column]:
    """What is counted of passing rows: all of them, and whatever else is named."""
    return [F.count(F.lit(1)).alias("rows"), *(c.alias(name) for name, c in more.items())]


def watched(df: DataFrame, name: str, **more: Column) -> tuple[DataFrame, Observation]:
    """A batch DataFrame that counts as it runs; the observation has the counts after its first action."""
    seen = Observation(name)
    return df.observe(seen, *counts(**more)), seen


def watched_stream(df: DataFrame, name: str, **more: Column) -> DataFrame:
    """The same for a stream; a Spans listener gets the counts of each micro-batch."""
    return df.observe(name, *counts(**more))


class Spans(StreamingQueryListener):
    """Writes a span for each micro-batch, with the counts observed in it, and one for the end of a query."""

    def __init__(self, sink: Sink | None = None):
        self.sink = sink

    def onQueryStarted(self, event) -> None:  # noqa: N802
        _send(self.sink, {"span": "query_started", "query": str(event.id), "name": event.name})

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        seen = {name: row.asDict() for name, row in (p.observedMetrics or {}).items()}
        state = [{"rows": s.numRowsTotal, "updated": s.numRowsUpdated, "late": s.numRowsDroppedByWatermark} for s in p.stateOperators]
        _send(self.sink, {
            "span": "batch", "query": str(p.id), "name": p.name, "batch": p.batchId, "began": p.timestamp, "ms": p.batchDuration,
            "rows_in": p.numInputRows, "observed": seen, "state": state,
        })

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        error = None if event.exception is None else (event.errorClassOnException or "error")
        _send(self.sink, {"span": "query_ended", "query": str(event.id), "error": error})


@contextlib.contextmanager
def listening(spark: SparkSession, sink: Sink | None) -> Iterator[None]:
    """Streams that run in the block are watched; without a sink no listener is added."""
    if sink is None:
        yield
        return
    listener = Spans(sink)
    spark.streams.addListener(listener)
    try:
        yield
    finally:
        spark.streams.removeListener(listener)
