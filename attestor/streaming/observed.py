"""Figures of runs as they are written, by Spark's own observations: nothing is read or run a second time.

For a batch, ``counted(runs, Observation("x"))`` and, once the result is written, ``observation.get``. For a stream,
``counted(runs, "x")`` and a ``Progress`` listener on the session.
"""

from __future__ import annotations

import logging
import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

_log = logging.getLogger(__name__)


def run_figures(runs: DataFrame) -> list[Column]:
    """Aggregates of a table of finished runs, for the columns it has."""
    out, has = [F.count(F.lit(1)).alias("runs")], set(runs.columns)
    if "success" in has:
        out += [F.count_if("success").alias("successes"), F.count_if(~F.col("success")).alias("failures")]
    if "salvaged" in has:
        out.append(F.count_if("salvaged").alias("salvaged"))
    if "field_issues" in has:
        out.append(F.coalesce(F.sum(F.size("field_issues")), F.lit(0)).alias("issues"))
    if "failure_reason" in has:
        out += [F.count_if(F.col("failure_reason") == r).alias(r) for r in ("parse_error", "validation_exhausted", "llm_error", "no_tool_call")]
    for c in ("primary_retries", "fallback_retries", "validation_retries", "format_errors", "iterations", "tool_calls"):
        if c in has:
            out.append(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c))
    return out


def call_figures(calls: DataFrame) -> list[Column]:
    """Aggregates of the calls of a tool node, by outcome."""
    return [F.count(F.lit(1)).alias("calls"), *[F.count_if(F.col("outcome") == o).alias(o) for o in ("executed", "corrected", "salvaged", "answered")], F.coalesce(F.sum(F.col("repaired").cast("long")), F.lit(0)).alias("repaired")]


def counted(rows: DataFrame, observation: Observation | str, figures: Callable[[DataFrame], list[Column]] = run_figures) -> DataFrame:
    """``rows`` unchanged, counted wherever they are read next: by an ``Observation`` in a batch, under a name in a stream."""
    return rows.observe(observation, *figures(rows))


class Progress(StreamingQueryListener):
    """Sums of observed figures over the batches of all streams of a session, by name. ``told`` gets a name, the batch's
    number and its own figures; its errors are logged and go no further."""

    def __init__(self, told: Callable[[str, int, dict], None] | None = None):
        self._told, self._sums, self._lock = told, {}, threading.Lock()

    def figures(self, name: str) -> dict:
        with self._lock:
            return dict(self._sums.get(name, {}))

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for name, row in event.progress.observedMetrics.items():
            own = {k: v or 0 for k, v in row.asDict().items()}
            with self._lock:
                held = self._sums.setdefault(name, {})
                for k, v in own.items():
                    held[k] = held.get(k, 0) + v
            if self._told is not None:
                try:
                    self._told(name, event.progress.batchId, own)
                except Exception:
                    _log.exception("a listener failed on batch %s of %s", event.progress.batchId, name)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
