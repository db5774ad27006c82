"""What happens to completed runs: figures kept from a stream of them, listeners, and statistics captured in a scope.

Figures are mergeable aggregates, so state is one row for each key. A run is an event once, whatever became of it.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from attestor.sources.state import written

_log = logging.getLogger(__name__)


def live_field_summary(runs: DataFrame) -> DataFrame:
    """Occurrences, runs and failed runs by (schema, field) of a streaming runs table; a run arrives as one row."""
    fields = F.array_distinct(F.transform("field_issues", lambda i: i["field_path"]))
    rows = runs.select("schema_name", "success", F.explode(fields).alias("field_path"), "field_issues")
    n = F.size(F.filter("field_issues", lambda i: i["field_path"] == F.col("field_path")))
    return rows.groupBy("schema_name", "field_path").agg(F.sum(n).alias("total_occurrences"), F.count("*").alias("runs_with_problem"), F.count_if(~F.col("success")).alias("failed_runs_with_problem"))


#: Columns that may hold text of a source or a person; they reach a listener only when it asks for them.
PRIVATE = ("candidate", "source_text", "record", "last_rejection")


def gated(runs: DataFrame, capture: tuple[str, ...] = ()) -> DataFrame:
    """Runs without the private columns that aren't asked for."""
    return runs.drop(*[c for c in PRIVATE if c not in capture])


class Listeners:
    """Functions that get each batch of completed runs; ``add`` returns what takes one away again, any number of times.
    An error of one reaches neither the others nor the stream."""

    def __init__(self):
        self._each: dict[int, tuple[Callable[[DataFrame, int], None], tuple[str, ...]]] = {}

    def add(self, listener: Callable[[DataFrame, int], None], capture: tuple[str, ...] = ()) -> Callable[[], None]:
        key = max(self._each, default=0) + 1
        self._each[key] = (listener, capture)
        return lambda: self._each.pop(key, None) and None

    def __call__(self, batch: DataFrame, number: int) -> None:
        for listener, capture in list(self._each.values()):
            try:
                listener(gated(batch, capture), number)
            except Exception as e:  # a listener never breaks a run
                _log.warning("listener failed on batch %s: %s", number, e)


class StatsSink:
    """Statistics of the runs that are handed to ``record`` while it is open; scopes nest, and each gets all of its own."""

    _open: list["StatsSink"] = []

    def __init__(self):
        self.tables: list[DataFrame] = []

    def __enter__(self) -> "StatsSink":
        StatsSink._open.append(self)
        return self

    def __exit__(self, *error) -> None:
        StatsSink._open.remove(self)

    @classmethod
    def record(cls, runs: DataFrame) -> DataFrame:
        """Hand completed runs to every open scope, without private columns. Where one is open they are written to the shared
        folder first, and what was written is given back: reading figures never runs an extraction again. (Sums alone
        are had without that by ``observed.counted``.)"""
        if not cls._open:
            return runs
        runs = written(runs, "recorded-runs")
        for sink in cls._open:
            sink.tables.append(gated(runs))
        return runs

    def runs(self) -> DataFrame | None:
        """All runs recorded, or None."""
        out = None
        for t in self.tables:
            out = t if out is None else out.unionByName(t, allowMissingColumns=True)
        return out


def on_runs(runs: DataFrame, listener: Callable[[DataFrame, int], None], checkpoint: str, capture: tuple[str, ...] = ()) -> StreamingQuery:
    """Call ``listener`` with each batch of completed runs; its errors are kept from the stream."""
    listeners = listener if isinstance(listener, Listeners) else Listeners()
    if listeners is not listener:
        listeners.add(listener, capture)
    return runs.writeStream.foreachBatch(listeners).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
