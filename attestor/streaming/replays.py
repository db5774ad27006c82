"""Replay of runs whose attempts arrive as a stream, in any order: a run is told once it has ended, or stopped coming.

The state of a run is its attempts within the budgets, a few rows at most. A run ends with a success, or when neither
model has budget left; where attempts stop before that, a timer ends it ``patience`` after its last one. What is told
equals ``replay.replay`` of the attempts that came.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from attestor.operators.replay import RETRIED, TERMINAL

_OUT = "success boolean, primary_retries long, fallback_retries long, format_errors long, attempts_made long, failure_reason string, llm_error_kind string, fallback_used boolean, candidate string"
_REASONS = {"parse": "parse_error", "crash": "parse_error", "llm_error": "llm_error", "schema": "validation_exhausted", "ground": "validation_exhausted", "rule": "validation_exhausted"}


def made(attempts: dict[tuple[int, int], tuple], rank: int, budget: int) -> list[tuple]:
    """Attempts of one model that were made, in order, as (attempt, outcome, error_kind, record)."""
    out = []
    for (_, n), a in sorted((k, a) for k, a in attempts.items() if k[0] == rank and k[1] < budget):
        out.append((n, *a))
        if a[0] in TERMINAL:
            break
    return out


def ended(attempts: dict[tuple[int, int], tuple], budgets: tuple[int, ...]) -> bool:
    """Whether nothing that may still come can change the run."""
    for rank, budget in enumerate(budgets):
        mine = made(attempts, rank, budget)
        last = mine[-1][1] if mine else None
        if [a[0] for a in mine] != list(range(len(mine))) or last not in TERMINAL and len(mine) < budget:
            return False
        if last == "ok":
            return True
    return True


def told(attempts: dict[tuple[int, int], tuple], budgets: tuple[int, ...]) -> tuple:
    """The run's row of ``replay.replay``, without its id."""
    live = [(0, *a) for a in made(attempts, 0, budgets[0])]
    if not any(a[2] == "ok" for a in live) and len(budgets) > 1:
        live += [(1, *a) for a in made(attempts, 1, budgets[1])]
    success, last = any(a[2] == "ok" for a in live), live[-1] if live else None
    lost = lambda rank: sum(a[0] == rank and a[2] in RETRIED for a in live)
    candidates = [a[4] for a in live if a[2] in ("ground", "rule")]
    kind = (last[3] or "other") if last and not success and last[2] == "llm_error" else None
    reason = None if success or last is None else _REASONS.get(last[2])
    return success, lost(0), lost(1), sum(a[2] == "parse" for a in live), len(live), reason, kind, len(budgets) > 1 and not (success and last[0] == 0), None if success or not candidates else candidates[-1]


class _Runs(StatefulProcessor):
    def __init__(self, budgets: tuple[int, ...], patience_ms: int):
        self.budgets, self.patience = budgets, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "model_rank int, attempt int", "outcome string, error_kind string, record string")
        self.done = handle.getValueState("done", "done boolean")

    def _attempts(self) -> dict[tuple[int, int], tuple]:
        return {tuple(k): tuple(v) for k, v in self.held.iterator()}

    def _wait(self, at: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at)

    def _finish(self, key: tuple, at: int) -> pd.DataFrame:
        row = told(self._attempts(), self.budgets)
        self.held.clear()
        self.done.update((True,))
        self._wait(at)  # the mark that keeps late attempts from opening the run again goes after a while too
        return pd.DataFrame([(key[0], *row)], columns=["run_id", *[c.split()[0] for c in _OUT.split(", ")]])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        over, latest = self.done.exists(), 0
        for df in rows:
            if over:
                continue
            for rank, n, outcome, kind, record, at in zip(df["model_rank"], df["attempt"], df["outcome"], df["error_kind"], df["record"], df["at_ms"]):
                latest = max(latest, int(at))
                if 0 <= rank < len(self.budgets) and n < self.budgets[rank] and not self.held.containsKey((int(rank), int(n))):
                    self.held.updateValue((int(rank), int(n)), (outcome, kind, record))
        if over:
            return
        since = max(latest, timerValues.getCurrentWatermarkInMs()) + self.patience
        if ended(self._attempts(), self.budgets):
            yield self._finish(key, since)
        else:
            self._wait(since)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.done.exists():
            self.done.clear()
            return
        yield self._finish(key, timerValues.getCurrentWatermarkInMs() + self.patience)

    def close(self) -> None:
        pass


def replay_stream(attempts: DataFrame, at: str, primary_budget: int = 3, fallback_budget: int = 3, fallback: bool = True, patience: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """A row for each run of a stream of ``attempts`` (as for ``replay.replay``, with the time ``at``), in append mode.

    An attempt that comes again changes nothing, nor does one for which no budget is left, or one of a run that was told
    less than ``patience`` ago. Attempts up to ``late`` behind the newest are waited for. Times are the attempts' own.
    The session has to keep its streams' state in RocksDB (``spark.sql.streaming.stateStore.providerClass``).
    """
    spark = attempts.sparkSession
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        raise ValueError("set spark.sql.streaming.stateStore.providerClass to the RocksDB provider")
    budgets = (primary_budget, fallback_budget) if fallback else (primary_budget,)
    wait = spark.sql(f"SELECT CAST((TIMESTAMP_SECONDS(0) + INTERVAL {patience}) AS LONG) AS s").first()["s"] * 1000
    kind = attempts.schema["run_id"].dataType.simpleString()
    rows = attempts.withWatermark(at, late).select("run_id", F.col("model_rank").cast("int"), F.col("attempt").cast("int"), "outcome", F.col("error_kind").cast("string"), F.col("record").cast("string"), F.unix_millis(at).alias("at_ms"), at)
    return rows.groupBy("run_id").transformWithStateInPandas(_Runs(budgets, wait), f"run_id {kind}, {_OUT}", "Append", "EventTime")
