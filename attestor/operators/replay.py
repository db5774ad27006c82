"""Replay of extraction runs from a table of attempts: retries, fallback, failure reasons, candidates, as windows.

``attempts``: run_id, model_rank (0 primary, 1 fallback), attempt (from 0), outcome (ok, parse, schema, ground,
rule, llm_error, crash), error_kind, record, issues. ``runs``: run_id and optional budgets; runs whose budget is
zero keep a row. A run whose attempts end before its budget does fails with llm_error, as an exhausted reply
source would.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RETRIED = ("parse", "schema", "ground", "rule")
TERMINAL = ("ok", "llm_error", "crash")
#: Kinds of model errors by the name of the exception's class; the first match wins.
ERROR_KINDS = (
    ("context_overflow", ("ContextOverflowError", "ContextWindowExceededError")),
    ("rate_limit", ("ModelRateLimitError", "RateLimitError")),
    ("timeout", ("ModelTimeoutError", "APITimeoutError", "TimeoutException", "ConnectTimeout", "ReadTimeout", "WriteTimeout", "PoolTimeout", "TimeoutError")),
    ("connection", ("ModelConnectionError", "APIConnectionError", "ConnectError", "RemoteProtocolError", "NetworkError", "ReadError", "WriteError", "CloseError", "ConnectionError", "ConnectionResetError", "ConnectionRefusedError", "ConnectionAbortedError", "BrokenPipeError")),
    ("server_error", ("ModelAPIError", "InternalServerError")),
    ("authentication", ("ModelAuthenticationError", "AuthenticationError")),
    ("permission_denied", ("ModelPermissionDeniedError", "PermissionDeniedError")),
    ("not_found", ("ModelNotFoundError", "NotFoundError")),
    ("invalid_request", ("ModelInvalidRequestError", "BadRequestError")),
)


def error_kind(class_name: Column) -> Column:
    out = F.when(class_name.isin(*ERROR_KINDS[0][1]), ERROR_KINDS[0][0])
    for kind, names in ERROR_KINDS[1:]:
        out = out.when(class_name.isin(*names), kind)
    return F.when(class_name.isNotNull(), out.otherwise("other"))


def reason(outcome: Column) -> Column:
    return F.when(outcome.isin("parse", "crash"), "parse_error").when(outcome == "llm_error", "llm_error").when(outcome.isin("schema", "ground", "rule"), "validation_exhausted")


def effort(levels: list[str], attempt: Column) -> Column:
    """Reasoning level of an attempt; the last level repeats. Null without levels."""
    return F.element_at(F.array(*[F.lit(x) for x in levels]), F.least(attempt + 1, F.lit(len(levels)))) if levels else F.lit(None).cast("string")


def live_attempts(attempts: DataFrame, primary_budget: int = 3, fallback_budget: int = 3) -> DataFrame:
    """Attempts that a run really makes: inside the budget, before any end, and fallback only after a failed primary."""
    before = Window.partitionBy("run_id", "model_rank").orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1)
    budget = F.when(F.col("model_rank") == 0, primary_budget).otherwise(fallback_budget)
    ended = F.coalesce(F.max(F.col("outcome").isin(*TERMINAL)).over(before), F.lit(False))
    live = attempts.withColumn("ended_", ended).where(~F.col("ended_") & (F.col("attempt") < budget)).drop("ended_")
    won = F.max((F.col("model_rank") == 0) & (F.col("outcome") == "ok")).over(Window.partitionBy("run_id"))
    return live.withColumn("won_", won).where((F.col("model_rank") == 0) | ~F.col("won_")).drop("won_")


def replay(attempts: DataFrame, runs: DataFrame, primary_budget: int = 3, fallback_budget: int = 3, fallback: bool = True) -> DataFrame:
    """One row for each run of ``runs``: success, retries by model, format_errors, failure_reason, llm_error_kind,
    fallback_used, last candidate, attempts made."""
    live = live_attempts(attempts if fallback else attempts.where("model_rank = 0"), primary_budget, fallback_budget)
    at, outcome = F.struct("model_rank", "attempt"), F.col("outcome")
    lost = outcome.isin(*RETRIED)
    agg = live.groupBy("run_id").agg(
        F.max(outcome == "ok").alias("success"),
        F.count_if(lost & (F.col("model_rank") == 0)).alias("primary_retries"),
        F.count_if(lost & (F.col("model_rank") == 1)).alias("fallback_retries"),
        F.count_if(outcome == "parse").alias("format_errors"),
        F.max_by(F.struct(outcome.alias("o"), "error_kind", "model_rank"), at).alias("last"),
        F.max_by(F.when(outcome.isin("ground", "rule"), F.col("record")), F.when(outcome.isin("ground", "rule"), at)).alias("candidate"),
        F.count("*").alias("attempts_made"),
    )
    out = runs.select("run_id").join(agg, "run_id", "left")
    ok = F.coalesce("success", F.lit(False))
    return out.select(
        "run_id", ok.alias("success"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("primary_retries", "fallback_retries", "format_errors", "attempts_made")],
        F.when(~ok, reason(F.col("last.o"))).alias("failure_reason"),
        F.when(~ok & (F.col("last.o") == "llm_error"), F.coalesce("last.error_kind", F.lit("other"))).alias("llm_error_kind"),
        (F.lit(fallback) & ~F.coalesce((F.col("last.model_rank") == 0) & ok, F.lit(False))).alias("fallback_used"),
        F.when(~ok, F.col("candidate")).alias("candidate"),
    )


def problem_fields(issues: Column) -> Column:
    """Distinct field paths in order of first appearance."""
    return F.array_distinct(F.transform(issues, lambda i: i["field_path"]))


def merged_stats(stats: DataFrame, *keys: str) -> DataFrame:
    """Sum of run statistics within keys."""
    sums = [F.sum(c).alias(c) for c in ("primary_retries", "fallback_retries", "format_errors")]
    return stats.groupBy(*keys).agg(F.count("*").alias("runs"), F.count_if("success").alias("successes"), *sums, F.max("fallback_used").alias("fallback_used"))


@dataclass(frozen=True)
class RetryConfig:
    """How a client meets failing calls: ``delays`` before each retry (the last repeats; none given: a second), and the
    fixed interval and longest time for which a rate limit is waited out."""

    most: int = 3
    delays: tuple[float, ...] = (1.0, 2.0, 4.0)
    rate_interval: float = 10.0
    rate_limit: float = 900.0
    transient: tuple[str, ...] = ("timeout", "connection", "server_error")


def network_retry(errors: Column, config: RetryConfig = RetryConfig()) -> Column:
    """Fold of an array of error kinds that a call met before it worked: struct(retries, waited, limited, gave_up).

    Transient errors cost a retry and wait by the list of delays; a rate limit waits a fixed interval, as long as the
    time so spent is within its limit, and costs no retry; any other error gives up at once.
    """
    delays = F.array(*[F.lit(float(d)) for d in config.delays or (1.0,)])
    state = lambda s, **x: F.struct(*[(x[n] if n in x else s[n]).alias(n) for n in ("retries", "waited", "limited", "gave_up")])
    start = F.struct(F.lit(0).alias("retries"), F.lit(0.0).alias("waited"), F.lit(0.0).alias("limited"), F.lit(False).alias("gave_up"))

    def step(s: Column, e: Column) -> Column:
        pause = F.element_at(delays, F.least(s["retries"] + 1, F.lit(len(config.delays or (1.0,)))))
        again = state(s, retries=s["retries"] + 1, waited=s["waited"] + pause)
        later = state(s, waited=s["waited"] + config.rate_interval, limited=s["limited"] + config.rate_interval)
        stop = state(s, gave_up=F.lit(True))
        limited = F.when(s["limited"] < config.rate_limit, later).otherwise(stop)
        moved = F.when(e.isin(*config.transient) & (s["retries"] < config.most), again).otherwise(stop)
        return F.when(s["gave_up"], s).when(e == "rate_limit", limited).otherwise(moved)

    return F.aggregate(errors, start, step)
