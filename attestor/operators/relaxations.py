"""What a provider refuses and is relaxed once: a strict schema, flags of a tool binding; and reasoning levels by attempt.

A relaxation changes how the next call is made and costs no attempt; each happens once a run. A refused reasoning level
is no matter of binding and ends the run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.operators import replay

#: Flags of a tool binding, and how a refused request reads.
TOOL_FLAGS = ("strict", "tool_choice", "parallel_tool_calls")
BAD_REQUEST = ("400", "bad request", "invalid_request", "invalid request", "unsupported", "unrecognized", "not supported", "unknown parameter", "unexpected keyword")
_STATE = "struct<calls:int,attempts:int,strict:boolean,strict_relaxed:boolean,flags_relaxed:boolean,success:boolean,done:boolean,reason:string,kind:string,format_errors:int>"


def _mentions(text: Column, words: tuple[str, ...]) -> Column:
    low, out = F.lower(F.coalesce(text, F.lit(""))), F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return out


def is_client_error(text: Column, status: Column) -> Column:
    """Whether an error looks like a refused request: status 400, or words that say so."""
    return F.coalesce(status == 400, F.lit(False)) | _mentions(text, BAD_REQUEST)


def is_flag_rejection(text: Column, status: Column) -> Column:
    """A refused request that names a flag of the tool binding."""
    return _mentions(text, TOOL_FLAGS) & is_client_error(text, status)


def is_strict_rejection(text: Column, status: Column) -> Column:
    """A refused request that is about the schema, or at least names no flag."""
    return is_client_error(text, status) & (_mentions(text, ("schema",)) | ~_mentions(text, TOOL_FLAGS))


def is_effort_rejection(error_class: Column, text: Column) -> Column:
    """A client that takes no reasoning level."""
    return (error_class == "TypeError") & F.coalesce(text, F.lit("")).contains("reasoning_effort")


def relaxed_attempts(calls: DataFrame, budget: int = 3, strict: bool = True, auto_relax: bool = True, levels: tuple[str, ...] = ()) -> DataFrame:
    """One row for each run of ``calls`` (run_id, n, outcome, error_class, error_text, status): run_id, calls (made),
    attempts (used up), strict_relaxed, flags_relaxed, success, failure_reason, llm_error_kind, format_errors and
    reasoning_effort (of the last call).

    ``outcome`` is ok, parse, schema, ground or rule; a call with an error_class has none. Calls behind a run's end, and
    those that no budget is left for, weren't made; calls that end too soon leave the run failed with llm_error. ``levels``
    are asked for by attempt. A run makes two calls more than its budget at most, so no more are gathered.
    """
    nth = F.row_number().over(Window.partitionBy("run_id").orderBy("n"))
    text, status, failed = F.col("error_text"), F.col("status"), F.col("error_class").isNotNull()
    effort = F.lit(bool(levels)) & is_effort_rejection(F.col("error_class"), text)
    rows = calls.withColumn("nth_", nth).where(F.col("nth_") <= budget + 2)
    seen = F.struct(
        "nth_", F.col("outcome").alias("outcome"), failed.alias("failed"), (failed & ~effort & is_strict_rejection(text, status)).alias("strict"), (failed & ~effort & is_flag_rejection(text, status)).alias("flags"),
        F.when(effort, "invalid_request").otherwise(replay.error_kind(F.col("error_class"))).alias("kind"),
    )
    run = rows.groupBy("run_id").agg(F.array_sort(F.collect_list(seen)).alias("c"))
    names = ("calls", "attempts", "strict", "strict_relaxed", "flags_relaxed", "success", "done", "reason", "kind", "format_errors")
    yes = F.lit(True)

    def step(s: Column, c: Column) -> Column:
        put = lambda **x: F.struct(*[(x[n] if n in x else s[n]).alias(n) for n in names]).cast(_STATE)
        made, used = s["calls"] + 1, s["attempts"] + 1
        plain = F.lit(auto_relax) & s["strict"] & ~s["strict_relaxed"] & c["strict"]
        loose = F.lit(auto_relax) & ~s["flags_relaxed"] & c["flags"]
        error = F.when(plain, put(calls=made, strict=F.lit(False), strict_relaxed=yes)).when(loose, put(calls=made, strict=F.lit(False), flags_relaxed=yes)).otherwise(put(calls=made, done=yes, reason=F.lit("llm_error"), kind=c["kind"]))
        lost = put(calls=made, attempts=used, done=used >= budget, reason=replay.reason(c["outcome"]), format_errors=s["format_errors"] + (c["outcome"] == "parse").cast("int"))
        return F.when(s["done"], s).when(c["failed"], error).when(c["outcome"] == "ok", put(calls=made, success=yes, done=yes)).otherwise(lost)

    zero = F.lit(0)
    start = F.struct(*[x.alias(n) for n, x in zip(names, (zero, zero, F.lit(strict), F.lit(False), F.lit(False), F.lit(False), F.lit(budget <= 0), F.lit(None), F.lit(None), zero))]).cast(_STATE)
    out = run.select("run_id", F.aggregate("c", start, step).alias("s"))
    ok, cut = F.col("s.success"), ~F.col("s.done")
    # attempts used before the last call was made; the last of several levels repeats
    before = F.when(ok | (F.col("s.reason") == "llm_error") | cut, F.col("s.attempts")).otherwise(F.greatest(F.col("s.attempts") - 1, F.lit(0)))
    return out.select(
        "run_id", "s.calls", "s.attempts", "s.strict_relaxed", "s.flags_relaxed", ok.alias("success"), F.when(cut, "llm_error").when(~ok, F.col("s.reason")).alias("failure_reason"),
        F.when(cut, "other").when(~ok & (F.col("s.reason") == "llm_error"), F.col("s.kind")).alias("llm_error_kind"), "s.format_errors", replay.effort(list(levels), before).alias("reasoning_effort"),
    )
