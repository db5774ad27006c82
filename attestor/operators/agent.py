"""Replay of agent runs: a fold over a run's ordered turns that keeps retries, reasons and the last accepted answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions.text import once
from attestor.operators import rules
from attestor.operators.replay import error_kind
from attestor.operators.schema import RecordSchema, error_text, input_json, validate

_STATE = "struct<iterations:int,retries:int,format_errors:int,helpers:int,reason:string,success:boolean,answer:string,candidate:string,done:boolean>"


def _call(s: Column, c: Column, most: int) -> Column:
    """One call of a turn: a helper is counted; a final answer is accepted, or costs a retry, or spends the budget."""
    helper, ok = c["kind"] == "helper", c["outcome"] == "ok"
    limit = s["retries"] >= most
    return F.struct(
        s["iterations"].alias("iterations"), (s["retries"] + F.when(~helper & ~ok & ~limit, 1).otherwise(0)).alias("retries"), s["format_errors"].alias("format_errors"),
        (s["helpers"] + helper.cast("int")).alias("helpers"), F.when(~helper & ~ok, "validation_exhausted").otherwise(s["reason"]).alias("reason"), (s["success"] | (~helper & ok)).alias("success"),
        F.when(~helper & ok, c["record"]).otherwise(s["answer"]).alias("answer"), F.when(~helper & c["outcome"].isin("ground", "rule"), c["record"]).otherwise(s["candidate"]).alias("candidate"), (s["done"] | (~helper & ~ok & limit)).alias("done"),
    )


def _turn(s: Column, t: Column, most: int, json_mode: bool) -> Column:
    put = lambda **x: F.struct(*[(x[n] if n in x else s[n]).alias(n) for n in ("iterations", "retries", "format_errors", "helpers", "reason", "success", "answer", "candidate", "done")])
    it, limit, fail = s["iterations"] + 1, s["retries"] >= most, F.lit("no_tool_call")
    more, spent = s["retries"] + F.when(limit, 0).otherwise(1), s["done"] | limit
    broken = put(iterations=it, format_errors=s["format_errors"] + 1, reason=F.lit("parse_error"), retries=more, done=spent)
    if json_mode:  # a turn without calls is the final answer
        c = F.get(t["calls"], F.lit(0))
        ok = c["outcome"] == "ok"
        bad = put(iterations=it, reason=F.lit("validation_exhausted"), retries=more, done=spent, candidate=F.when(c["outcome"].isin("ground", "rule"), c["record"]).otherwise(s["candidate"]))
        silent = F.when(ok, put(iterations=it, success=F.lit(True), answer=c["record"], done=F.lit(True))).when(c["outcome"] == "parse", broken).otherwise(bad)
    else:
        silent = put(iterations=it, reason=fail, retries=more, done=spent)
    # malformed calls count before a think-tagged one may still be read, if there is budget left
    begun = F.when(t["kind"] == "recovered", put(iterations=it, format_errors=s["format_errors"] + 1, reason=F.lit("parse_error"))).otherwise(put(iterations=it))
    after = F.aggregate(t["calls"], begun, lambda a, c: _call(a, c, most))
    after = F.struct(*[(after["done"] | after["success"] if n == "done" else after[n]).alias(n) for n in ("iterations", "retries", "format_errors", "helpers", "reason", "success", "answer", "candidate", "done")])
    error = put(reason=F.lit("llm_error"), done=F.lit(True))
    return F.when(t["kind"] == "llm_error", error).when(t["kind"] == "none", silent).when((t["kind"] == "invalid") | ((t["kind"] == "recovered") & limit), broken).otherwise(after)


def replay_agent(turns: DataFrame, most_iterations: int = 12, most_retries: int = 3, json_mode: bool = False) -> DataFrame:
    """One row for each run of ``turns``: run_id, turn, kind (calls, none, invalid, recovered, llm_error), calls
    array<struct<kind (final, helper), outcome, record>>.

    A run ends with the turn in which a final answer is accepted (the last accepted one counts; every call of the
    turn is answered first), with one rejected when no retry is left, or after ``most_iterations`` turns.
    """
    first = turns.withColumn("nth_", F.row_number().over(Window.partitionBy("run_id").orderBy("turn"))).where(F.col("nth_") <= most_iterations)
    told = "issues" in turns.schema["calls"].dataType.elementType.names
    classed = [F.col("error_class")] if "error_class" in turns.columns else []
    run = first.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("turn", "kind", "calls", *classed))).alias("turns"))
    out = run.select("run_id", "turns", F.aggregate("turns", started(), lambda s, t: advanced(s, t, most_iterations, most_retries, json_mode)).alias("s"))
    ok = F.col("s.success")
    more = []
    if told:
        made = F.flatten(F.transform(F.slice("turns", 1, F.col("s.iterations")), lambda t: t["calls"]))
        last = F.try_element_at(F.filter(made, lambda c: (c["kind"] != "helper") & c["outcome"].isin("ground", "rule")), F.lit(-1))
        issues = F.flatten(F.transform(F.filter(made, lambda c: c["issues"].isNotNull()), lambda c: c["issues"]))
        more += [issues.alias("field_issues"), F.when(~ok, F.filter(last["issues"], lambda i: i["rejecting"])).alias("last_rejection")]
    if classed:
        failed = F.get("turns", F.col("s.iterations"))["error_class"]
        more.append(F.when(~ok & (F.col("s.reason") == "llm_error"), F.coalesce(error_kind(failed), F.lit("other"))).alias("llm_error_kind"))
    return out.select("run_id", ok.alias("success"), "s.iterations", F.col("s.retries").alias("validation_retries"), "s.format_errors", F.col("s.helpers").alias("tool_calls"), F.when(~ok, F.coalesce("s.reason", F.lit("validation_exhausted"))).alias("failure_reason"), F.when(ok, F.col("s.answer")).alias("record"), F.when(~ok, F.col("s.candidate")).alias("candidate"), *more)


def started() -> Column:
    """State of a run that has made no turn."""
    return F.expr(f"cast(named_struct('iterations', 0, 'retries', 0, 'format_errors', 0, 'helpers', 0, 'reason', null, 'success', false, 'answer', null, 'candidate', null, 'done', false) as {_STATE})")


def advanced(s: Column, t: Column, most_iterations: int, most_retries: int, json_mode: bool = False) -> Column:
    """State of a run after one more turn."""
    return F.when(s["done"] | (s["iterations"] >= most_iterations), s).otherwise(_turn(s, t, most_retries, json_mode).cast(_STATE))


def replay_agents(turns: DataFrame, most_iterations: int = 12, most_retries: int = 3, json_mode: bool = False, fallback: bool = True) -> DataFrame:
    """``replay_agent`` of runs of which each may go on with a second model (``model_rank`` 1) where the first failed: one row
    a run of rank 0, counts summed over both, and fallback_used. The fallback's reason, kind, candidate and rejection
    win where it has them; a fallback without turns failed with llm_error. Issues of both stay."""
    first = replay_agent(turns.where("model_rank = 0"), most_iterations, most_retries, json_mode)
    if not fallback:
        return first.withColumn("fallback_used", F.lit(False))
    second = replay_agent(turns.where("model_rank = 1"), most_iterations, most_retries, json_mode)
    both = first.alias("p").join(second.alias("f"), "run_id", "left")
    p, f = (lambda c: F.col(f"p.{c}")), (lambda c: F.col(f"f.{c}"))
    done, won = p("success"), F.coalesce(f("success"), F.lit(False))
    used, ok, no_turn = ~done, done | won, f("success").isNull()
    summed = [(p(c) + F.when(used, F.coalesce(f(c), F.lit(0))).otherwise(0)).alias(c) for c in ("iterations", "validation_retries", "format_errors", "tool_calls")]
    own = F.when(f("candidate").isNotNull(), f("candidate")).otherwise(p("candidate"))
    out = [
        ok.alias("success"), *summed, F.when(~ok, F.when(no_turn, "llm_error").otherwise(F.coalesce(f("failure_reason"), p("failure_reason")))).alias("failure_reason"),
        F.when(done, p("record")).when(won, f("record")).alias("record"), F.when(~ok, own).alias("candidate"), used.alias("fallback_used"),
    ]
    if "field_issues" in first.columns:
        none = F.array().cast(first.schema["field_issues"].dataType)
        out += [F.concat(F.coalesce(p("field_issues"), none), F.when(used, F.coalesce(f("field_issues"), none)).otherwise(none)).alias("field_issues"), F.when(~ok, F.when(f("candidate").isNotNull(), f("last_rejection")).otherwise(p("last_rejection"))).alias("last_rejection")]
    if "llm_error_kind" in first.columns:
        out.append(F.when(~ok, F.when(no_turn, "other").otherwise(f("llm_error_kind"))).alias("llm_error_kind"))
    return both.select("run_id", *out)


def salvaged(finished: DataFrame, schema: RecordSchema, repair: Callable[[Column, Column], Column]) -> DataFrame:
    """Failed agent runs with a candidate, mended: ``repair`` gets its JSON text and the issues that rejected it and gives
    the JSON text to take instead (null: none), which is validated by the schema alone. Adds ``salvaged``; what doesn't
    fit leaves an issue at ``rules.EXHAUSTED_PATH``."""
    rows = finished.withColumn("repaired_", F.when(~F.col("success") & F.col("candidate").isNotNull(), repair(F.col("candidate"), F.col("last_rejection"))))
    rows = once(rows, valid_=validate(F.col("repaired_"), schema))
    rows = once(rows, salvaged=F.coalesce(F.col("valid_.record").isNotNull(), F.lit(False)), mended_=input_json(F.col("valid_.record"), schema))
    broken = F.struct(F.lit(rules.EXHAUSTED_PATH).alias("field_path"), F.lit("other").alias("category"), F.lit("on_exhausted_invalid").alias("error_type"), F.coalesce(error_text(F.col("valid_.issues"), schema), F.lit("not a JSON object")).alias("message"), F.lit(None).cast("string").alias("received"), F.lit(True).alias("rejecting"))
    failed = F.col("repaired_").isNotNull() & ~F.col("salvaged")
    rows = rows.withColumn("field_issues", F.when(failed, F.concat("field_issues", F.array(broken).cast(finished.schema["field_issues"].dataType))).otherwise(F.col("field_issues")))
    rows = rows.withColumn("record", F.coalesce("record", "mended_")).withColumn("success", F.col("success") | F.col("salvaged"))
    for c in ("failure_reason", "llm_error_kind"):
        rows = rows.withColumn(c, F.when(~F.col("success"), F.col(c))) if c in finished.columns else rows
    return rows.drop("repaired_", "valid_", "mended_")
