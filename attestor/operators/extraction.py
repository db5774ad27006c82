"""From replies to records: parse, validate, ground and apply rules to a table of replies, then replay the attempts.

``replies``: run_id, model_rank, attempt, content, tool_calls and invalid_tool_calls (arrays of struct(id, name, args,
error); either may be absent), error_class, and the columns that sources and rules use. One row is one answer of the
model. The outcome of each row is worked out by itself; what a run makes of its rows is ``replay.replay``.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions.replies import unwrap_array, with_parsed
from attestor.functions.text import let, once, strip_thinking
from attestor.operators import grounding, replay, rules
from attestor.operators.schema import RecordSchema, error_text, input_json, validate

CALLS = "array<struct<id:string,name:string,args:string,error:string>>"
_THINK = r"(?is)<think(?:ing)?>.*?</think(?:ing)?>"


def parse_json_response(read: Column, schema: RecordSchema) -> Column:
    """struct(args, feedback) of a reply that was ``parsed``: the JSON object that it means for a schema, or what to tell
    the model. An array is unwrapped or put into the schema's only list field where that is meant."""

    def told(p: Column) -> Column:
        unread = F.concat(F.lit("The reply could not be read as JSON ("), p["read"]["error"], F.lit(f"). Answer with one JSON object for {schema.name} and nothing else."))
        wrong = F.concat(p["opened"]["error"], F.lit(f" (schema {schema.name})."))
        return F.struct(p["opened"]["json"].alias("args"), F.when(p["read"]["json"].isNull(), unread).when(p["opened"]["json"].isNull(), wrong).alias("feedback"))

    return let(F.struct(read.alias("read"), unwrap_array(read["json"], schema.known_keys(), schema.sole_list_field()).alias("opened")), told)


def parse_tool_response(calls: Column, invalid: Column, schema: RecordSchema) -> Column:
    """struct(args, feedback) of a reply by tool call: the first call's arguments, if there is a call and no broken one.

    A broken first call whose arguments hold think tags is read once these are off; its name isn't asked.
    """
    n_calls, n_bad = F.coalesce(F.size(calls), F.lit(0)), F.coalesce(F.size(invalid), F.lit(0))
    bad = F.get(invalid, F.lit(0))
    freed = F.when(bad["args"].rlike(_THINK), strip_thinking(bad["args"]))
    kind = F.schema_of_variant(F.try_parse_json(F.concat(F.lit("["), freed, F.lit("]"))))
    args = F.when((n_calls > 0) & (n_bad == 0), F.get(calls, F.lit(0))["args"]).when((n_bad > 0) & kind.startswith("ARRAY<OBJECT"), freed)
    detail = F.when(n_bad > 0, F.concat(F.lit("\nThe call that was made is broken: "), F.coalesce(bad["error"], F.lit("unknown")), F.lit("\nIts arguments: "), F.coalesce(bad["args"], F.lit("none"))))
    told = F.concat(F.lit(f"The reply holds no valid call of the tool {schema.name}. Call it with one JSON object that fits its schema."), F.coalesce(detail, F.lit("")))
    return F.struct(args.alias("args"), F.when(args.isNull(), told).alias("feedback"))


def extracted(replies: DataFrame, schema: RecordSchema, mode: str = "json", source: Column | None = None, sources: dict[str, Column] | None = None, rule: Callable[..., Column] | None = None, budgets: tuple[int, ...] = (3, 3), levels: tuple[str, ...] = ()) -> DataFrame:
    """Adds what becomes of each reply: outcome (ok, parse, schema, ground, rule, llm_error), error_kind, record (of ok,
    ground and rule: the candidate), issues (as ``rules.ISSUE``) and feedback for the model.

    ``mode`` is json (the content) or tools (the calls). Values are checked against ``source`` and named ``sources``;
    ``rule`` gets the record and gives an array of findings (see ``rules.findings``); a ``rules.contextual`` one also gets
    what is known of its attempt, for which the ``budgets`` of the models and the reasoning ``levels`` are given. A
    row with an error_class never got a reply. Null content is an empty reply.
    """
    if mode not in ("json", "tools"):
        raise ValueError("mode is json or tools")
    if mode == "json":
        rows = with_parsed(replies, F.when(F.col("error_class").isNull(), F.coalesce("content", F.lit(""))), "parsed_")
        rows = once(rows, read_=parse_json_response(F.col("parsed_"), schema)).drop("parsed_")
    else:
        rows = once(replies, read_=parse_tool_response(*[F.col(c) if c in replies.columns else F.lit(None).cast(CALLS) for c in ("tool_calls", "invalid_tool_calls")], schema))
    rows = once(rows, valid_=validate(F.col("read_.args"), schema)).withColumn("candidate_", F.col("valid_.record"))
    rows = grounding.grounded(rows, schema, "candidate_", source, sources, "grounding_")
    if isinstance(rule, rules.Contextual):
        rank = F.col("model_rank")
        budget = F.get(F.array(*[F.lit(b) for b in budgets]), rank.cast("int"))
        found = rule(F.col("candidate_"), rules.with_context(F.col("attempt"), budget, rank, len(budgets) - 1, replay.effort(list(levels), F.col("attempt"))))
    else:
        found = rule(F.col("candidate_")) if rule is not None else rules.findings()
    if rule is not None:  # a rule may be a Python function, which has to be a column of its own
        rows = rows.withColumn("ruled_", found)
        found = F.col("ruled_")
    rows = once(rows, found_=F.when(F.col("candidate_").isNotNull(), found))
    rows = once(rows, check_=F.when(F.col("candidate_").isNotNull(), rules.check_candidate(F.col("grounding_"), F.col("found_"))))
    failed = F.col("error_class").isNotNull()
    outcome = (
        F.when(failed, "llm_error").when(F.col("read_.args").isNull() | F.col("valid_").isNull(), "parse").when(F.col("candidate_").isNull(), "schema")
        .when(F.col("check_.stage") == "grounding", "ground").when(F.col("check_.stage") == "rules", "rule").otherwise("ok")
    )
    rows = once(rows, outcome=outcome, error_kind=F.when(failed, replay.error_kind(F.col("error_class"))))
    own = F.transform("valid_.issues", lambda i: F.struct(i["field_path"].alias("field_path"), i["category"].alias("category"), i["error_type"].alias("error_type"), i["message"].alias("message"), i["received"].alias("received"), F.lit(True).alias("rejecting")))
    held, none = F.col("outcome").isin("ok", "ground", "rule"), F.array().cast(rules.ISSUE)
    told = F.when(F.col("outcome") == "parse", F.coalesce("read_.feedback", F.lit("The arguments are not a JSON object."))).when(F.col("outcome") == "schema", error_text(F.col("valid_.issues"), schema)).when(held, F.col("check_.feedback"))
    rows = once(
        rows,
        record=F.when(held, F.col("candidate_")),
        issues=F.when(F.col("outcome") == "schema", own.cast(rules.ISSUE)).when(held, F.col("check_.issues")).otherwise(none),
        feedback=F.when(F.col("outcome") != "ok", told),
    )
    return rows.drop("read_", "valid_", "candidate_", "grounding_", "found_", "check_", "ruled_")


def runs(attempts: DataFrame, all_runs: DataFrame, schema: RecordSchema, primary_budget: int = 3, fallback_budget: int = 3, fallback: bool = True, capture: Column | None = None) -> DataFrame:
    """One row for each run of ``all_runs``, from ``extracted`` replies: what ``replay.replay`` gives, and the record,
    schema_name, field_issues of all attempts made in order (each with its attempt), last_rejection and item_count.

    ``capture`` is the source text, kept only where it is asked for.
    """
    live = replay.live_attempts(attempts if fallback else attempts.where("model_rank = 0"), primary_budget, fallback_budget)
    at = F.struct("model_rank", "attempt")
    numbered = F.transform("issues", lambda i: i.withField("attempt", F.col("attempt")))
    told = F.when(F.col("outcome").isin("ground", "rule"), F.filter("issues", lambda i: i["rejecting"]))
    each = live.groupBy("run_id").agg(
        F.max_by(F.when(F.col("outcome") == "ok", F.col("record")), F.when(F.col("outcome") == "ok", at)).alias("record"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("model_rank", "attempt", numbered.alias("issues")))), lambda x: x["issues"])).alias("field_issues"),
        F.max_by(told, F.when(told.isNotNull(), at)).alias("last_rejection"),
        *([F.first(capture, ignorenulls=True).alias("source_text")] if capture is not None else []),
    )
    text = attempts.withColumn("record", input_json(F.col("record"), schema))
    out = replay.replay(text, all_runs, primary_budget, fallback_budget, fallback).join(each, "run_id", "left")
    out = out.withColumn("field_issues", F.coalesce("field_issues", F.array().cast(each.schema["field_issues"].dataType))).withColumn("schema_name", F.lit(schema.name))
    sole = schema.fields[0].name if schema.sole_list_field() is not None else None
    return out.withColumn("item_count", F.size(F.col("record")[sole]) if sole is not None else F.lit(None).cast("int"))


def salvaged(finished: DataFrame, schema: RecordSchema, repair: Callable[[Column, Column], Column]) -> DataFrame:
    """Failed ``runs`` with a candidate, mended: ``repair`` gets the candidate's JSON text and the issues that rejected
    it, and gives the JSON text to take instead (null: none). It is validated again, by the schema alone; what fits
    makes the run a success that is marked salvaged, and what doesn't leaves an issue at ``rules.EXHAUSTED_PATH``."""
    rows = finished.withColumn("repaired_", F.when(~F.col("success") & F.col("candidate").isNotNull(), repair(F.col("candidate"), F.col("last_rejection"))))
    rows = rows.withColumn("valid_", validate(F.col("repaired_"), schema)).withColumn("salvaged", F.coalesce(F.col("valid_.record").isNotNull(), F.lit(False)))
    last = F.coalesce(F.array_max(F.transform("field_issues", lambda i: i["attempt"])), F.lit(0))
    broken = F.struct(F.lit(rules.EXHAUSTED_PATH).alias("field_path"), F.lit("other").alias("category"), F.lit("on_exhausted_invalid").alias("error_type"), F.coalesce(error_text(F.col("valid_.issues"), schema), F.lit("not a JSON object")).alias("message"), F.lit(None).cast("string").alias("received"), F.lit(True).alias("rejecting"), last.alias("attempt"))
    failed = F.col("repaired_").isNotNull() & ~F.col("salvaged")
    rows = rows.withColumn("field_issues", F.when(failed, F.concat("field_issues", F.array(broken).cast(finished.schema["field_issues"].dataType))).otherwise(F.col("field_issues")))
    rows = rows.withColumn("record", F.coalesce("record", "valid_.record")).withColumn("success", F.col("success") | F.col("salvaged"))
    for c in ("failure_reason", "llm_error_kind"):
        rows = rows.withColumn(c, F.when(~F.col("success"), F.col(c)))
    return rows.drop("repaired_", "valid_")


def items(finished: DataFrame, item: RecordSchema, key: str = "items") -> DataFrame:
    """Runs of ``item.listed(key)`` as one row for each item: run_id, success, item_count, index, item; a run without items
    keeps a row."""
    return finished.select("run_id", "success", "item_count", F.posexplode_outer(F.col("record")[key]).alias("index", "item"))


def list_salvage(candidate: Column, rejection: Column, schema: RecordSchema) -> Column:
    """A ``repair`` for ``salvaged``: the list without the items that rejecting issues lie in."""
    key = schema.fields[0]
    record = validate(candidate, schema)["record"]
    return let(record, lambda r: input_json(r.withField(key.name, rules.kept_items(r[key.name], rejection, key.keys()[0])), schema))


def json_prompt(schema: RecordSchema) -> str:
    """What tells a model to answer with one JSON object of this schema."""
    return f"Answer with one JSON object that fits the JSON Schema below, without fences, comments or other text.\n\nJSON Schema of {schema.name}:\n{json.dumps(schema.json_schema(), indent=2, ensure_ascii=False)}"
