"""User rules on validated records, the check of a candidate, salvage, and list items named by issue paths."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ISSUE = "array<struct<field_path:string,category:string,error_type:string,message:string,received:string,rejecting:boolean>>"
#: Where findings without a field are filed.
VALIDATOR_PATH, EXHAUSTED_PATH = "<external validator>", "<on_exhausted>"


def finding(broken: Column, message: Column | str, path: str = VALIDATOR_PATH, reject: bool = True, value: Column | None = None) -> Column:
    """An issue where ``broken`` holds, else null; a null condition is not broken."""
    shown = F.lit(None).cast("string") if value is None else F.left(value.cast("string"), F.lit(120))
    return F.when(broken, F.struct(F.lit(path).alias("field_path"), F.lit("other").alias("category"), F.lit("validator").alias("error_type"), (F.lit(message) if isinstance(message, str) else message).alias("message"), shown.alias("received"), F.lit(reject).alias("rejecting")))


def findings(*each: Column) -> Column:
    return F.array_compact(F.array(*each)).cast(ISSUE) if each else F.array().cast(ISSUE)


def check_candidate(grounding: Column, rules: Column) -> Column:
    """Grounding first; rules only where it doesn't reject. struct(issues, accepted, stage, feedback)."""
    rejects = lambda a: F.exists(a, lambda i: i["rejecting"])
    by_ground = rejects(grounding)
    issues = F.when(by_ground, grounding).otherwise(F.concat(grounding, rules))
    by_rule = ~by_ground & rejects(rules)
    return F.struct(issues.alias("issues"), (~by_ground & ~by_rule).alias("accepted"), F.when(by_ground, "grounding").when(by_rule, "rules").alias("stage"), F.when(by_ground | by_rule, feedback(F.filter(issues, lambda i: i["rejecting"]))).alias("feedback"))


def feedback(issues: Column) -> Column:
    """Text of findings by path in order of appearance; a single one without a field is its bare message."""
    paths = F.array_distinct(F.transform(issues, lambda i: i["field_path"]))
    blocks = F.transform(paths, lambda p: F.concat(p, F.lit(":\n"), F.array_join(F.transform(F.filter(issues, lambda i: i["field_path"] == p), lambda i: F.concat(F.lit("- "), i["message"])), "\n")))
    single = (F.size(issues) == 1) & (F.get(issues, F.lit(0))["field_path"] == VALIDATOR_PATH)
    return F.when(single, F.get(issues, F.lit(0))["message"]).otherwise(F.array_join(blocks, "\n"))


def with_context(attempt: Column, budget: int | Column, model_rank: Column, last_rank: int, effort: Column | None = None) -> Column:
    """What a rule may know of its attempt: number from 1, last of the model, final of the run, fallback, level."""
    last = attempt + 1 >= budget
    return F.struct((attempt + 1).alias("attempt"), F.lit(budget).alias("max_attempts"), (last & (model_rank >= last_rank)).alias("is_final"), (model_rank > 0).alias("is_fallback"), (effort if effort is not None else F.lit(None).cast("string")).alias("reasoning_effort"))


def item_index(path: Column, list_field: str = "items") -> Column:
    """Number of the list item that a path lies in, or null."""
    return F.nullif(F.regexp_extract(path, f"^{list_field} -> ([0-9]+)(?: -> |$)", 1), F.lit("")).try_cast("int")


def item_path(index: Column, path: Column, list_field: str = "items") -> Column:
    """Path of an item's issue in its container; a finding without a field is the item's own."""
    at = F.concat(F.lit(f"{list_field} -> "), index.cast("string"))
    return F.when(path == VALIDATOR_PATH, at).otherwise(F.concat(at, F.lit(" -> "), path))


def item_rules(items: Column, rule) -> Column:
    """Findings of ``rule`` (item to array of issues) on every item, under the item's path."""
    found = F.transform(items, lambda x, i: F.transform(rule(x), lambda f: F.struct(item_path(i, f["field_path"]).alias("field_path"), f["category"].alias("category"), f["error_type"].alias("error_type"), f["message"].alias("message"), f["received"].alias("received"), f["rejecting"].alias("rejecting"))))
    return F.flatten(found).cast(ISSUE)


def kept_items(items: Column, issues: Column, list_field: str = "items") -> Column:
    """Salvage of a list: items that no rejecting issue lies in."""
    bad = F.transform(F.filter(issues, lambda i: i["rejecting"]), lambda i: item_index(i["field_path"], list_field))
    return F.filter(items, lambda x, i: ~F.coalesce(F.array_contains(F.array_compact(bad), i), F.lit(False)))


@dataclass(frozen=True)
class Finding:
    """What a Python rule says about a record; ``reject`` or only to be noted."""

    message: str
    path: str = VALIDATOR_PATH
    reject: bool = True
    received: object = None


@dataclass(frozen=True)
class Contextual:
    """A rule that is also told of its attempt: see ``contextual``."""

    rule: Callable[[Column, Column], Column]

    def __call__(self, record: Column, context: Column) -> Column:
        return self.rule(record, context)


def contextual(rule: Callable[[Column, Column], Column]) -> Contextual:
    """Mark a rule that takes the record and ``with_context`` of its attempt."""
    return Contextual(rule)


def _found(outcome: object) -> list[Finding]:
    """Findings out of what a Python rule gave: nothing (or anything false) accepts, a text rejects with it, as does each
    text of a sequence; findings stay. Anything else is an error of the rule's author and ends the query."""
    if not outcome:
        return []
    if isinstance(outcome, str):
        return [Finding(outcome)]
    if isinstance(outcome, Finding):
        return [outcome]
    if isinstance(outcome, Sequence) and all(isinstance(x, (str, Finding)) for x in outcome):
        return [Finding(x) if isinstance(x, str) else x for x in outcome if x]
    raise TypeError(f"a rule gives None, a text, a Finding or a sequence of texts and Findings; this one gave {outcome!r}")


def python_rule(check: Callable, with_attempt: bool = False) -> Callable[..., Column]:
    """A rule out of a Python function of the record (a dict, nested records as dicts, dates and decimals as text) and, if
    ``with_attempt``, of its attempt (a dict of ``with_context``). What it raises rejects the record with the error's text.

    Records travel to it in Arrow batches as JSON; rules that columns can express should stay columns.
    """

    def one(record: str | None, context: str | None) -> list[tuple]:
        if record is None:
            return []
        given = [json.loads(record), *([json.loads(context)] if with_attempt else [])]
        try:
            outcome = check(*given)
        except Exception as e:  # a rule may raise anything to reject
            outcome = str(e) or f"{type(e).__name__} was raised by the rule"
        shown = lambda x: None if x is None else (x if isinstance(x, str) else json.dumps(x, ensure_ascii=False, default=str))[:120]
        return [(f.path, "other", "validator", f.message, shown(f.received), f.reject) for f in _found(outcome)]

    @F.pandas_udf(ISSUE)
    def run(records: pd.Series, contexts: pd.Series) -> pd.Series:
        return pd.Series([one(r, c) for r, c in zip(records, contexts)], dtype=object)

    def rule(record: Column, context: Column | None = None) -> Column:
        told = F.to_json(context, {"ignoreNullFields": "false"}) if context is not None else F.lit(None).cast("string")
        return run(F.to_json(record, {"ignoreNullFields": "false"}), told)

    return contextual(rule) if with_attempt else rule
