"""Scores of extracted values against expected ones: each check is struct(correct, total)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestor.functions.text import lenient_match, numeric_equal, squashed


@dataclass(frozen=True)
class AtLeast:
    value: float


@dataclass(frozen=True)
class Between:
    low: float
    high: float


def check_field(actual: Column, expected: object, is_list: bool = False) -> Column:
    """The check that the kind of an expected value asks for: a bound, a list of objects (dicts of the same keys), a list of
    scalars, a flag, a number (of a list: its length), else equal text. ``is_list`` says that ``actual`` is an array."""
    text = lambda x: str(x) if x is not None else None
    if isinstance(expected, AtLeast):
        return at_least(actual, expected.value)
    if isinstance(expected, Between):
        return between(actual, expected.low, expected.high)
    if isinstance(expected, list) and expected and isinstance(expected[0], dict):
        whole = F.array(*[F.create_map(*[F.lit(x) for k, v in e.items() for x in (k, text(v))]) for e in expected])
        return object_list(actual, whole.cast("array<map<string,string>>"), list(expected[0]))
    if isinstance(expected, list):
        return scalar_list(actual.cast("array<string>"), F.array(*[F.lit(text(e)) for e in expected]).cast("array<string>"))
    if isinstance(expected, bool):
        return equals_bool(actual, F.lit(expected))
    if isinstance(expected, (int, float)):
        return has_length(actual, F.lit(expected)) if is_list else equals_number(actual.cast("string"), F.lit(float(expected)))
    return _check(squashed(actual.cast("string")) == squashed(F.lit(text(expected))))


def field_total(expected: object) -> int:
    """Checks that an expected value stands for."""
    if isinstance(expected, list):
        return 1 + sum(map(len, expected)) if expected and isinstance(expected[0], dict) else len(expected)
    return 1


def record_accuracy(record: Column, success: Column, expected: dict[str, object], lists: tuple[str, ...] = ()) -> Column:
    """struct(correct, total) of a record against its scenario's expected values; a failed run has none right."""
    if not expected:
        return F.struct(F.lit(0).cast("long").alias("correct"), F.lit(0).cast("long").alias("total"))
    return accuracy(success, *[check_field(record[k], v, k in lists) for k, v in expected.items()])


def cell(value: Column, most: int = 60) -> Column:
    """A value as a cell of a benchmark report: null as a dash, long text cut, pipes and line ends made harmless."""
    text = F.regexp_replace(F.replace(value.cast("string"), F.lit("|"), F.lit("\\|")), r"\s*[\r\n]+\s*", " ")
    return F.coalesce(F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 1)), F.lit("…"))).otherwise(text), F.lit("—"))


def expected_cell(expected: object) -> str:
    """An expected value as a report shows it."""
    if isinstance(expected, AtLeast):
        return f"≥ {expected.value:g}"
    if isinstance(expected, Between):
        return f"{expected.low:g} to {expected.high:g}"
    if isinstance(expected, list):
        return "; ".join(expected_cell(e) for e in expected)
    if isinstance(expected, dict):
        return ", ".join(f"{k}={expected_cell(v)}" for k, v in expected.items())
    return "—" if expected is None else str(expected)


def _check(ok: Column, total: int = 1) -> Column:
    return F.struct(F.when(F.coalesce(ok, F.lit(False)), 1).otherwise(0).cast("long").alias("correct"), F.lit(total).cast("long").alias("total"))


def at_least(actual: Column, least: float) -> Column:
    return _check(actual.try_cast("double") >= least)


def between(actual: Column, low: float, high: float) -> Column:
    return _check(actual.try_cast("double").between(low, high))


def equals_text(actual: Column, expected: Column) -> Column:
    return _check(squashed(actual) == squashed(expected))


def equals_bool(actual: Column, expected: Column) -> Column:
    return _check(squashed(actual.cast("string")) == squashed(expected.cast("string")))


def equals_number(actual: Column, expected: Column) -> Column:
    return _check(numeric_equal(actual, expected))


def has_length(actual: Column, expected: Column) -> Column:
    return _check(F.size(actual) == expected)


def scalar_list(actual: Column, expected: Column) -> Column:
    """A check for each expected item: some actual item matches leniently."""
    hits = F.size(F.filter(expected, lambda e: F.exists(F.coalesce(actual, F.array().cast("array<string>")), lambda a: lenient_match(a, e))))
    return F.struct(hits.cast("long").alias("correct"), F.size(expected).cast("long").alias("total"))


def object_list(actual: Column, expected: Column, keys: list[str]) -> Column:
    """Greedy one-to-one matching of expected objects (array of map<string,string>) with actual ones.

    The first key identifies: an expected object takes, of the actual ones left that match it there, the first of those
    that match most of its keys. One check for the number of objects and one for each key of each.
    """
    def score(a: Column, e: Column) -> Column:
        total = F.lit(0)
        for k in keys:
            total = total + F.when(e[k].isNotNull() & lenient_match(a[k], e[k]), 1).otherwise(0)
        return total

    start = F.struct(F.transform(F.coalesce(actual, F.array().cast("array<map<string,string>>")), lambda a, i: F.struct(i.alias("i"), a.alias("a"))).alias("left"), F.lit(0).alias("correct"))

    def step(s: Column, e: Column) -> Column:
        able = F.filter(s["left"], lambda x: lenient_match(x["a"][keys[0]], e[keys[0]]))
        best = F.get(F.array_sort(F.transform(able, lambda x: F.struct((-score(x["a"], e)).alias("n"), x["i"].alias("i")))), F.lit(0))
        return F.struct(F.filter(s["left"], lambda x: ~x["i"].eqNullSafe(best["i"])).alias("left"), (s["correct"] + F.coalesce(-best["n"], F.lit(0))).alias("correct"))

    matched = F.aggregate(expected, start, step, lambda s: s["correct"])
    same = F.when(F.size(F.coalesce(actual, F.array().cast("array<map<string,string>>"))) == F.size(expected), 1).otherwise(0)
    total = F.aggregate(expected, F.lit(1), lambda n, e: n + F.size(F.filter(F.map_keys(e), lambda k: k.isin(*keys))))
    return F.struct((matched + same).cast("long").alias("correct"), total.cast("long").alias("total"))


def accuracy(success: Column, *checks: Column) -> Column:
    """Sum of checks; a failed run has none right."""
    correct, total = sum((c["correct"] for c in checks), F.lit(0)), sum((c["total"] for c in checks), F.lit(0))
    return F.struct(F.when(success, correct).otherwise(0).cast("long").alias("correct"), total.cast("long").alias("total"))
