"""Text clean-up, comparison and containment as column expressions; NFKD folding and fuzzy search through Arrow."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

#: Block types that carry a model's own reasoning, not its answer (fixed values).
REASONING_BLOCKS = ("reasoning", "thinking", "redacted_thinking")


def let(c: Column, use) -> Column:
    """``use`` of a value that is worked out once: an expression that is named often would be copied as often."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are worked out once for each row: a generator between projections keeps the optimizer from
    merging these and copying an expression to wherever its column is named."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def strip_thinking(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?is)<think(?:ing)?>.*?</think(?:ing)?>", ""), F.lit(" \t\r\n"))


def strip_fence(c: Column) -> Column:
    """A fenced text loses its first line, and its last if that begins with a fence."""

    def inside(t: Column) -> Column:
        body = F.regexp_replace(F.regexp_replace(t, r"^[^\n]*\n?", ""), r"(?:^|\n)```[^\n]*$", "")
        return F.when(t.startswith("```"), F.trim(body, F.lit(" \t\r\n"))).otherwise(t)

    return let(c, inside)


def flatten_blocks(blocks: Column) -> Column:
    """Answer text of an array of struct(type, text) blocks."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["text"].isNotNull() & ~F.coalesce(b["type"], F.lit("text")).isin(*REASONING_BLOCKS)), lambda b: b["text"]), "\n")


def plain_text(blocks: Column) -> Column:
    """All blocks in one line: text as it is, tool calls left out, other kinds as [type]."""
    seen = F.filter(blocks, lambda b: ~F.coalesce(b["type"], F.lit("text")).isin("tool_use", "tool_call", "function_call"))
    return F.array_join(F.transform(seen, lambda b: F.when(F.coalesce(b["type"], F.lit("text")) == "text", F.coalesce(b["text"], F.lit(""))).otherwise(F.concat(F.lit("["), b["type"], F.lit("]")))), " ")


def truncated(c: Column, n: int = 120) -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n - 1)), F.lit("…"))).otherwise(c)


def received(c: Column) -> Column:
    """How an issue shows a value: at most 120 characters, null and N/A as null."""
    return F.when(c != "N/A", truncated(c))


def error_category(error_type: Column) -> Column:
    """Coarse category of a validation error type; the order of the cases decides."""
    return (
        F.when(error_type == "missing", "missing")
        .when((error_type == "literal_error") | error_type.contains("enum"), "enum")
        .when(error_type.contains("type") | error_type.contains("parsing"), "type")
        .when(error_type.isin("string_too_short", "string_too_long", "value_error", "greater_than", "less_than", "greater_than_equal", "less_than_equal"), "value")
        .otherwise("other")
    )


def expected_type(error_type: Column, message: Column) -> Column:
    """The type that a type error asks for: the first of int, float, bool, str that its kind or message names; else a
    list or an object, if the message names one; else the message itself."""
    low = F.lower(message)
    out = None
    for key, label in (("int", "integer"), ("float", "float"), ("bool", "boolean"), ("str", "string")):
        named = error_type.contains(key) | low.contains(key)
        out = F.when(named, label) if out is None else out.when(named, label)
    return out.when(low.contains("list") | low.contains("array"), "list/array").when(low.contains("dict") | low.contains("object"), "dict/object").otherwise(low)


def squashed(c: Column) -> Column:
    """Trimmed, lower case, no spaces: the form in which scores compare values."""
    return F.replace(F.lower(F.trim(c)), F.lit(" "), F.lit(""))


def lenient_match(actual: Column, expected: Column) -> Column:
    """Equal, or one inside the other, once squashed; an empty side must equal the other."""
    a, e = squashed(F.coalesce(actual, F.lit("None"))), squashed(F.coalesce(expected, F.lit("None")))
    return F.when((a == "") | (e == ""), a == e).otherwise(a.contains(e) | e.contains(a))


def numeric_equal(actual: Column, expected: Column) -> Column:
    a, e = actual.try_cast("double"), expected.cast("double")
    return F.coalesce(F.abs(a - e) <= F.lit(1e-9) + F.lit(1e-6) * F.abs(e), F.lit(False))


def fold(text: str) -> str:
    """Canonical form for containment: compatibility decomposition without marks, one space for white space, case folded."""
    plain = "".join(ch for ch in unicodedata.normalize("NFKD", text) if not unicodedata.combining(ch))
    return " ".join(plain.split()).casefold()


def _fold_each(texts: pd.Series) -> pd.Series:
    """``fold`` of a column; texts that repeat in a batch are folded once."""
    known: dict[str, str] = {}
    return texts.map(lambda t: None if t is None else known.setdefault(t, fold(t)) if t not in known else known[t])


@F.pandas_udf(StringType())
def _folded(texts: pd.Series) -> pd.Series:
    return _fold_each(texts)


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.char_length(c)


def normalized(c: Column) -> Column:
    """``fold`` for any text; ASCII is folded in the JVM, and only other text reaches Python."""
    plain = is_ascii(c)
    return F.when(plain, normalized_ascii(c)).otherwise(_folded(F.when(~plain, c)))


def normalized_ascii(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"[\s\x1c-\x1f]+", " ")))


def folded_form(c: Column) -> Column:
    """``normalized_ascii`` of a short text; most have no white space to squeeze, and so need no pattern."""
    return F.when(c.contains("  ") | (F.translate(c, _WHITE, "") != c), normalized_ascii(c)).otherwise(F.lower(F.trim(c)))


_WHITE = "\t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"


def occurring(forms: Iterable[str], texts: Iterable[str]) -> list[set[str]]:
    """For each text, which of the forms occur in it: one automaton of all forms reads each text once. An empty form
    occurs everywhere."""
    wanted = dict.fromkeys(forms)
    find = ahocorasick.Automaton()
    for form in wanted:
        if form:
            find.add_word(form, form)
    always = {""} & wanted.keys()
    if not len(find):
        return [set(always) for _ in texts]
    find.make_automaton()
    return [always | {form for _, form in find.iter(text)} for text in texts]


@F.pandas_udf(BooleanType())
def _holds_any(all_forms: pd.Series, sources: pd.Series) -> pd.Series:
    known: dict[str, str] = {}
    each = [None if forms is None or source is None else [known[f] if f in known else known.setdefault(f, fold(f)) for f in forms if f is not None] for forms, source in zip(all_forms, sources)]
    texts = dict.fromkeys(s for s, forms in zip(sources, each) if forms)
    found = dict(zip(texts, occurring({f for forms in each if forms for f in forms}, map(fold, texts))))
    return pd.Series([None if forms is None else bool(forms) and not found[s].isdisjoint(forms) for s, forms in zip(sources, each)], dtype=object)


def contains_any(forms: Column, source: Column) -> Column:
    """Whether the folded ``source`` holds any of an array of forms, folded.

    Where source and forms are ASCII, all of it happens in the JVM; each source is folded once. Forms that take several
    steps to make should be a column of their own (see ``once``), as an argument of a Python function is worked out
    beside it.
    """
    plain = F.coalesce(is_ascii(source) & F.forall(forms, lambda f: F.coalesce(is_ascii(f), F.lit(True))), F.lit(False))
    here = let(normalized_ascii(source), lambda hay: F.exists(forms, lambda f: F.coalesce(F.contains(hay, folded_form(f)), F.lit(False))))
    there = _holds_any(F.when(~plain, forms), F.when(~plain, source))
    return F.when(forms.isNull() | source.isNull(), F.lit(None)).when(plain, here).otherwise(there)


def substring_distance(needle: str, haystack: str) -> int:
    """Edits from ``needle`` to the nearest substring of ``haystack``: a row of the table at a time, in arrays.

    Within a row, insertions carry along as a running minimum of (value - column).
    """
    hay = np.frombuffer(haystack.encode("utf-32-le"), np.uint32)
    column, row = np.arange(len(hay) + 1), np.zeros(len(hay) + 1, np.int64)
    for i, ch in enumerate(needle, 1):
        best = np.minimum(row[1:] + 1, row[:-1] + (hay != ord(ch)))
        row = np.minimum.accumulate(np.r_[i, best] - column) + column
    return int(row.min())


def within(needle: str, haystack: str, most: int) -> bool:
    """Whether a substring of ``haystack`` is at most so many edits away: a column of the table at a time, held as two
    whole numbers that have a bit for each row (where it rises and where it falls)."""
    if most >= len(needle):
        return True
    rows, every = {}, (1 << len(needle)) - 1
    for i, ch in enumerate(needle):
        rows[ch] = rows.get(ch, 0) | 1 << i
    up, down, score, last = every, 0, len(needle), 1 << (len(needle) - 1)
    for ch in haystack:
        same = rows.get(ch, 0)
        level = (((same & up) + up) ^ up) | same | down
        rises = (down | ~(level | up)) & every
        falls = up & level
        score += bool(rises & last) - bool(falls & last)
        if score <= most:
            return True
        rises, falls = rises << 1 & every, falls << 1 & every
        up = (falls | ~(same | down | rises)) & every
        down = rises & (same | down)
    return False


def fuzzy_hit(needle: str, haystack: str, threshold: float) -> bool:
    """Whether ``needle`` occurs but for a share of edits.

    With k edits allowed, one of k + 1 parts of the needle stands in the text unchanged. Only the surroundings of such
    places are searched; where no part occurs, nothing is.
    """
    n = len(needle)
    if not n or needle in haystack:
        return bool(n)
    most = max((d for d in range(n + 1) if 1 - d / n >= threshold), default=-1)
    if most <= 0:
        return False
    if most >= n:
        return True
    cuts, spans = [n * i // (most + 1) for i in range(most + 2)], []
    for a, b in zip(cuts, cuts[1:]):
        at = haystack.find(needle[a:b])
        while at >= 0:
            spans.append((at - a - most, at - a + n + most))
            at = haystack.find(needle[a:b], at + 1)
    end, start = -1, 0
    for low, high in sorted(spans):
        if low > end:
            if end >= 0 and within(needle, haystack[max(start, 0) : end], most):
                return True
            start = low
        end = max(end, high)
    return end >= 0 and within(needle, haystack[max(start, 0) : end], most)


def fuzzy_contains(needle: Column, haystack: Column, threshold: float = 0.85) -> Column:
    """Whether folded ``needle`` stands in folded ``haystack`` but for some edits; null sides give null."""

    @F.pandas_udf(BooleanType())
    def hit(needles: pd.Series, haystacks: pd.Series) -> pd.Series:
        return pd.Series([None if n is None or h is None else fuzzy_hit(n, h, threshold) for n, h in zip(needles, haystacks)], dtype=object)

    return hit(needle, haystack)
