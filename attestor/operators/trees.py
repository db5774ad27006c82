"""Records of any shape as tables of nodes: recursive schemas, tuples, unions, free values.

A schema is compiled to a small table of slots, one for each place that a value can have in it; a record that contains
itself has one. A JSON document is opened level by level into rows (document, place, slot, value), each joined with its
slot, so what is done to a value depends on the slot's columns: neither the plan nor the time to build it grows with the
number of fields, and depth is whatever the documents have. Several levels are opened in one job; what is still closed
then is opened in the next.

A small schema is opened by its places instead: all that lies within a record up to its lists, maps and records that come
again is one row's work, with expressions made for each place, and unions that lie wholly within it are decided there.

A union's alternatives are opened side by side. Of those without issues the one with most fields set is taken, then the one
with the fewest values that had to be coerced, then the first; if all have issues, all issues are told, under the
alternatives' names.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.functions.text import error_category, once, received, truncated
from attestor.operators.grounding import Grounded, number_text, render_candidates, search_forms
from attestor.operators.schema import MESSAGES, SEPARATOR, Field, ListOf, OneOf, Parts, RecordSchema, _coerced
from attestor.sources.state import written

SCALARS = ("str", "int", "float", "bool", "date", "datetime", "decimal")


#: Messages beside those of ``schema`` (fixed values).
_MORE = {
    "datetime_type": "Input should be a valid datetime",
    "datetime_from_date_parsing": "Input should be a valid datetime or date",
    "decimal_type": "Decimal input should be an integer, float, string or Decimal object",
    "decimal_parsing": "Input should be a valid decimal",
    "list_type": "Input should be a valid list",
    "dict_type": "Input should be a valid dictionary",
    "tuple_type": "Input should be a valid tuple",
    "missing": "Field required",
    "json_invalid": "Invalid JSON",
}
_LINK = "struct<slot:int,keys:array<string>,shown:string,name:string,required:boolean,nullable:boolean,preset:string,label:string,hint_key:string>"
_SLOT = (
    f"slot int, shape string, want string, label string, links array<{_LINK}>, ge decimal(38,10), le decimal(38,10), gt decimal(38,10), lt decimal(38,10), bounds map<string,string>, least int, most int, choices array<string>, synonyms map<string,string>,"
    " check struct<mode:string,threshold:double,source:string,rejecting:boolean,locale:string>"
)


@dataclass
class Slots:
    """A compiled schema: rows of the table of slots, the first place, and the functions of single slots."""

    name: str
    rows: list[tuple]
    before: dict
    after: dict
    checks: dict

    def table(self, spark: SparkSession) -> DataFrame:
        table = spark.createDataFrame(self.rows, _SLOT)
        return table.select(*[F.col(c).alias(f"s_{c}") for c in table.columns])


def _label(kind: object) -> str:
    if isinstance(kind, RecordSchema):
        return kind.name
    if isinstance(kind, OneOf):
        return "union"
    if isinstance(kind, Parts):
        return f"tuple[{','.join(_label(k) for k in kind.kinds)}]"
    return f"list[{_label(kind.kind)}]" if isinstance(kind, ListOf) else str(kind)


def compiled(schema: RecordSchema) -> Slots:
    """Slots of a schema, which may contain itself. Rules and computed fields of whole records aren't taken here."""
    out = Slots(schema.name, [], {}, {}, {})
    seen: dict[int, int] = {}

    def add(shape: str, want: str | None = None, label: str = "", f: Field | None = None) -> int:
        limit = lambda x: None if x is None else _decimal(x)
        bounds = {} if f is None else {k: str(x) for k, x in (("ge", f.ge), ("le", f.le), ("gt", f.gt), ("lt", f.lt)) if x is not None}
        g = None if f is None or shape != "scalar" else f.grounded
        check = None if g is None else (g.mode, float(g.threshold), g.source or "default", g.on_mismatch != "flag", g.locale)
        own = (limit(f.ge), limit(f.le), limit(f.gt), limit(f.lt), bounds, f.min_length, f.max_length, list(f.choices) or None, dict(f.synonyms) or None, check) if f is not None else (None,) * 10
        out.rows.append((len(out.rows), shape, want, label, None, *own))
        n = len(out.rows) - 1
        for mine, given in ((out.before, f and f.before), (out.after, f and f.after), (out.checks, f and f.checks)):
            if given and shape == "scalar":
                mine[n] = (want, given)
        return n

    def link(n: int, links: list[tuple]) -> int:
        out.rows[n] = (*out.rows[n][:4], links, *out.rows[n][5:])
        return n

    def inner(slot: int, label: str = "") -> tuple:
        return (slot, None, None, None, True, False, None, label, None)

    def place(kind: object, f: Field | None) -> int:
        if isinstance(kind, RecordSchema):
            return record(kind)
        if isinstance(kind, OneOf):
            return link(add("union", label=_label(kind)), [inner(place(k, f), _label(k)) for k in kind.kinds])
        if isinstance(kind, Parts):
            return link(add("tuple", label=_label(kind)), [inner(place(k, f)) for k in kind.kinds])
        if isinstance(kind, ListOf):
            return link(add("list", label=_label(kind)), [inner(place(kind.kind, f))])
        if kind == "any":
            return add("any", label="any")
        if kind not in SCALARS:
            raise ValueError(f"no kind {kind!r}")
        return add("scalar", kind, str(kind), f)

    def record(r: RecordSchema) -> int:
        if id(r) in seen:
            return seen[id(r)]
        if r.rules or r.computed or r.before is not None or any(f.paths for f in r.fields):
            raise ValueError(f"{r.name}: rules, computed fields, paths and functions of whole records are for validate")
        n = seen[id(r)] = add("record", label=r.name)
        links = []
        for f in r.fields:
            at = place(f.kind, f)
            if f.many or f.keyed:
                at = link(add("list" if f.many else "map", label=f.name), [inner(at)])
            sibling = f.grounded.locale_field if isinstance(f.grounded, Grounded) else None
            key = next((g.keys()[0] for g in r.fields if g.name == sibling), None)
            links.append((at, list(f.keys()), f.keys()[0], f.name, f.required, f.nullable, None if f.default is None else json.dumps(f.default, ensure_ascii=False), "", key))
        return link(n, links)

    record(schema)
    return out


def _decimal(x: float):
    from decimal import Decimal

    return Decimal(str(x))


def _moment(v: Column, kind: Column) -> tuple[Column, Column]:
    """ISO text of a date and time, and the error type: ISO 8601 with or without an offset, a date alone (midnight), or
    seconds since 1970 (milliseconds over 2e10) in UTC."""
    text = F.trim(F.try_variant_get(v, "$", "string"), F.lit(" \t\r\n"))
    shape = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})(?:[Tt _]([01][0-9]|2[0-3]):?([0-5][0-9])(?::?([0-5][0-9])(?:[.,]([0-9]{1,6})[0-9]*)?)?([Zz]|[+-](?:[01][0-9]|2[0-3]):?[0-5][0-9])?)?$"
    part = lambda n: F.regexp_extract(text, shape, n)
    clock = F.when(part(2) == "", "00:00:00").otherwise(F.concat(part(2), F.lit(":"), part(3), F.lit(":"), F.when(part(4) == "", "00").otherwise(part(4))))
    fraction = F.when(part(5) == "", "").otherwise(F.concat(F.lit("."), F.rpad(part(5), 6, "0")))
    zone = F.when(F.upper(part(6)).isin("Z", "+00:00", "+0000"), "Z").when(part(6) == "", "").otherwise(F.concat(F.left(part(6), F.lit(3)), F.lit(":"), F.right(part(6), F.lit(2))))
    day = F.when(~text.startswith("0000"), F.try_to_date(part(1), "yyyy-MM-dd"))
    iso = F.when(text.rlike(shape) & day.isNotNull(), F.concat(part(1), F.lit("T"), clock, F.regexp_replace(fraction, r"\.000000$", ""), zone))
    number = F.when(kind == "STRING", F.when(text.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$"), text.try_cast("double"))).when(kind != "BOOLEAN", F.try_variant_get(v, "$", "double"))
    seconds = F.when(F.abs(number) > 2e10, number / 1000).otherwise(number)
    at = F.when(F.abs(seconds) < 2.5e11, F.timestamp_micros(F.round(seconds * 1000000).cast("long")))
    unix = F.concat(F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.date_format(at, "SSSSSS") == "000000", "").otherwise(F.concat(F.lit("."), F.date_format(at, "SSSSSS"))), F.lit("Z"))
    value = F.coalesce(F.when(kind == "STRING", iso), unix)
    return value, F.when(value.isNotNull(), F.lit(None)).when(kind == "STRING", "datetime_from_date_parsing").otherwise("datetime_type")


def _exact_number(v: Column, kind: Column) -> tuple[Column, Column]:
    """Digits of a decimal, and the error type."""
    number = kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT", "BIGINT", "INT", "SMALLINT", "TINYINT", "LONG")
    text = F.when(kind == "STRING", F.regexp_replace(F.trim(F.try_variant_get(v, "$", "string"), F.lit(" \t\r\n")), "(?<=[0-9])_(?=[0-9])", "")).when(number, F.to_json(v))
    value = F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), F.regexp_replace(text, r"^\+", ""))
    return value, F.when(value.isNotNull(), F.lit(None)).when((kind == "STRING") | number, "decimal_parsing").otherwise("decimal_type")


_TYPED = {"str": "string", "int": "decimal(38,0)", "float": "double", "bool": "boolean", "date": "date", "datetime": "string", "decimal": "string"}
_ROW = (
    "struct<at:array<int>,names:array<string>,prefix:string,slot:int,v:variant,branch:array<struct<at:array<int>,alt:int,nth:int>>,field:boolean,required:boolean,nullable:boolean,preset:string,hint:string,"
    "open:boolean,shape:string,state:string,value:string,error_type:string,message:string,shown:string,exact:boolean,kind:string,check:struct<mode:string,threshold:double,source:string,rejecting:boolean,locale:string>>"
)
_NAMES = [x.split(":")[0] for x in ("at:", "names:", "prefix:", "slot:", "v:", "branch:", "field:", "required:", "nullable:", "preset:", "hint:", "open:", "shape:", "state:", "value:", "error_type:", "message:", "shown:", "exact:", "kind:", "check:")]


def _row(**given: Column) -> Column:
    return F.struct(*[given.get(n, F.lit(None)).alias(n) for n in _NAMES]).cast(_ROW)


def _texts(value: Column, want: Column) -> Column:
    """JSON text of a coerced value that is held as text."""
    return F.when(want.isin("str", "date", "datetime", "decimal"), F.to_json(value.cast("variant"))).otherwise(value)


def _typed(v: Column, kind: Column, want: str) -> Column:
    """A scalar coerced: its value as text, the error type, and whether it was of its type."""
    value, error = _moment(v, kind) if want == "datetime" else _exact_number(v, kind) if want == "decimal" else _coerced(v, kind, want)
    exact = {"str": kind == "STRING", "int": kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "LONG"), "float": kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), "bool": kind == "BOOLEAN"}.get(want, F.lit(False))
    shown = F.to_json(value.cast("variant")) if want == "float" else value.cast("string")
    return F.struct(shown.alias("value"), F.when(kind == "VOID", {"str": "string_type", "datetime": "datetime_type", "decimal": "decimal_type"}.get(want, f"{want}_type")).otherwise(error).alias("error"), exact.alias("exact"))


def _opening(slots: Slots) -> list[Column]:
    """Columns that open a row, in steps that are each worked out once (the last gives the rows it becomes): a row that
    was open stays as one that is done, and its parts are open rows beside it. They are the same at every level."""
    steps: list[dict[str, Column]] = []
    v, want, shape = F.col("v"), F.col("s_want"), F.col("s_shape")
    steps.append({"arr": F.when(F.col("open"), F.try_variant_get(v, "$", "array<variant>")), "obj": F.when(F.col("open"), F.try_variant_get(v, "$", "map<string,variant>"))})
    found = F.when(v.isNull(), None).when(F.is_variant_null(v), "VOID").when(F.col("arr").isNotNull(), "ARRAY").when(F.col("obj").isNotNull(), "OBJECT").otherwise(F.schema_of_variant(v))
    steps.append({"found": F.when(F.col("open"), found)})
    # what a value is cleaned to before it is coerced
    text = F.when((shape == "scalar") & ~F.col("found").isin("ARRAY", "OBJECT", "VOID"), F.try_variant_get(v, "$", "string"))
    new = text
    for n, (_, make) in slots.before.items():
        new = F.when(F.col("slot") == n, F.coalesce(make(text), text)).otherwise(new)
    if any(r[13] for r in slots.rows):
        new = F.coalesce(F.when(F.col("s_synonyms").isNotNull(), F.col("s_synonyms")[F.lower(F.trim(new))]), new)
    if slots.before or any(r[13] for r in slots.rows):
        steps.append({"clean": F.when(new.eqNullSafe(text), v).otherwise(new.cast("variant"))})
        v = F.col("clean")
        steps.append({"kind_now": F.when(F.col("open") & (shape == "scalar") & v.isNotNull() & ~F.col("found").isin("ARRAY", "OBJECT", "VOID"), F.schema_of_variant(v)).otherwise(F.col("found"))})
    kind = F.col("kind_now" if "kind_now" in steps[-1] else "found")
    made = None
    for name in sorted({r[2] for r in slots.rows if r[2]}):
        one = _typed(v, kind, name)
        made = F.when(want == name, one) if made is None else made.when(want == name, one)
    none = F.struct(F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("error"), F.lit(True).alias("exact"))
    here = F.col("open") & v.isNotNull()
    steps.append({"c": F.when(here & (shape == "scalar"), none if made is None else made.otherwise(none))})
    value = F.col("c.value")
    for n, (name, turns) in slots.after.items():
        turned = value.cast(_TYPED[name])
        for turn in turns:
            turned = turn(turned)
        value = F.when(F.col("slot") == n, turned.cast(_TYPED[name]).cast("string")).otherwise(value)
    shown = F.when(kind == "VOID", F.lit(None)).when(kind == "STRING", F.try_variant_get(v, "$", "string")).when(kind == "BOOLEAN", F.initcap(F.try_variant_get(v, "$", "string"))).otherwise(F.to_json(v))
    number = F.when(want.isin("int", "float", "decimal"), F.col("value2").try_cast("decimal(38,10)"))
    steps.append({"value2": F.when(F.col("c.error").isNull(), value), "shown2": F.when(here, shown)})
    told = lambda t, m: F.struct(F.lit(t).alias("t"), (F.lit(m) if isinstance(m, str) else m).alias("m"))
    wrong = F.when(v.isNull() & (F.size("at") == 0), told("json_invalid", _MORE["json_invalid"])).when(v.isNull(), F.when(F.col("required"), told("missing", _MORE["missing"])))
    wrong = wrong.when((kind == "VOID") & F.col("nullable"), None).when((shape == "record") & (kind != "OBJECT"), told("model_type", F.concat(F.lit("Input should be a valid dictionary or instance of "), F.col("s_label"))))
    wrong = wrong.when((shape == "list") & (kind != "ARRAY"), told("list_type", _MORE["list_type"])).when((shape == "map") & (kind != "OBJECT"), told("dict_type", _MORE["dict_type"])).when((shape == "tuple") & (kind != "ARRAY"), told("tuple_type", _MORE["tuple_type"]))
    size = F.size("s_links")
    wrong = wrong.when((shape == "tuple") & (F.size("arr") > size), told("too_long", F.concat(F.lit("Tuple should have at most "), size.cast("string"), F.lit(" items after validation, not "), F.size("arr").cast("string"))))
    quoted = F.transform("s_choices", lambda x: F.concat(F.lit("'"), x, F.lit("'")))
    listed = F.when(F.size(quoted) > 1, F.concat(F.array_join(F.slice(quoted, 1, F.size(quoted) - 1), ", "), F.lit(" or "), F.element_at(quoted, -1))).otherwise(F.get(quoted, F.lit(0)))
    wrong = wrong.when(F.col("s_choices").isNotNull() & (shape == "scalar") & ~F.coalesce((kind == "STRING") & F.array_contains("s_choices", F.col("value2")), F.lit(False)), told("literal_error", F.concat(F.lit("Input should be "), listed)))
    for t, m in (MESSAGES | _MORE).items():
        wrong = wrong.when(F.col("c.error") == t, told(t, m))
    for key, bad, t, word in (("ge", number < F.col("s_ge"), "greater_than_equal", "greater than or equal to"), ("gt", number <= F.col("s_gt"), "greater_than", "greater than"), ("le", number > F.col("s_le"), "less_than_equal", "less than or equal to"), ("lt", number >= F.col("s_lt"), "less_than", "less than")):
        wrong = wrong.when(bad, told(t, F.concat(F.lit(f"Input should be {word} "), F.col("s_bounds")[key])))
    n = F.when(want == "str", F.length("value2"))
    wrong = wrong.when(n < F.col("s_least"), told("string_too_short", F.concat(F.lit("String should have at least "), F.col("s_least").cast("string"), F.lit(" characters"))))
    wrong = wrong.when(n > F.col("s_most"), told("string_too_long", F.concat(F.lit("String should have at most "), F.col("s_most").cast("string"), F.lit(" characters"))))
    for n_slot, (name, checks) in slots.checks.items():
        for good, message in checks:
            typed = F.col("value2").cast(_TYPED[name])
            wrong = wrong.when((F.col("slot") == n_slot) & typed.isNotNull() & ~F.coalesce(good(typed), F.lit(False)), told("value_error", f"Value error, {message}"))
    steps.append({"w": F.when(F.col("open"), wrong)})
    nothing = (kind == "VOID") & F.col("nullable")
    state = F.when(F.col("w").isNotNull(), "bad").when(v.isNull(), F.when(F.col("preset").isNotNull(), "preset").otherwise("absent")).when(nothing | shape.isin("scalar", "any"), "leaf").otherwise(shape)
    leaf = F.when(v.isNull(), F.col("preset")).when(nothing, "null").when(shape == "any", F.to_json(v)).when(shape == "scalar", _texts(F.col("value2"), want))
    steps.append({"st": F.when(F.col("open"), state), "leaf": F.when(F.col("open") & F.col("w").isNull(), leaf)})

    def part(i: Column, name: Column, prefix: Column, link: Column, x: Column, branch: Column | None = None, hint: Column | None = None, field: bool = False) -> Column:
        return _row(
            at=F.concat("at", F.array(i)), names=F.concat("names", F.array(name)), prefix=prefix, slot=link["slot"], v=x, branch=F.col("branch") if branch is None else branch, field=F.lit(field), required=link["required"],
            nullable=link["nullable"], preset=link["preset"], hint=F.col("hint") if hint is None else hint, open=F.lit(True),
        )

    first, links = F.get("s_links", F.lit(0)), F.col("s_links")
    key = lambda k: F.concat(F.to_json(k.cast("variant")), F.lit(":"))
    parts = F.when(F.col("st") == "record", F.transform(links, lambda c, i: part(i, c["shown"], key(c["name"]), c, F.get(F.filter(F.transform(c["keys"], lambda k: F.col("obj")[k]), lambda x: x.isNotNull()), F.lit(0)), hint=F.try_variant_get(F.col("obj")[c["hint_key"]], "$", "string"), field=True)))
    parts = parts.when(F.col("st") == "list", F.transform("arr", lambda x, i: part(i, i.cast("string"), F.lit(""), first, x)))
    parts = parts.when(F.col("st") == "map", F.transform(F.map_entries("obj"), lambda e, i: part(i, e["key"], key(e["key"]), first, e["value"])))
    parts = parts.when(F.col("st") == "tuple", F.transform(links, lambda c, i: part(i, i.cast("string"), F.lit(""), c, F.get(F.col("arr"), i))))
    # an alternative stands at its union's place; its name is among the names until the union is decided
    parts = parts.when(F.col("st") == "union", F.transform(links, lambda c, i: part(i, c["label"], F.col("prefix"), c, v, F.concat("branch", F.array(F.struct(F.col("at").alias("at"), i.alias("alt"), F.size("names").alias("nth")))))))
    own = {n: F.col(n) for n in _NAMES}
    done = own | {
        "v": F.lit(None), "open": F.lit(False), "shape": shape, "state": F.col("st"), "value": F.col("leaf"), "error_type": F.col("w.t"), "message": F.col("w.m"), "shown": F.when(F.col("w").isNotNull() & ~F.col("w.t").isin("missing", "json_invalid"), F.col("shown2")),
        "exact": F.coalesce(F.col("c.exact"), F.lit(True)), "kind": want, "check": F.when((F.col("st") == "leaf") & ~nothing & (shape == "scalar"), F.struct(*[F.col(f"s_check.{x}").alias(x) for x in ("mode", "threshold", "source", "rejecting", "locale")])),
    }
    each = F.when(F.col("open"), F.concat(F.array(_row(**done)), F.coalesce(parts, F.array().cast(f"array<{_ROW}>")))).otherwise(F.array(_row(**own)))
    # these expressions are long: inside a lambda function they are interpreted, where compiling them takes seconds a job
    # and gives methods that are too long for the virtual machine's own compiler
    apart = lambda made: F.inline(F.transform(F.array(F.lit(0)), lambda _: F.struct(*[c.alias(n) for n, c in made.items()])))
    return [apart(step) for step in steps] + [F.inline(F.flatten(F.transform(F.array(F.lit(0)), lambda _: each)))]


def _level(rows: DataFrame, steps: list[Column], table: DataFrame) -> DataFrame:
    """Open all rows that are open."""
    rows = rows.join(F.broadcast(table), F.when(F.col("open"), F.col("slot")) == F.col("s_slot"), "left")
    for step in steps[:-1]:
        rows = rows.select("*", step)
    return rows.select("id_", steps[-1])


_TYPES = {"at": "array<int>", "names": "array<string>", "v": "variant", "branch": "array<struct<at:array<int>,alt:int,nth:int>>", "slot": "int", **dict.fromkeys(("field", "required", "nullable", "open", "exact"), "boolean")}
_CHECK = ("mode", "threshold", "source", "rejecting", "locale")
#: Places up to which a schema is opened by them: plans grow with their number.
_MOST_PLACES = 40


@dataclass
class Place:
    """What lies at one place within a record that is opened as a whole: its slot, the link that leads there (none: the
    first place, whose particulars are those of the row), and the place above and which of its parts this is. ``later``
    places become open rows."""

    slot: int
    link: tuple | None
    above: int | None
    nth: int
    later: bool


def _places(slots: Slots) -> dict[int, list[Place]] | None:
    """Places by first slot, or none if they are too many or need functions that single slots have."""
    if slots.before or slots.after or slots.checks or any(r[13] for r in slots.rows):
        return None
    out: dict[int, list[Place]] = {}
    todo = [0]
    while todo:
        first = todo.pop()
        if first in out:
            continue
        places = out[first] = []

        def grow(slot: int, link: tuple | None, above: int | None, nth: int, seen: frozenset) -> None:
            shape, links = slots.rows[slot][1], slots.rows[slot][4] or []
            places.append(Place(slot, link, above, nth, slot in seen))
            if slot in seen or sum(map(len, out.values())) > _MOST_PLACES:
                todo.append(slot)
                return
            if shape in ("list", "map"):
                todo.append(links[0][0])
            elif shape in ("record", "tuple", "union"):
                me = len(places) - 1
                for i, c in enumerate(links):
                    grow(c[0], c, me, i, seen | {slot} if shape == "record" else seen)

        grow(first, None, None, 0, frozenset())
        if sum(map(len, out.values())) > _MOST_PLACES:
            return None
    keys = [_keys(r[4]) for r in slots.rows if r[1] == "record"]
    return None if any(len({x.lower() for x in k}) < len(k) for k in keys) else out


def _keys(links: list[tuple]) -> list[str]:
    """Keys that a record is asked for."""
    return list(dict.fromkeys([k for c in links for k in c[1]] + [c[8] for c in links if c[8]]))


class _Opened:
    """Columns of the places of one first slot, by steps (``columns`` of each are worked out once)."""

    def __init__(self, slots: Slots, first: int, places: list[Place]) -> None:
        self.rows, self.first, self.places = slots.rows, first, places
        self.below = [[j for j, p in enumerate(places) if p.above == k] for k in range(len(places))]
        self.unions = [k for k in range(len(places)) if self.shape(k) == "union" and not places[k].later and not any(places[j].later or self.shape(j) in ("list", "map") for j in self.under(k))]

    def shape(self, k: int) -> str:
        return self.rows[self.places[k].slot][1]

    def under(self, k: int) -> list[int]:
        return [x for j in self.below[k] for x in [j, *self.under(j)]]

    def chain(self, k: int) -> list[int]:
        """Places from the first one to ``k``."""
        above = self.places[k].above
        return [k] if above is None else [*self.chain(above), k]

    def depth(self, k: int) -> int:
        return sum(self.shape(j) in ("record", "tuple") for j in self.chain(k)[:-1])

    def name(self, what: str, k: int) -> str:
        return f"{what}_{self.first}_{k}"

    def col(self, what: str, k: int) -> Column:
        return F.col(self.name(what, k))

    def own(self, n: int, name: str, k: int) -> Column:
        """A particular of a place: its link's, or the row's at the first one."""
        link = self.places[k].link
        return F.col(name) if link is None else F.lit(link[n])

    def value(self, k: int) -> Column:
        p = self.places[k]
        if p.above is None:
            return F.when(F.col("open") & (F.col("slot") == self.first), F.col("v"))
        over = self.shape(p.above)
        if over == "union":
            return self.value(p.above)
        if over == "tuple":
            return F.get(self.col("arr", p.above), F.lit(p.nth))
        return F.coalesce(*[self.col("obj", p.above)[key] for key in p.link[1]])

    def inner(self, depth: int) -> dict[str, Column]:
        """Parts of what lies at a depth."""
        out = {}
        for k in range(len(self.places)):
            if self.depth(k) == depth and not self.places[k].later:
                if self.shape(k) == "record":
                    kind = ",".join(f"`{x.replace('`', '``')}`:variant" for x in _keys(self.rows[self.places[k].slot][4]))
                    out[self.name("obj", k)] = F.try_variant_get(self.value(k), "$", f"struct<{kind}>")
                elif self.shape(k) == "map":
                    out[self.name("obj", k)] = F.try_variant_get(self.value(k), "$", "map<string,variant>")
                elif self.shape(k) in ("list", "tuple"):
                    out[self.name("arr", k)] = F.try_variant_get(self.value(k), "$", "array<variant>")
        return out

    def now(self) -> list[int]:
        return [k for k in range(len(self.places)) if not self.places[k].later]

    def kinds(self) -> dict[str, Column]:
        out = {}
        for k in self.now():
            v, shape = self.value(k), self.shape(k)
            kind = F.when(v.isNull(), None).when(F.is_variant_null(v), "VOID")
            if shape in ("union", "any"):
                kind = kind.otherwise("ANY")
            elif shape == "scalar":
                kind = kind.otherwise(F.substring_index(F.schema_of_variant(v), "<", 1))
            else:
                parts, found = ("obj", "OBJECT") if shape in ("record", "map") else ("arr", "ARRAY")
                kind = kind.when(self.col(parts, k).isNotNull(), found).otherwise(F.substring_index(F.schema_of_variant(v), "<", 1))
            out[self.name("kind", k)] = kind
        return out

    def coerced(self) -> dict[str, Column]:
        out = {}
        for k in self.now():
            if self.shape(k) == "scalar":
                v, kind = self.value(k), self.col("kind", k)
                out[self.name("c", k)] = F.when(v.isNotNull(), _typed(v, kind, self.rows[self.places[k].slot][2]))
        return out

    def wrong(self) -> dict[str, Column]:
        out = {}
        for k in self.now():
            v, kind, shape, slot = self.value(k), self.col("kind", k), self.shape(k), self.rows[self.places[k].slot]
            told = lambda t, m: F.struct(F.lit(t).alias("t"), (F.lit(m) if isinstance(m, str) else m).alias("m"))
            missing = F.when(self.own(4, "required", k), told("missing", _MORE["missing"]))
            if self.places[k].above is None:
                missing = F.when(F.size("at") == 0, told("json_invalid", _MORE["json_invalid"])).otherwise(missing)
            w = F.when(v.isNull(), missing).when((kind == "VOID") & self.own(5, "nullable", k), None)
            if shape == "record":
                w = w.when(kind != "OBJECT", told("model_type", f"Input should be a valid dictionary or instance of {slot[3]}"))
            elif shape in ("list", "map", "tuple"):
                t = {"list": "list_type", "map": "dict_type", "tuple": "tuple_type"}[shape]
                w = w.when(kind != ("OBJECT" if shape == "map" else "ARRAY"), told(t, _MORE[t]))
                if shape == "tuple":
                    w = w.when(F.size(self.col("arr", k)) > len(slot[4]), told("too_long", F.concat(F.lit(f"Tuple should have at most {len(slot[4])} items after validation, not "), F.size(self.col("arr", k)).cast("string"))))
            elif shape == "scalar":
                want, c = slot[2], self.col("c", k)
                value = F.when(c["error"].isNull(), c["value"])
                if slot[12] is not None:
                    listed = [f"'{x}'" for x in slot[12]]
                    listed = f"{', '.join(listed[:-1])} or {listed[-1]}" if len(listed) > 1 else listed[0]
                    w = w.when(~F.coalesce((kind == "STRING") & value.isin(*slot[12]), F.lit(False)), told("literal_error", f"Input should be {listed}"))
                messages = F.create_map(*[F.lit(x) for pair in (MESSAGES | _MORE).items() for x in pair])
                w = w.when(c["error"].isNotNull(), told(c["error"], F.element_at(messages, c["error"])))
                if want in ("int", "float", "decimal"):
                    number = value.try_cast("decimal(38,10)")
                    for limit, key, test, t, word in ((slot[5], "ge", "__lt__", "greater_than_equal", "greater than or equal to"), (slot[7], "gt", "__le__", "greater_than", "greater than"), (slot[6], "le", "__gt__", "less_than_equal", "less than or equal to"), (slot[8], "lt", "__ge__", "less_than", "less than")):
                        if limit is not None:
                            w = w.when(getattr(number, test)(F.lit(limit).cast("decimal(38,10)")), told(t, f"Input should be {word} {slot[9][key]}"))
                if want == "str" and slot[10] is not None:
                    w = w.when(F.length(value) < slot[10], told("string_too_short", f"String should have at least {slot[10]} characters"))
                if want == "str" and slot[11] is not None:
                    w = w.when(F.length(value) > slot[11], told("string_too_long", f"String should have at most {slot[11]} characters"))
            out[self.name("w", k)] = w
        return out

    def states(self) -> dict[str, Column]:
        out = {}
        for k in self.now():
            v, kind, shape, w = self.value(k), self.col("kind", k), self.shape(k), self.col("w", k)
            preset, nothing = self.own(6, "preset", k).cast("string"), (kind == "VOID") & self.own(5, "nullable", k)
            other = F.lit("leaf") if shape in ("scalar", "any") else F.when(nothing, "leaf").otherwise(shape)
            out[self.name("st", k)] = F.when(w.isNotNull(), "bad").when(v.isNull(), F.when(preset.isNotNull(), "preset").otherwise("absent")).otherwise(other)
            leaf = F.when(v.isNull(), preset).when(nothing, "null")
            if shape == "any":
                leaf = leaf.otherwise(F.to_json(v))
            elif shape == "scalar":
                leaf = leaf.otherwise(_texts(self.col("c", k)["value"], F.lit(self.rows[self.places[k].slot][2])))
            out[self.name("leaf", k)] = F.when(w.isNull(), leaf)
            shown = F.when(kind == "VOID", None).when(kind == "STRING", F.try_variant_get(v, "$", "string")).when(kind == "BOOLEAN", F.initcap(F.try_variant_get(v, "$", "string"))).otherwise(F.to_json(v))
            out[self.name("shown", k)] = F.when(w.isNotNull() & ~w["t"].isin("missing", "json_invalid"), shown)
        return out

    def lives(self) -> dict[str, Column]:
        """Whether there is a row for a place, before unions are decided."""
        out = {}
        for k in range(len(self.places)):
            live = F.col("open") & (F.col("slot") == self.first)
            for j in self.chain(k)[:-1]:
                live = live & (self.col("st", j) == self.shape(j))
            out[self.name("live", k)] = live
        return out

    def stays(self, k: int, within: int | None = None) -> Column:
        """Whether a place's row is left by the unions above it (those within ``within``)."""
        out, chain = self.col("live", k), self.chain(k)
        for u, part in zip(chain, chain[1:]):
            if u in self.unions and (within is None or within in self.chain(u)[:-1]):
                out = out & (self.col("won", u).isNull() | (self.col("won", u) == self.places[part].nth))
        return out

    def winners(self, depth: int) -> dict[str, Column]:
        """Alternatives that are taken, of unions with so many unions around them."""
        out = {}
        for u in self.unions:
            if sum(x in self.unions for x in self.chain(u)) - 1 == depth:
                each = []
                for a in self.below[u]:
                    count = lambda test: sum((F.when(self.stays(j, u) & t, 1).otherwise(0) for j in [a, *self.under(a)] for t in [test(j)] if t is not None), F.lit(0))  # noqa: E731, B023
                    bad = count(lambda j: self.col("w", j).isNotNull())
                    taken = count(lambda j: ~self.col("st", j).isin("absent", "preset") if self.shape(self.places[j].above) == "record" else None)
                    inexact = count(lambda j: ~F.coalesce(self.col("c", j)["exact"], F.lit(True)) if self.shape(j) == "scalar" else None)
                    each.append(F.when(self.col("live", a) & (bad == 0), F.struct((-taken).alias("set"), inexact.alias("inexact"), F.lit(self.places[a].nth).alias("alt"))))
                out[self.name("won", u)] = F.array_min(F.array(*each))["alt"]
        return out

    def at(self, k: int, *more: Column) -> Column:
        return F.concat("at", F.array(*[F.lit(self.places[j].nth) for j in self.chain(k)[1:]], *more).cast("array<int>"))

    def names(self, k: int, *more: Column) -> Column:
        parts, chain = [F.col("names")], self.chain(k)
        for over, j in zip(chain, chain[1:]):
            p, shape = self.places[j], self.shape(over)
            one = F.array(F.lit(p.link[7] if shape == "union" else p.link[2] if shape == "record" else str(p.nth)))
            parts.append(F.when(self.col("won", over).isNull(), one).otherwise(F.array().cast("array<string>")) if over in self.unions else one)
        return F.concat(*parts, *[F.array(x) for x in more])

    def particulars(self, k: int) -> dict[str, Column]:
        """Prefix, hint and undecided unions of a place."""
        chain, p = self.chain(k), self.places[k]
        prefix, hint, branch = F.col("prefix"), F.col("hint"), F.col("branch")
        for nth, (over, j) in enumerate(zip(chain, chain[1:])):
            shape, link = self.shape(over), self.places[j].link
            if shape == "record":
                prefix, hint = F.concat(F.to_json(F.lit(link[3]).cast("variant")), F.lit(":")), F.try_variant_get(self.col("obj", over)[link[8]], "$", "string") if link[8] else F.lit(None)
            elif shape == "tuple":
                prefix = F.lit("")
            elif over not in self.unions:
                branch = F.concat(branch, F.array(F.struct(self.at(over).alias("at"), F.lit(self.places[j].nth).alias("alt"), (F.size("names") + nth).alias("nth"))))
        field = F.col("field") if p.above is None else F.lit(self.shape(p.above) == "record")
        return {"prefix": prefix, "hint": hint, "branch": branch, "field": field, "required": self.own(4, "required", k), "nullable": self.own(5, "nullable", k), "preset": self.own(6, "preset", k), "slot": F.lit(p.slot)}

    def items(self, k: int, given: dict[str, Column]) -> Column:
        """Open rows of what a list or a map holds."""
        slot = self.rows[self.places[k].slot][4][0][0]
        same = given | {"slot": F.lit(slot), "field": F.lit(False), "required": F.lit(True), "nullable": F.lit(False), "preset": F.lit(None), "open": F.lit(True)}
        item = lambda i, name, prefix, x: _plain(**(same | {"at": self.at(k, i), "names": self.names(k, name), "prefix": prefix, "v": x}))
        if self.shape(k) == "list":
            return F.transform(self.col("arr", k), lambda x, i: item(i, i.cast("string"), F.lit(""), x))
        return F.transform(F.map_entries(self.col("obj", k)), lambda e, i: item(i, e["key"], F.concat(F.to_json(e["key"].cast("variant")), F.lit(":")), e["value"]))

    def made(self) -> list[Column]:
        """Arrays of rows that a row becomes; what isn't there is null in them."""
        single, lists = [], []
        for k, p in enumerate(self.places):
            given = self.particulars(k) | {"at": self.at(k), "names": self.names(k)}
            if p.later:
                single.append(F.when(self.stays(k), _plain(**given, v=self.value(k), open=F.lit(True))))
                continue
            shape, slot, st, w = self.shape(k), self.rows[p.slot], self.col("st", k), self.col("w", k)
            check = None if slot[14] is None else F.when((st == "leaf") & ~((self.col("kind", k) == "VOID") & given["nullable"]), F.struct(*[F.lit(x).alias(n) for n, x in zip(_CHECK, slot[14])]))
            more = {"open": F.lit(False), "shape": F.lit(shape), "state": st, "value": self.col("leaf", k), "error_type": w["t"], "message": w["m"], "shown": self.col("shown", k), "kind": F.lit(slot[2])}
            more["exact"] = F.coalesce(self.col("c", k)["exact"], F.lit(True)) if shape == "scalar" else F.lit(True)
            single.append(F.when(self.stays(k), _plain(**given, **more, **({} if check is None else {"check": check}))))
            if shape in ("list", "map"):
                lists.append(F.when(self.stays(k) & (st == shape), self.items(k, given)))
        return [F.array(*single), *lists]


def _plain(**given: Column) -> Column:
    """A row whose columns have their types."""
    kinds = {n: f"struct<{','.join(f'{x}:{y}' for x, y in zip(_CHECK, ('string', 'double', 'string', 'boolean', 'string')))}>" if n == "check" else _TYPES.get(n, "string") for n in _NAMES}
    return F.struct(*[given.get(n, F.lit(None)).cast(kinds[n]).alias(n) for n in _NAMES])


def _whole_level(rows: DataFrame, opened: list[_Opened]) -> DataFrame:
    """Open all rows that are open, each with all the places that lie within it."""
    steps = []
    for depth in range(1 + max(o.depth(k) for o in opened for k in range(len(o.places)))):
        steps.append([o.inner(depth) for o in opened])
    steps += [[getattr(o, what)() for o in opened] for what in ("kinds", "coerced", "wrong", "states", "lives")]
    around = [sum(x in o.unions for x in o.chain(u)) - 1 for o in opened for u in o.unions]
    for depth in range(max(around, default=-1), -1, -1):
        steps.append([o.winners(depth) for o in opened])
    own = F.array(_plain(**{n: F.col(n) for n in _NAMES}))
    on = F.col("open")
    for step in steps:
        made = {n: c for one in step for n, c in one.items()}
        # a function of this kind keeps a step out of the stage's code, of which it would make one method too long for
        # the virtual machine's own compiler; by itself it is cut into short ones, and what occurs twice is worked out once
        rows = rows.withColumns({"on_": F.exists(F.array(on), lambda x: x), **made})
        on = F.col("on_")
    each = [a for o in opened for a in o.made()]
    none = F.array().cast(f"array<{_ROW}>")
    rows = rows.select("id_", F.when(on, F.concat(*[F.coalesce(a, none) for a in each])).otherwise(own).alias("all_"))
    return rows.select("id_", F.inline(F.filter("all_", lambda x: x.isNotNull())))



def nodes(docs: DataFrame, id_col: str, json_col: str, schema: RecordSchema | Slots, levels: int = 4) -> DataFrame:
    """A row for each value of each document that the schema has a place for (and for each that is missing): ``id_col``,
    ``at`` (its place in the order of the document), ``path``, ``parent`` (path), ``shape``, ``kind``, ``state`` (record,
    list, map, tuple, leaf, preset, absent or bad), ``value`` (JSON text of a leaf), error_type, message, shown, and what
    assembly and grounding use.

    Text that is not JSON is one bad row; null text gives no rows, as does an empty table. Ids should be unique: rows of
    one id are read as one document's. Extra columns play no part. ``levels`` are opened in a job; what lies deeper is
    opened in further ones, so any depth that Spark can parse is read.
    """
    slots = schema if isinstance(schema, Slots) else compiled(schema)
    spark = docs.sparkSession
    places = _places(slots)
    opened = None if places is None else [_Opened(slots, first, one) for first, one in places.items()]
    if opened is None:
        table, steps = slots.table(spark), _opening(slots)
        undecided = any(r[1] == "union" for r in slots.rows)
    else:
        # a job opens fewer levels of a schema of many places, since its plan grows with both
        levels = max(1, min(levels, 24 // sum(map(len, places.values()))))
        undecided = any(o.shape(k) == "union" and k not in o.unions for o in opened for k in o.now())
    rows = docs.select(F.col(id_col).alias("id_"), F.col(json_col).cast("string").alias("t_")).where("t_ is not null")
    # documents are small for the work they take: as many as lie in one file's split would be opened by one task
    rows = rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "id_")
    empty = F.array()
    start = _row(at=empty, names=empty, prefix=F.lit(""), slot=F.lit(0), v=F.try_parse_json("t_"), branch=empty, field=F.lit(False), required=F.lit(True), nullable=F.lit(False), open=F.lit(True))
    rows, done = rows.select("id_", F.inline(F.array(start))), None
    while True:
        for _ in range(levels):
            rows = _level(rows, steps, table) if opened is None else _whole_level(rows, opened)
        rows = written(rows, "tree-nodes")
        more = rows.where("not open")
        done = more if done is None else done.unionByName(more)
        rows = rows.where("open")
        if rows.isEmpty():
            break
    out = _decided(done) if undecided else done
    path = F.array_join("names", SEPARATOR)
    return out.select(F.col("id_").alias(id_col), "at", path.alias("path"), F.array_join(F.slice("names", 1, F.greatest(F.size("names") - 1, F.lit(0))), SEPARATOR).alias("parent"), "shape", "kind", "state", "value", "error_type", "message", "shown", "prefix", "hint", "check")


def _decided(rows: DataFrame) -> DataFrame:
    """Rows without the alternatives that weren't taken; unions inside unions are decided first."""
    deepest = rows.agg(F.max(F.size("branch"))).first()[0] or 0
    for k in range(deepest, 0, -1):
        inside = F.size("branch") >= k
        here = F.get("branch", F.lit(k - 1))
        rows = written(rows.withColumn("union_", F.when(inside, here["at"])).withColumn("alt_", F.when(inside, here["alt"])), "tree-unions") if k < deepest else rows.withColumn("union_", F.when(inside, here["at"])).withColumn("alt_", F.when(inside, here["alt"]))
        each = rows.where(inside).groupBy("id_", "union_", "alt_").agg(F.count("error_type").alias("bad"), F.count_if(F.col("field") & ~F.col("state").isin("absent", "preset")).alias("set"), F.count_if(~F.col("exact")).alias("inexact"))
        best = each.where("bad = 0").groupBy("id_", "union_").agg(F.min(F.struct((-F.col("set")).alias("set"), "inexact", "alt_")).alias("b")).select("id_", "union_", F.col("b.alt_").alias("won_"))
        rows = rows.join(best, ["id_", "union_"], "left").where(F.col("alt_").isNull() | F.col("won_").isNull() | (F.col("won_") == F.col("alt_")))
        nth = F.get("branch", F.lit(k - 1))["nth"]
        shorter = F.concat(F.slice("names", 1, nth), F.slice("names", nth + 2, F.size("names")))
        rows = rows.withColumn("names", F.when(F.col("won_").isNotNull(), shorter).otherwise(F.col("names"))).drop("union_", "alt_", "won_")
    return rows


def issues_of(rows: DataFrame, id_col: str) -> DataFrame:
    """Issues of documents in order: ``id_col``, field_path, category, error_type, message, received."""
    bad = rows.where("error_type is not null")
    return bad.select(id_col, "at", F.col("path").alias("field_path"), error_category(F.col("error_type")).alias("category"), "error_type", "message", received(F.col("shown")).alias("received"))


def records(rows: DataFrame, id_col: str) -> DataFrame:
    """One row for each document of ``nodes``: ``id_col``, record (JSON text with coerced values, null if there is an
    issue) and issues. A document is put together from its nodes' pieces of text in the order of the document."""
    bad = F.struct(F.col("path").alias("field_path"), error_category(F.col("error_type")).alias("category"), F.col("error_type").alias("error_type"), F.col("message").alias("message"), received(F.col("shown")).alias("received"))
    token = lambda at, side, text: F.struct(at.alias("at"), F.lit(side).alias("side"), text.alias("text"))
    listed = F.col("state").isin("list", "tuple")
    group = F.array(token(F.col("at"), 0, F.concat("prefix", F.when(listed, "[").otherwise("{"))), token(F.concat("at", F.array(F.lit(2**31 - 1))), 2, F.when(listed, "]").otherwise("}")))
    tokens = F.when(F.col("state").isin("leaf", "preset"), F.array(token(F.col("at"), 1, F.concat("prefix", "value")))).when(F.col("state").isin("record", "map", "list", "tuple"), group)
    all_ = rows.groupBy(id_col).agg(
        F.array_sort(F.collect_list(F.when(F.col("error_type").isNotNull(), F.struct("at", bad.alias("issue"))))).alias("bad_"),
        F.array_sort(F.flatten(F.collect_list(tokens))).alias("tokens_"),
    )
    all_ = once(all_, issues=F.transform("bad_", lambda x: x["issue"]), tokens2_=F.col("tokens_"))
    comma = lambda i, t: F.when((i > 0) & (t["side"] != 2) & (F.get(F.col("tokens2_"), i - 1)["side"] != 0), ",").otherwise("")
    text = F.array_join(F.transform("tokens2_", lambda t, i: F.concat(comma(i, t), t["text"])), "")
    return all_.select(id_col, F.when(F.size("issues") == 0, text).alias("record"), "issues")


def grounding_of(rows: DataFrame, id_col: str, sources: DataFrame) -> DataFrame:
    """Findings of grounded leaves that don't occur in their source, in any depth: ``id_col``, field_path, message,
    received, rejecting.

    ``sources``: ``id_col``, name (default, or as the schema's checks name it) and text. A leaf whose source has no row or
    no text passes. The forms of all leaves are searched for together, and each text is read once.
    """
    leaves = rows.where("check.mode is not null").withColumn("plain", F.when(F.col("kind").isin("str", "date", "datetime", "decimal"), F.get_json_object(F.concat(F.lit('{"v":'), F.col("value"), F.lit("}")), "$.v")).otherwise(F.col("value")))
    hint, forms = F.coalesce(F.nullif("hint", F.lit("")), "check.locale"), None
    for kind, typed in (("str", "string"), ("int", "decimal(38,0)"), ("float", "double"), ("bool", "boolean"), ("date", "date")):
        made = render_candidates(F.col("plain").try_cast(typed), kind, hint)
        forms = F.when(F.col("kind") == kind, made) if forms is None else forms.when(F.col("kind") == kind, made)
    shown = F.when(F.col("kind") == "bool", F.initcap("plain")).when(F.col("kind") == "float", number_text(F.col("plain").try_cast("double"))).otherwise(F.col("plain"))
    leaves = once(leaves, shown_=shown, forms_=F.when(F.col("check.mode") == "normalized", forms.otherwise(F.array("plain"))).otherwise(F.array("plain")))
    at = F.struct("at", F.col("path").alias("field_path"), F.col("shown_").alias("shown"), F.col("forms_").alias("forms"), F.col("check.mode").alias("mode"), F.col("check.threshold").alias("threshold"), F.col("check.source").alias("source"), F.col("check.rejecting").alias("rejecting"))
    texts = sources.where("text is not null").groupBy(id_col).agg(F.collect_list(F.struct("name", "text")).alias("texts_"))
    each = leaves.groupBy(id_col).agg(F.collect_list(at).alias("c_")).join(texts, id_col)
    each = once(each, checks_=F.filter("c_", lambda c: F.exists(F.col("texts_"), lambda t: t["name"] == c["source"])))
    each = search_forms(each, "checks_", "texts_", "found_")
    lost = each.select(id_col, F.explode(F.arrays_zip("checks_", "found_")).alias("z")).where(~F.col("z.found_")).select(id_col, "z.checks_.*")
    message = F.concat(F.lit("'"), truncated(F.col("shown")), F.lit("' is not in the source text"), F.when(F.col("source") != "default", F.concat(F.lit(" "), F.col("source"))).otherwise(""))
    return lost.select(id_col, "at", "field_path", message.alias("message"), truncated(F.col("shown")).alias("received"), "rejecting")
