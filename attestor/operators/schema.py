"""Record schemas and validation: JSON text to a typed struct, or every issue that keeps it from being one.

A schema is declared in Python and compiled to column expressions; a value's own JSON type decides how it is
coerced, all issues are collected, and list items and nested records report their path.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestor.functions.text import error_category, expected_type, received
from attestor.functions.text import let as _let

ISSUE = "array<struct<field_path:string,category:string,error_type:string,message:string,received:string>>"
_TYPES = {"str": "string", "int": "decimal(38,0)", "float": "double", "bool": "boolean", "date": "date"}
_JSON_TYPES = {"str": {"type": "string"}, "int": {"type": "integer"}, "float": {"type": "number"}, "bool": {"type": "boolean"}, "date": {"type": "string", "format": "date"}, "datetime": {"type": "string", "format": "date-time"}, "decimal": {"anyOf": [{"type": "number"}, {"type": "string"}]}, "any": {}}
_TRUE, _FALSE = ("true", "t", "yes", "y", "on", "1"), ("false", "f", "no", "n", "off", "0")
SEPARATOR = " -> "


@dataclass(frozen=True)
class OneOf:
    """A kind: one of several kinds (see ``trees``)."""

    kinds: tuple


@dataclass(frozen=True)
class ListOf:
    """A kind inside another: a list of some kind (see ``trees``)."""

    kind: object


@dataclass(frozen=True)
class Parts:
    """A kind: a list of so many values, each of its own kind (see ``trees``)."""

    kinds: tuple


def _inside(kind: object) -> tuple:
    """Kinds that a kind is made of."""
    if isinstance(kind, RecordSchema):
        return tuple(f.kind for f in kind.fields)
    return kind.kinds if isinstance(kind, (OneOf, Parts)) else (kind.kind,) if isinstance(kind, ListOf) else ()


@dataclass
class Field:
    """``kind``: str, int, float, bool, date, or a RecordSchema (and those of ``trees``); ``many`` makes a list of it, ``keyed`` a map from strings.

    A value may be looked up under ``aliases`` and, failing these, at JSON ``paths`` such as ``$.data.name``. ``before``
    gets the text of what is there and gives the text to coerce instead (null: as it is); ``synonyms`` does that by a
    table of folded words. ``after`` functions change the coerced value. ``checks`` are pairs of a predicate on the
    value and a message; ``grounded`` is a check against the source (see ``grounding``). An absent field that isn't
    required takes ``default``.
    """

    name: str
    kind: object = "str"
    required: bool = True
    nullable: bool = False
    many: bool = False
    keyed: bool = False
    choices: tuple = ()
    ge: float | None = None
    le: float | None = None
    gt: float | None = None
    lt: float | None = None
    min_length: int | None = None
    max_length: int | None = None
    aliases: tuple = ()
    description: str = ""
    paths: tuple = ()
    default: object = None
    before: Callable[[Column], Column] | None = None
    synonyms: dict = field(default_factory=dict)
    after: tuple[Callable[[Column], Column], ...] = ()
    checks: tuple[tuple[Callable[[Column], Column], str], ...] = ()
    grounded: object = None

    def keys(self) -> tuple:
        return self.aliases or (self.name,)

    def sql(self) -> str:
        one = self.kind.sql() if isinstance(self.kind, RecordSchema) else _TYPES[self.kind]
        return f"array<{one}>" if self.many else f"map<string,{one}>" if self.keyed else one


@dataclass
class RecordSchema:
    """``before`` gives the JSON text of an object for the text of a value that isn't one (null: there is none). ``rules``
    are pairs of a condition on the record that mustn't hold and a message; they are asked when all fields are valid.
    ``computed`` are pairs of a name and a function of the record, never read from input."""

    name: str
    fields: list[Field] = field(default_factory=list)
    before: Callable[[Column], Column] | None = None
    rules: tuple[tuple[Callable[[Column], Column], str], ...] = ()
    computed: tuple[tuple[str, Callable[[Column], Column]], ...] = ()

    def sql(self) -> str:
        return "struct<" + ",".join(f"`{f.name}`:{f.sql()}" for f in self.fields) + ">"

    def known_keys(self) -> list[str]:
        return [k for f in self.fields for k in f.keys()]

    def sole_list_field(self) -> str | None:
        """The only field, if it is a list of records: such a schema takes a bare array."""
        only = self.fields[0] if len(self.fields) == 1 else None
        return only.keys()[0] if only is not None and only.many and isinstance(only.kind, RecordSchema) else None

    def is_recursive(self) -> bool:
        """Whether the record can stand inside itself."""
        seen, todo = set(), list(_inside(self))
        while todo:
            kind = todo.pop()
            if kind is self:
                return True
            if not (isinstance(kind, RecordSchema) and id(kind) in seen):
                seen.add(id(kind))
                todo += _inside(kind)
        return False

    def json_schema(self, strict: bool = False) -> dict:
        """JSON Schema of the record; the strict form requires every field, forbids others, and tells a default in the
        field's description instead. Records that contain themselves are definitions that are referred to."""
        shared: dict[str, dict] = {}
        out = self._object(strict, shared)
        return out | ({"$defs": shared} if shared else {})

    def _object(self, strict: bool, shared: dict[str, dict]) -> dict:
        props = {}
        for f in self.fields:
            one = _kind_schema(f.kind, strict, shared)
            if f.choices:
                one = {"enum": list(f.choices)}
            one |= {k: v for k, v in (("minimum", f.ge), ("maximum", f.le), ("exclusiveMinimum", f.gt), ("exclusiveMaximum", f.lt), ("minLength", f.min_length), ("maxLength", f.max_length)) if v is not None}
            one = {"type": "array", "items": one} if f.many else {"type": "object", "additionalProperties": one} if f.keyed else one
            one = {"anyOf": [one, {"type": "null"}]} if f.nullable else one
            one |= {"default": f.default} if f.default is not None and not strict else {}
            told = " ".join(x for x in (f.description, f"Default: {json.dumps(f.default)}" if strict and f.default is not None else "") if x)
            props[f.keys()[0]] = one | ({"description": told} if told else {})
        out = {"title": self.name, "type": "object", "properties": props, "required": [f.keys()[0] for f in self.fields if f.required or strict]}
        return out | ({"additionalProperties": False} if strict else {})

    def strict_problem(self) -> str | None:
        """Why the schema has no strict form: a record in itself, free values and free keys can't be told; a field that may
        be absent must be nullable or have a default."""
        if self.is_recursive():
            return f"{self.name} contains itself"
        for f in self.fields:
            if f.keyed:
                return f"{f.name}: free keys"
            if not f.required and not f.nullable and f.default is None:
                return f"{f.name}: may be absent but not null"
            todo = [f.kind]
            while todo:
                kind = todo.pop(0)
                if kind == "any":
                    return f"{f.name}: free values"
                if isinstance(kind, RecordSchema):
                    if inner := kind.strict_problem():
                        return f"{f.name}{SEPARATOR}{inner}"
                else:
                    todo += _inside(kind)
        return None

    def tool(self, description: str = "", strict: bool = False) -> dict:
        """Function definition that a model can be given."""
        out = {"name": self.name, "description": description, "parameters": self.json_schema(strict)}
        return {"type": "function", "function": out | ({"strict": True} if strict else {})}

    def listed(self, key: str = "items") -> "RecordSchema":
        """Container for many records in one reply."""
        return RecordSchema(f"{self.name}List", [Field(key, self, many=True)])


def _kind_schema(kind: object, strict: bool, shared: dict[str, dict]) -> dict:
    if isinstance(kind, RecordSchema):
        if not kind.is_recursive():
            return kind._object(strict, shared)
        if kind.name not in shared:
            shared[kind.name] = {}
            shared[kind.name] = kind._object(strict, shared)
        return {"$ref": f"#/$defs/{kind.name}"}
    if isinstance(kind, OneOf):
        return {"anyOf": [_kind_schema(k, strict, shared) for k in kind.kinds]}
    if isinstance(kind, Parts):
        return {"type": "array", "prefixItems": [_kind_schema(k, strict, shared) for k in kind.kinds], "minItems": len(kind.kinds), "maxItems": len(kind.kinds)}
    if isinstance(kind, ListOf):
        return {"type": "array", "items": _kind_schema(kind.kind, strict, shared)}
    return dict(_JSON_TYPES[kind])


def _issue(path: Column, kind: str, message: Column | str, value: Column | None) -> Column:
    shown = F.lit(None).cast("string") if value is None else received(value)
    return F.struct(path.alias("field_path"), error_category(F.lit(kind)).alias("category"), F.lit(kind).alias("error_type"), (F.lit(message) if isinstance(message, str) else message).alias("message"), shown.alias("received"))


def _shown(v: Column, kind: Column) -> Column:
    text = F.try_variant_get(v, "$", "string")
    return F.when(kind == "VOID", F.lit(None)).when(kind == "STRING", text).when(kind == "BOOLEAN", F.initcap(text)).otherwise(F.to_json(v))


def _coerced(v: Column, kind: Column, want: str) -> tuple[Column, Column]:
    """Value of a scalar, and the error type where there is none."""
    text, number = F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "double")
    flag = F.try_variant_get(v, "$", "boolean")
    exact = kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT")
    whole = kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "LONG") | (kind.startswith("DECIMAL") & ~F.to_json(v).contains(".") & ~F.lower(F.to_json(v)).contains("e"))
    if want == "str":
        return F.when(kind == "STRING", text), F.when(kind != "STRING", "string_type")
    if want == "int":
        digits = F.regexp_replace(F.regexp_replace(F.trim(text, F.lit(" \t\r\n")), "(?<=[0-9])_(?=[0-9])", ""), r"\.0+$", "")
        shape = digits.rlike("^[+-]?[0-9]+$")
        value = F.when(whole, F.to_json(v).try_cast("decimal(38,0)")).when(kind == "BOOLEAN", flag.cast("int").cast("decimal(38,0)")).when((kind == "STRING") & shape, digits.try_cast("decimal(38,0)")).when(exact & (number == F.floor(number)), number.try_cast("decimal(38,0)"))
        return value, F.when(value.isNotNull(), F.lit(None)).when(kind == "STRING", "int_parsing").when(exact, "int_from_float").otherwise("int_type")
    if want == "float":
        plain = F.regexp_replace(F.lower(F.trim(text, F.lit(" \t\r\n"))), "(?<=[0-9])_(?=[0-9])", "")
        parsed = F.when(plain.rlike(r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|nan|inf|infinity)$"), F.regexp_replace(F.regexp_replace(plain, "^([+-]?)inf$", "$1infinity"), "^[+-]nan$", "nan").try_cast("double"))
        value = F.when(whole | exact, number).when(kind == "BOOLEAN", flag.cast("int").cast("double")).when(kind == "STRING", parsed)
        return value, F.when(value.isNotNull(), F.lit(None)).when(kind == "STRING", "float_parsing").otherwise("float_type")
    if want == "date":
        day = F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & ~text.startswith("0000"), F.try_to_date(text, "yyyy-MM-dd"))
        return F.when(kind == "STRING", day), F.when((kind == "STRING") & day.isNull(), "date_from_datetime_parsing").when(kind != "STRING", "date_type")
    low = F.lower(text)
    value = F.when(kind == "BOOLEAN", flag).when((kind == "STRING") & low.isin(*_TRUE), True).when((kind == "STRING") & low.isin(*_FALSE), False).when((whole | exact) & (number == 1), True).when((whole | exact) & (number == 0), False)
    return value, F.when(value.isNotNull(), F.lit(None)).when((kind == "STRING") | whole | exact, "bool_parsing").otherwise("bool_type")


#: Messages of coercion errors (fixed values).
MESSAGES = {
    "string_type": "Input should be a valid string",
    "int_type": "Input should be a valid integer",
    "int_parsing": "Input should be a valid integer, unable to parse string as an integer",
    "int_from_float": "Input should be a valid integer, got a number with a fractional part",
    "float_type": "Input should be a valid number",
    "float_parsing": "Input should be a valid number, unable to parse string as a number",
    "bool_type": "Input should be a valid boolean",
    "bool_parsing": "Input should be a valid boolean, unable to interpret input",
    "date_type": "Input should be a valid date",
    "date_from_datetime_parsing": "Input should be a valid date or datetime",
}


def _scalar(v: Column, f: Field, path: Column) -> Column:
    def made(kind: Column) -> Column:
        value, error = _coerced(v, kind, f.kind)
        return F.struct(value.alias("value"), error.alias("error"), _shown(v, kind).alias("shown"), kind.alias("kind"))

    return _let(_let(F.schema_of_variant(v), made), lambda m: _checked(v, f, path, m["kind"], m["value"], m["error"], m["shown"]))


def _checked(v: Column, f: Field, path: Column, kind: Column, value: Column, error: Column, shown: Column) -> Column:
    if f.choices:
        listed = [repr(c) for c in f.choices]
        text = " or ".join([", ".join(listed[:-1]), listed[-1]] if len(listed) > 1 else listed)
        error = F.when(~F.coalesce((kind == "STRING") & F.try_variant_get(v, "$", "string").isin(*f.choices), F.lit(False)), "literal_error")
        found = [F.when(error.isNotNull(), _issue(path, "literal_error", f"Input should be {text}", shown))]
        value = F.when(error.isNull(), value)
    else:
        found = [F.when(error == t, _issue(path, t, m, shown)) for t, m in MESSAGES.items() if t.startswith({"str": "string"}.get(f.kind, f.kind))]
        n = F.length(value) if f.kind == "str" else None
        for limit, bad, t, word in (
            (f.ge, None if f.ge is None else value < f.ge, "greater_than_equal", "greater than or equal to"), (f.gt, None if f.gt is None else value <= f.gt, "greater_than", "greater than"),
            (f.le, None if f.le is None else value > f.le, "less_than_equal", "less than or equal to"), (f.lt, None if f.lt is None else value >= f.lt, "less_than", "less than"),
        ):
            if limit is not None:
                found.append(F.when(bad, _issue(path, t, f"Input should be {word} {limit}", shown)))
        if f.min_length is not None:
            found.append(F.when(n < f.min_length, _issue(path, "string_too_short", f"String should have at least {f.min_length} characters", shown)))
        if f.max_length is not None:
            found.append(F.when(n > f.max_length, _issue(path, "string_too_long", f"String should have at most {f.max_length} characters", shown)))
    for turn in f.after:
        value = turn(value)
    for good, message in f.checks:
        found.append(F.when(value.isNotNull() & ~F.coalesce(good(value), F.lit(False)), _issue(path, "value_error", f"Value error, {message}", shown)))
    return F.struct(value.cast(_TYPES[f.kind]).alias("value"), F.array_compact(F.array(*found)).cast(ISSUE).alias("issues"))


def _one(v: Column, f: Field, path: Column) -> Column:
    return _record(v, f.kind, path) if isinstance(f.kind, RecordSchema) else _scalar(v, f, path)


def _joined(path: Column, part: Column) -> Column:
    return F.when(path == "", part).otherwise(F.concat(path, F.lit(SEPARATOR), part))


def _present(v: Column, f: Field, path: Column) -> Column:
    """A value that is there (JSON null included)."""
    one = f.kind.sql() if isinstance(f.kind, RecordSchema) else _TYPES[f.kind]
    if f.many:
        parts = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x, i: _one(x, f, _joined(path, i.cast("string"))))
        good = _let(parts, lambda a: F.struct(F.transform(a, lambda p: p["value"]).cast(f"array<{one}>").alias("value"), F.flatten(F.transform(a, lambda p: p["issues"])).cast(ISSUE).alias("issues")))
        bad = ("list_type", "Input should be a valid list", "ARRAY")
    elif f.keyed:
        parts = F.transform_values(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, x: _one(x, f, _joined(path, k)))
        good = _let(parts, lambda a: F.struct(F.transform_values(a, lambda k, p: p["value"]).cast(f"map<string,{one}>").alias("value"), F.flatten(F.transform(F.map_values(a), lambda p: p["issues"])).cast(ISSUE).alias("issues")))
        bad = ("dict_type", "Input should be a valid dictionary", "OBJECT")
    else:
        good, bad = _one(v, f, path), None
    if bad:
        kind = F.schema_of_variant(v)
        wrong = F.struct(F.lit(None).cast(f.sql()).alias("value"), F.array(_issue(path, bad[0], bad[1], _shown(v, kind))).cast(ISSUE).alias("issues"))
        good = F.when(kind.startswith(bad[2]), good).otherwise(wrong)
    if f.nullable:
        good = F.when(F.is_variant_null(v), F.struct(F.lit(None).cast(f.sql()).alias("value"), F.array().cast(ISSUE).alias("issues"))).otherwise(good)
    return good


def _raw(v: Column, f: Field) -> Column:
    """What is there for a field, null if nothing is."""
    places = [f"$['{k}']" for k in f.keys()] + list(f.paths)
    at = F.coalesce(*[F.try_variant_get(v, p, "variant") for p in places])
    if f.before is None and not f.synonyms:
        return at

    def cleaned(x: Column) -> Column:
        text = F.try_variant_get(x, "$", "string")
        new = text if f.before is None else F.coalesce(f.before(text), text)
        if f.synonyms:
            words = F.create_map(*[F.lit(w) for pair in f.synonyms.items() for w in pair])
            new = F.coalesce(F.get(F.array(words[F.lower(F.trim(new))]), F.lit(0)), new)
        return F.when(new.eqNullSafe(text), x).otherwise(new.cast("variant"))

    return _let(at, cleaned)


def _record(v: Column, schema: RecordSchema, path: Column) -> Column:
    def read(x: Column, f: Field) -> Column:
        here = _joined(path, F.lit(f.keys()[0]))
        miss = F.array(_issue(here, "missing", "Field required", None)).cast(ISSUE) if f.required else F.array().cast(ISSUE)
        absent = F.struct(F.lit(f.default).cast(f.sql()).alias("value"), miss.alias("issues"))
        return _let(_raw(x, f), lambda raw: F.when(raw.isNotNull(), _present(raw, f, here)).otherwise(absent))

    def gathered(s: Column) -> Column:
        value = F.struct(*[s[f.name]["value"].alias(f.name) for f in schema.fields])
        return F.struct(value.alias("value"), F.flatten(F.array(*[s[f.name]["issues"] for f in schema.fields])).cast(ISSUE).alias("issues"))

    def ruled(r: Column) -> Column:
        broken = [F.when(F.coalesce(rule(r["value"]), F.lit(False)), _issue(path, "value_error", f"Value error, {message}", None)) for rule, message in schema.rules]
        return F.struct(r["value"].alias("value"), F.when(F.size(r["issues"]) > 0, r["issues"]).otherwise(F.array_compact(F.array(*broken)).cast(ISSUE)).alias("issues"))

    def whole(x: Column) -> Column:
        kind = F.schema_of_variant(x)
        wrong = F.struct(F.lit(None).cast(schema.sql()).alias("value"), F.array(_issue(path, "model_type", f"Input should be a valid dictionary or instance of {schema.name}", _shown(x, kind))).cast(ISSUE).alias("issues"))
        good = _let(F.struct(*[read(x, f).alias(f.name) for f in schema.fields]), gathered)
        return F.when(kind.startswith("OBJECT"), _let(good, ruled) if schema.rules else good).otherwise(wrong)

    if schema.before is None:
        return whole(v)
    made = F.when(~F.schema_of_variant(v).startswith("OBJECT"), F.try_parse_json(schema.before(F.try_variant_get(v, "$", "string"))))
    return _let(F.coalesce(made, v), whole)


def validate(doc: Column, schema: RecordSchema) -> Column:
    """struct(record, issues) of a JSON object in text; record is null if there is any issue. Null text is null."""
    done = lambda o: F.struct(F.when(F.size(o["issues"]) == 0, o["value"]).alias("record"), o["issues"].alias("issues"))
    return _let(F.try_parse_json(doc), lambda v: F.when(v.isNotNull(), _let(_record(v, schema, F.lit("")), done)))


def completed(record: Column, schema: RecordSchema) -> Column:
    """The record with its computed fields behind the others, at every depth; null stays null."""

    def part(value: Column, f: Field) -> Column:
        if not isinstance(f.kind, RecordSchema):
            return value
        if f.many:
            return F.transform(value, lambda x: completed(x, f.kind))
        return F.transform_values(value, lambda k, x: completed(x, f.kind)) if f.keyed else completed(value, f.kind)

    def made(r: Column) -> Column:
        return F.struct(*[part(r[f.name], f).alias(f.name) for f in schema.fields], *[make(r).alias(name) for name, make in schema.computed])

    return F.when(record.isNotNull(), _let(record, made))


def input_json(record: Column, schema: RecordSchema) -> Column:
    """A record as the JSON text that would be read into it: fields under their first key, computed ones left out, and
    null fields left out where absence is allowed and null isn't."""

    def scalar(value: Column) -> Column:
        return F.coalesce(F.to_json(value.cast("variant")), F.lit("null"))

    def text(value: Column, f: Field) -> Column:
        one = (lambda x: input_json(x, f.kind)) if isinstance(f.kind, RecordSchema) else (lambda x: scalar(x.cast("string") if f.kind == "date" else x))
        if f.many:
            return F.concat(F.lit("["), F.array_join(F.transform(value, one), ","), F.lit("]"))
        if f.keyed:
            pairs = F.transform(F.map_entries(value), lambda e: F.concat(scalar(e["key"]), F.lit(":"), one(e["value"])))
            return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
        return one(value)

    def member(r: Column, f: Field) -> Column:
        shown = F.concat(F.lit(json.dumps(f.keys()[0]) + ":"), text(r[f.name], f))
        return F.when(r[f.name].isNotNull(), shown).when(F.lit(f.required or f.nullable), F.lit(json.dumps(f.keys()[0]) + ":null"))

    return F.when(record.isNotNull(), _let(record, lambda r: F.concat(F.lit("{"), F.array_join(F.array(*[member(r, f) for f in schema.fields]), ","), F.lit("}"))))


def revalidated(record: Column, schema: RecordSchema) -> Column:
    """``validate`` of a record that was changed after its validation; null stays null."""
    return validate(input_json(record, schema), schema)


def exactly_one(*fields: str) -> tuple[Callable[[Column], Column], str]:
    """A schema rule: one of these fields is there, and only one."""
    return lambda r: sum((r[f].isNotNull().cast("int") for f in fields), F.lit(0)) != 1, f"exactly one of {', '.join(fields)} is needed"


def needed_if(condition: Callable[[Column], Column], needed: str, message: str) -> tuple[Callable[[Column], Column], str]:
    """A schema rule: where the condition holds, a field has to be there."""
    return lambda r: condition(r) & r[needed].isNull(), message


def error_text(issues: Column, schema: RecordSchema) -> Column:
    """Guidance for a corrected reply: issues by kind, what to do about each kind, and what the schema needs."""
    return _let(issues, lambda i: _guidance(i, schema))


#: Groups of issues in the order of the guidance: title, what to do, and which belong there.
_BOUNDS = ("greater_than_equal", "less_than_equal")
_GROUPS = (
    ("MISSING REQUIRED FIELDS:", "Add the missing fields.", lambda i: i["category"] == "missing"),
    ("TYPE ERRORS:", "Give each of these fields a value of its type.", lambda i: i["category"] == "type"),
    ("VALUE ERRORS:", "Change these values so that they meet their conditions.", lambda i: (i["category"] == "value") & ~i["error_type"].isin(*_BOUNDS)),
    ("INVALID CHOICES:", "Choose only from the values listed.", lambda i: i["category"] == "enum"),
    ("OTHER ERRORS:", "Mend the other errors listed.", lambda i: (i["category"] == "other") | i["error_type"].isin(*_BOUNDS)),
)


def _guidance(issues: Column, schema: RecordSchema) -> Column:
    def line(i: Column) -> Column:
        wanted = F.when(i["category"] == "type", F.concat(F.lit(" (expected: "), expected_type(i["error_type"], i["message"]), F.lit(")")))
        shown = F.concat(F.lit(" (received: "), i["received"], F.lit(")"))
        return F.concat(F.lit("- "), i["field_path"], F.lit(": "), i["message"], F.coalesce(wanted, F.lit("")), F.coalesce(shown, F.lit("")))

    groups = [(title, advice, F.transform(F.filter(issues, keep), line)) for title, advice, keep in _GROUPS]
    parts = [F.when(F.size(lines) > 0, F.concat(F.lit(title + "\n"), F.array_join(lines, "\n"))) for title, _, lines in groups]
    advice = F.array_compact(F.array(*[F.when(F.size(lines) > 0, F.lit(a)) for _, a, lines in groups]))
    todo = F.concat(F.lit("TO DO:\n"), F.array_join(F.transform(advice, lambda a, k: F.concat((k + 1).cast("string"), F.lit(". "), a)), "\n"))
    required, optional = [f.name for f in schema.fields if f.required], [f.name for f in schema.fields if not f.required]
    more = ", ".join(optional[:5]) + ("…" if len(optional) > 5 else "")
    foot = f"Schema {schema.name}: required fields: {', '.join(required) or 'none'}" + (f"; optional fields: {more}" if optional else "")
    return F.when(F.size(issues) > 0, F.concat_ws("\n\n", *parts, todo, F.lit(foot)))
