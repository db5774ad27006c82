"""Source grounding: does an extracted value occur in its source, in any of the surface forms it may take?

A check is attached to a field of a schema; ``grounded`` walks a validated record and runs them all.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType

from attestor.functions.text import contains_any, fold, folded_form, fuzzy_contains, fuzzy_hit, is_ascii, let, normalized, normalized_ascii, occurring, once, truncated
from attestor.operators.rules import ISSUE
from attestor.operators.schema import SEPARATOR, Field, RecordSchema

#: Number separators (decimal, grouping) by language or country, then those always tried.
SEPARATORS = {"de": (",", "."), "en": (".", ","), "us": (".", ","), "gb": (".", ","), "fr": (",", " "), "es": (",", "."), "it": (",", "."), "ch": (".", "'")}
FALLBACK_SEPARATORS = ((".", ","), (",", "."), (",", " "), (".", "'"))
LANGUAGES = ("en", "de", "fr")
#: Cardinals from 0 to 20.
NUMBER_WORDS = {
    "en": ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty"),
    "de": ("null", "eins", "zwei", "drei", "vier", "fünf", "sechs", "sieben", "acht", "neun", "zehn", "elf", "zwölf", "dreizehn", "vierzehn", "fünfzehn", "sechzehn", "siebzehn", "achtzehn", "neunzehn", "zwanzig"),
    "fr": ("zéro", "un", "deux", "trois", "quatre", "cinq", "six", "sept", "huit", "neuf", "dix", "onze", "douze", "treize", "quatorze", "quinze", "seize", "dix-sept", "dix-huit", "dix-neuf", "vingt"),
}
#: Names of months.
MONTHS = {
    "en": ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"),
    "de": ("Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember"),
    "fr": ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"),
}
#: Short names of months.
SHORT_MONTHS = {
    "en": ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"),
    "de": ("Jan", "Feb", "Mär", "Apr", "Mai", "Jun", "Jul", "Aug", "Sep", "Okt", "Nov", "Dez"),
    "fr": ("janv", "févr", "mars", "avr", "mai", "juin", "juil", "août", "sept", "oct", "nov", "déc"),
}
#: How a source may say yes or no, and tick a box.
BOOLEAN_WORDS = {True: ("yes", "ja", "oui"), False: ("no", "nein", "non")}
TICKS = ("✓", "✔", "☑", "x", "X")


def _first(hint: str | None, known) -> list[str]:
    key = (hint or "").strip().lower()[:2]
    return [key, *(k for k in known if k != key)] if key in known else list(known)


def separators(hint: str | None) -> list[tuple[str, str]]:
    key = (hint or "").strip().lower()[:2]
    return list(dict.fromkeys([*([SEPARATORS[key]] if key in SEPARATORS else []), *FALLBACK_SEPARATORS]))


def _literals(words: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(x) for x in words])


def number_forms(value: Column, shown: Column, hint: str | None = None) -> Column:
    """Surface forms of a DECIMAL: plain text ``shown``; then for each separator pair, with the digits of ``shown``, two
    and no fraction digits (halves to even), without and with grouping, signs as -x, (x) and x-; small whole numbers as
    words."""
    size = F.abs(value)
    fixed = F.array_distinct(F.array(F.regexp_replace(shown, "^-", ""), *[F.bround(size, n).cast(f"decimal(38,{n})").cast("string") for n in (2, 0)]))
    pairs = F.array(*[F.struct(F.lit(p).alias("point"), F.lit(g).alias("group")) for p, g in separators(hint)])

    # digits are grouped once, with a mark that each pair of separators then replaces
    halves = F.transform(fixed, lambda n: F.struct(F.substring_index(n, ".", 1).alias("whole"), F.when(n.contains("."), F.substring_index(n, ".", -1)).alias("part")))
    marked = F.transform(halves, lambda h: F.struct(h["whole"].alias("whole"), h["part"].alias("part"), F.regexp_replace(h["whole"], r"(?<=\d)(?=(\d{3})+$)", "_").alias("grouped")))

    def written(pair: Column, h: Column) -> Column:
        part = F.coalesce(F.concat(pair["point"], h["part"]), F.lit(""))
        return F.array(F.concat(h["whole"], part), F.concat(F.replace(h["grouped"], F.lit("_"), pair["group"]), part))

    bodies = let(marked, lambda each: F.flatten(F.transform(pairs, lambda p: F.flatten(F.transform(each, lambda h: written(p, h))))))
    signed = F.flatten(F.transform(bodies, lambda x: F.array(F.concat(F.lit("-"), x), F.concat(F.lit("("), x, F.lit(")")), F.concat(x, F.lit("-")))))
    words = F.array(*[F.get(_literals(NUMBER_WORDS[lang]), value.cast("int")) for lang in _first(hint, LANGUAGES)])
    small = F.when((value == F.floor(value)) & (value >= 0) & (value <= 20), words).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(shown), F.when(value < 0, signed).otherwise(bodies), small))


def boolean_forms(value: Column) -> Column:
    make = lambda v: F.array(*[F.lit(x) for x in (str(v), *BOOLEAN_WORDS[v], *(TICKS if v else ()))])
    return F.when(value, make(True)).otherwise(make(False))


def date_forms(value: Column, hint: str | None = None) -> Column:
    """Eight numeric shapes, and five with the month's name in each language."""
    return let(value, lambda day: _date_forms(day, hint))


def _date_forms(value: Column, hint: str | None) -> Column:
    d, m, y = F.dayofmonth(value).cast("string"), F.month(value), F.year(value).cast("string")
    dd, mm, ms = F.lpad(d, 2, "0"), F.lpad(m.cast("string"), 2, "0"), m.cast("string")
    j = lambda sep, *p: F.concat_ws(sep, *p)
    forms = [j("-", y, mm, dd), j(".", dd, mm, y), j(".", d, ms, y), j("/", dd, mm, y), j("/", d, ms, y), j("/", mm, dd, y), j("/", ms, d, y), j("-", dd, mm, y)]
    for lang in _first(hint, LANGUAGES):
        full, short = (F.get(_literals(t[lang]), m - 1) for t in (MONTHS, SHORT_MONTHS))
        forms += [F.concat(d, F.lit(". "), full, F.lit(" "), y), j(" ", d, full, y), F.concat(full, F.lit(" "), d, F.lit(", "), y), F.concat(d, F.lit(". "), short, F.lit(" "), y), j(" ", d, short, y)]
    return F.array_distinct(F.array(*forms))


def string_forms(value: Column, hint: str | None = None) -> Column:
    """A string itself; an ISO date or a bare number in its other forms too."""
    bare, none = F.trim(value), F.array().cast("array<string>")
    day = let(F.when(bare.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(bare, "yyyy-MM-dd")), lambda d: F.when(d.isNotNull(), date_forms(d, hint)))
    exact = F.when(bare.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), bare.try_cast("decimal(38,10)"))
    number = let(F.struct(exact.alias("n"), bare.alias("t")), lambda x: F.when(x["n"].isNotNull(), number_forms(x["n"], x["t"], hint)))
    return F.array_distinct(F.concat(F.array(value), F.coalesce(day, number, none)))


def hinted(hint: Column, make: Callable[[str | None], Column]) -> Column:
    """Forms for a hint that a column holds: only the branch of its language or country is worked out."""
    key = F.lower(F.left(F.trim(hint), F.lit(2)))
    out = None
    for known in dict.fromkeys((*SEPARATORS, *LANGUAGES)):
        out = F.when(key == known, make(known)) if out is None else out.when(key == known, make(known))
    return out.otherwise(make(None))


def render_candidates(value: Column, kind: str, hint: str | Column | None = None) -> Column:
    """Surface forms of a value of a schema's kind: bool, int, float, date, str. The hint puts its own forms first."""
    if isinstance(hint, Column):
        return hinted(hint, lambda h: render_candidates(value, kind, h))
    if kind == "bool":
        return boolean_forms(value)
    if kind == "date":
        return date_forms(value, hint)
    if kind in ("int", "float"):
        shown = value.cast("string") if kind == "int" else number_text(value)
        return let(F.struct(value.cast("decimal(38,10)").alias("n"), shown.alias("t")), lambda x: number_forms(x["n"], x["t"], hint))
    return let(value, lambda v: string_forms(v, hint))


def number_text(value: Column) -> Column:
    """A DOUBLE as plain digits, a whole one with one zero behind the point."""
    return let(F.regexp_replace(value.cast("decimal(38,10)").cast("string"), "0+$", ""), lambda plain: F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain))


@dataclass
class Grounded:
    """A field's check against a source text. ``mode``: normalized, exact or fuzzy; ``on_mismatch``: retry or flag.

    ``locale`` is a hint, and ``locale_field`` a sibling field that holds a better one: they put a value's likely forms
    first, but never decide, as all forms are tried. ``source`` names the text to look in.
    """

    mode: str = "normalized"
    locale: str | None = None
    on_mismatch: str = "retry"
    threshold: float = 0.85
    source: str | None = None
    locale_field: str | None = None

    def holds(self, value: Column, source: Column, forms: Column | None = None) -> Column:
        """True if ``value`` (text) or one of ``forms`` occurs; null value or source passes."""
        if self.mode == "exact":
            found = source.contains(value)
        elif self.mode == "fuzzy":
            found = fuzzy_contains(normalized(value), normalized(source), self.threshold)
        else:
            found = contains_any(forms if forms is not None else F.array(value), source)
        return F.when(value.isNull() | source.isNull(), True).otherwise(found)

    def hint(self, record: Column) -> str | Column | None:
        """What the forms of this record's value are ordered by: the sibling field if it says something."""
        if self.locale_field is None:
            return self.locale
        return F.coalesce(F.nullif(record[self.locale_field].cast("string"), F.lit("")), F.lit(self.locale))


@dataclass
class FieldCheck:
    """A check of one's own: ``accepts`` gets value and source text and says whether all is well; a null answer passes."""

    accepts: Callable[[Column, Column], Column]
    message: str
    on_mismatch: str = "retry"
    source: str | None = None


_CHECK = "struct<field_path:string,shown:string,mode:string,threshold:double,source:string,forms:array<string>,accepted:boolean,message:string,rejecting:boolean>"


def _checks(record: Column, schema: RecordSchema, path: Column, texts: dict[str, Column]) -> Column:
    """Array of checks of all grounded values of a record, nested records, lists and maps included."""

    def own(r: Column, f: Field, here: Column) -> Column:
        check, text = f.grounded, texts[f.grounded.source or "default"]

        def made(value: Column) -> Column:
            shown = number_text(value) if f.kind == "float" else F.initcap(value.cast("string")) if f.kind == "bool" else value.cast("string")
            if isinstance(check, Grounded):
                mode, threshold, message = check.mode, check.threshold, f"is not in the source text{f' {check.source}' if check.source else ''}"
                accepted = text.contains(shown) if mode == "exact" else F.when((shown != "") & text.contains(shown), True)
                forms = F.array(shown) if mode in ("exact", "fuzzy") else render_candidates(value, f.kind, check.hint(r))
            else:
                mode, threshold, message, forms = "own", 0.0, check.message, F.lit(None).cast("array<string>")
                accepted = F.coalesce(check.accepts(value, text), F.lit(True))
            return F.struct(here.alias("field_path"), shown.alias("shown"), F.lit(mode).alias("mode"), F.lit(threshold).alias("threshold"), F.lit(check.source or "default").alias("source"), forms.alias("forms"), accepted.alias("accepted"), F.lit(message).alias("message"), F.lit(check.on_mismatch != "flag").alias("rejecting"))

        return F.when(r[f.name].isNotNull() & text.isNotNull(), F.array(let(r[f.name], made))).otherwise(F.array()).cast(f"array<{_CHECK}>")

    def parts(r: Column) -> Column:
        found = []
        for f in schema.fields:
            here = F.when(path == "", F.lit(f.name)).otherwise(F.concat(path, F.lit(SEPARATOR + f.name)))
            if f.grounded is not None and not f.many and not f.keyed and not isinstance(f.kind, RecordSchema):
                found.append(own(r, f, here))
            elif isinstance(f.kind, RecordSchema):
                inner = f.kind
                at = lambda x, part: _checks(x, inner, F.concat(here, F.lit(SEPARATOR), part), texts)  # noqa: B023, E731
                if f.many:
                    found.append(F.flatten(F.transform(r[f.name], lambda x, i: at(x, i.cast("string")))))
                elif f.keyed:
                    found.append(F.flatten(F.transform(F.map_entries(r[f.name]), lambda e: at(e["value"], e["key"]))))
                else:
                    found.append(_checks(r[f.name], inner, here, texts))
        none = F.array().cast(f"array<{_CHECK}>")
        return F.flatten(F.array(none, *[F.coalesce(x, none) for x in found]))

    return F.when(record.isNotNull(), parts(record))


@F.pandas_udf(ArrayType(BooleanType()))
def _searched(forms: pd.Series, modes: pd.Series, thresholds: pd.Series, named: pd.Series, names: pd.Series, texts: pd.Series) -> pd.Series:
    """For each row's open checks, whether a form occurs in the folded text of its source. The forms of a batch are looked
    for together, and each text is folded and read once; what may differ by some edits is searched by itself."""
    known: dict[str, str] = {}
    short = lambda f: known[f] if f in known else known.setdefault(f, fold(f))
    rows = [None if all_forms is None or not len(all_forms) else [(m, x, s, [short(f) for f in fs]) for fs, m, x, s in zip(all_forms, mode, threshold, source)] for all_forms, mode, threshold, source in zip(forms, modes, thresholds, named)]
    wanted = {f for row in rows if row for m, _, _, fs in row if m != "fuzzy" for f in fs}
    folded = {t: fold(t) for t in dict.fromkeys(t for row, text in zip(rows, texts) if row for t in text if t is not None)}
    found = dict(zip(folded, occurring(wanted, folded.values())))
    out = []
    for row, name, text in zip(rows, names, texts):
        at = dict(zip(name, text)) if row else {}
        out.append([any(fuzzy_hit(f, folded[at[s]], x) for f in fs) if m == "fuzzy" else not found[at[s]].isdisjoint(fs) for m, x, s, fs in row or ()])
    return pd.Series(out)


def search_forms(df: DataFrame, checks: str, sources: str, out: str) -> DataFrame:
    """Adds ``out``: whether each of an array of ``checks`` (struct with forms, mode, threshold and the name of a source)
    finds one of its forms in its source (``sources``: array of struct(name, text), without null texts), as an array of
    answers. Exact ones are case-sensitive; the others look in folded text."""
    part = lambda c, n: F.transform(c, lambda x: x[n])
    rows = df.withColumn(out + "_", _searched(*[part(checks, n) for n in ("forms", "mode", "threshold", "source")], part(sources, "name"), part(sources, "text")))
    text = F.map_from_arrays(part(sources, "name"), part(sources, "text"))
    pairs = F.arrays_zip(F.col(checks).alias("c"), F.col(out + "_").alias("a"))
    exact = lambda t, c: F.exists(c["forms"], lambda f: F.contains(t[c["source"]], f))
    return rows.withColumn(out, let(text, lambda t: F.transform(pairs, lambda z: F.when(z["c"]["mode"] == "exact", exact(t, z["c"])).otherwise(z["a"])))).drop(out + "_")


def required_sources(schema: RecordSchema) -> set[str]:
    """Names of the sources that a schema's checks look in, at any depth."""
    out = set()
    for f in schema.fields:
        if f.grounded is not None and f.grounded.source:
            out.add(f.grounded.source)
        if isinstance(f.kind, RecordSchema):
            out |= required_sources(f.kind)
    return out


def grounded(df: DataFrame, schema: RecordSchema, record: str = "record", source: Column | None = None, sources: dict[str, Column] | None = None, out: str = "grounding") -> DataFrame:
    """Adds ``out``: findings (as ``rules.ISSUE``) of values of a validated record that aren't in their source, in the
    order of fields; none for a null record.

    Nested records, list items and map values are walked; lists of scalars aren't checked. A null value or a null source
    passes, an empty source holds nothing. ``sources`` are named texts; one named default replaces ``source``; a name
    that a check needs and that isn't there is an error when the query is built. Verbatim and ASCII occurrences are
    found in the JVM; only what is left goes to Python, with each text folded once.
    """
    texts = {"default": F.lit(None).cast("string") if source is None else source} | (sources or {})
    if unknown := sorted(required_sources(schema) - texts.keys()):
        raise ValueError(f"no such source: {', '.join(unknown)}")
    checks, hay = (f"{out}_{n}_" for n in ("checks", "hay"))
    none, names = F.array().cast(f"array<{_CHECK}>"), F.array(*[F.lit(n) for n in texts])
    found = F.coalesce(_checks(F.col(record), schema, F.lit(""), texts), none)
    folded = F.map_from_arrays(names, F.array(*[F.when(is_ascii(t), normalized_ascii(t)) for t in texts.values()]))
    rows = once(df, **{checks: found, hay: folded})

    def plain(c: Column) -> Column:
        """Normalized checks whose source and forms are ASCII."""
        here = let(F.col(hay)[c["source"]], lambda h: F.when(h.isNotNull() & F.forall(c["forms"], is_ascii), F.exists(c["forms"], lambda f: F.contains(h, folded_form(f)))))
        return c.withField("accepted", F.coalesce(c["accepted"], F.when(c["mode"] != "fuzzy", here)))

    rows = once(rows.withColumnRenamed(checks, checks + "0"), **{checks: F.transform(checks + "0", plain)}).drop(checks + "0", hay)
    still = F.filter(checks, lambda c: c["accepted"].isNull())
    column = lambda n: F.transform(still, lambda c: c[n])
    answers = _searched(column("forms"), column("mode"), column("threshold"), column("source"), F.when(F.size(still) > 0, names), F.when(F.size(still) > 0, F.array(*texts.values())))
    rows = rows.withColumn(hay, answers)
    numbered = F.transform(checks, lambda c, i: c.withField("n", i))
    pairs = F.arrays_zip(F.filter(numbered, lambda c: c["accepted"].isNull()).alias("check"), F.col(hay).alias("found"))
    open_ones = F.transform(pairs, lambda p: p["check"].withField("accepted", p["found"]))
    failed = F.filter(F.concat(F.filter(numbered, lambda c: c["accepted"].isNotNull()), open_ones), lambda c: ~c["accepted"])
    issue = lambda c: F.struct(c["n"].alias("n"), c["field_path"].alias("field_path"), F.lit("grounding").alias("category"), F.lit("grounding").alias("error_type"), F.concat(F.lit("'"), truncated(c["shown"]), F.lit("' "), c["message"]).alias("message"), truncated(c["shown"]).alias("received"), c["rejecting"].alias("rejecting"))
    return once(rows, **{out: F.transform(F.array_sort(F.transform(failed, issue)), lambda x: x.dropFields("n")).cast(ISSUE)}).drop(checks, hay)
