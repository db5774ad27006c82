"""Validated scalar types: text in, struct(value, error) out; value is normalised, error null when valid.

Everything stays in JVM expressions except recurrence rules, which need a calendar library.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def _result(value: Column, ok: Column, error: Column | str, given: Column) -> Column:
    error = F.lit(error) if isinstance(error, str) else error
    good = given.isNotNull() & F.coalesce(ok, F.lit(False))
    return F.struct(F.when(good, value).alias("value"), F.when(~good, error).alias("error"))


def _squeezed(c: Column, chars: str = r"(?U)\s+") -> Column:
    return F.upper(F.regexp_replace(c, chars, ""))


def iso_date(c: Column) -> Column:
    """``YYYY-MM-DD`` of a real day; wrong shape and impossible day have different errors."""
    shape = c.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}\\n?$")
    real = F.try_to_date(c, "yyyy-MM-dd").isNotNull() & ~c.startswith("0000") & (F.length(c) == 10)
    return _result(c, shape & real, F.when(shape, F.lit("not a real calendar date")).otherwise(F.lit("expected YYYY-MM-DD")), c)


def _fold_digits(chars: Column, modulus: int) -> Column:
    """Remainder of the number that letters (A = 10) and digits spell; never holds more than a step's digits."""
    step = lambda a, c: F.when(c.rlike("[A-Z]"), (a * 100 + F.ascii(c) - 55) % modulus).otherwise((a * 10 + F.try_to_number(c, F.lit("9")).cast("long")) % modulus)
    return F.aggregate(F.filter(F.split(chars, ""), lambda x: x != ""), F.lit(0).cast("long"), step)


def iban(c: Column) -> Column:
    v = _squeezed(c)
    shape = v.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{1,30}$")
    moved = F.concat(F.substr(v, F.lit(5)), F.left(v, F.lit(4)))
    return _result(v, shape & (F.when(shape, _fold_digits(moved, 97)) == 1), F.when(shape, F.lit("IBAN checksum is wrong")).otherwise(F.lit("not an IBAN")), c)


def vat_id(c: Column) -> Column:
    v = _squeezed(c, r"[ .\-]+")
    return _result(v, v.rlike("^[A-Z]{2}[A-Z0-9]{2,12}$"), "not a VAT id", c)


def isin(c: Column) -> Column:
    v = _squeezed(c)
    shape = v.rlike("^[A-Z]{2}[A-Z0-9]{9}[0-9]$")
    digits = F.array_join(F.transform(F.filter(F.split(v, ""), lambda x: x != ""), lambda x: F.when(x.rlike("[A-Z]"), (F.ascii(x) - 55).cast("string")).otherwise(x)), "")
    return _result(v, shape & F.call_function("luhn_check", digits), F.when(shape, F.lit("ISIN checksum is wrong")).otherwise(F.lit("not an ISIN")), c)


def phone(c: Column) -> Column:
    v = F.regexp_replace(F.regexp_replace(c, r"(?U)[\s().\-/]+", ""), "^00", "+")
    return _result(v, v.rlike(r"^\+[1-9][0-9]{1,14}$"), "not an international phone number", c)


#: ISO 4217 codes in use.
CURRENCIES = (
    "AED", "AFN", "ALL", "AMD", "ANG", "AOA", "ARS", "AUD", "AWG", "AZN", "BAM", "BBD", "BDT", "BGN", "BHD", "BIF", "BMD", "BND", "BOB", "BOV",
    "BRL", "BSD", "BTN", "BWP", "BYN", "BZD", "CAD", "CDF", "CHE", "CHF", "CHW", "CLF", "CLP", "CNY", "COP", "COU", "CRC", "CUC", "CUP", "CVE",
    "CZK", "DJF", "DKK", "DOP", "DZD", "EGP", "ERN", "ETB", "EUR", "FJD", "FKP", "GBP", "GEL", "GHS", "GIP", "GMD", "GNF", "GTQ", "GYD", "HKD",
    "HNL", "HTG", "HUF", "IDR", "ILS", "INR", "IQD", "IRR", "ISK", "JMD", "JOD", "JPY", "KES", "KGS", "KHR", "KMF", "KPW", "KRW", "KWD", "KYD",
    "KZT", "LAK", "LBP", "LKR", "LRD", "LSL", "LYD", "MAD", "MDL", "MGA", "MKD", "MMK", "MNT", "MOP", "MRU", "MUR", "MVR", "MWK", "MXN", "MXV",
    "MYR", "MZN", "NAD", "NGN", "NIO", "NOK", "NPR", "NZD", "OMR", "PAB", "PEN", "PGK", "PHP", "PKR", "PLN", "PYG", "QAR", "RON", "RSD", "RUB",
    "RWF", "SAR", "SBD", "SCR", "SDG", "SEK", "SGD", "SHP", "SLE", "SOS", "SRD", "SSP", "STN", "SVC", "SYP", "SZL", "THB", "TJS", "TMT", "TND",
    "TOP", "TRY", "TTD", "TWD", "TZS", "UAH", "UGX", "USD", "USN", "UYI", "UYU", "UYW", "UZS", "VED", "VES", "VND", "VUV", "WST", "XAF", "XAG",
    "XAU", "XCD", "XDR", "XOF", "XPD", "XPF", "XPT", "YER", "ZAR", "ZMW", "ZWG", "ZWL",
)
#: ISO 639-1 codes that were withdrawn but that a JVM still lists.
WITHDRAWN_LANGUAGES = ("in", "iw", "ji", "mo")


def stripped(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def member(c: Column, codes: list[str], what: str, lower: bool = False) -> Column:
    """Membership in a code list (a literal set, checked by hash) without outer white space, in one case."""
    v = F.lower(stripped(c)) if lower else F.upper(stripped(c))
    return _result(v, v.isin(*codes), f"not a {what}", c)


def country_codes(spark: SparkSession) -> list[str]:
    """ISO 3166-1 alpha-2 codes of the running JVM's locale data."""
    return sorted(spark._jvm.java.util.Locale.getISOCountries())


def language_codes(spark: SparkSession) -> list[str]:
    """ISO 639-1 codes in use: those of the running JVM, less the withdrawn ones."""
    return sorted({x for x in spark._jvm.java.util.Locale.getISOLanguages() if len(x) == 2}.difference(WITHDRAWN_LANGUAGES))


def country(c: Column, codes: list[str]) -> Column:
    return member(c, codes, "country code")


def currency(c: Column, codes: list[str] = CURRENCIES) -> Column:
    return member(c, codes, "currency code")


def language(c: Column, codes: list[str]) -> Column:
    return member(c, codes, "language code", lower=True)


@F.pandas_udf(StructType([StructField("value", StringType()), StructField("error", StringType())]))
def rrule(texts: pd.Series) -> pd.DataFrame:
    """RFC 5545 recurrence rules; a missing library is an error of the job, not of a row."""
    from dateutil.rrule import rrulestr

    out = []
    for t in texts:
        rule = (t or "").strip()
        try:
            if "FREQ=" not in rule.upper():
                raise ValueError("a recurrence rule needs FREQ")
            rrulestr(rule)
            out.append((rule, None))
        except Exception as e:  # the library raises many kinds on bad rules
            out.append((None, f"not a recurrence rule: {e}"))
    return pd.DataFrame(out, columns=["value", "error"])
