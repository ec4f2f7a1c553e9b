"""Tolerant date parsing and formatting."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accepted forms, tried in this order.
FORMS = [
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]",
    "yyyy-MM-dd[ HH:mm:ss][.SSSSSS][.SSS]",
    "yyyy/MM/dd",
    "dd/MM/yyyy",
    "d/M/yyyy",
    "yyyy-MM",
    "yyyy/MM",
    "yyyy",
    "ddMMMyyyy:HH:mm:ss.SSS",
]

#: Separators and orders of the older parser.
LEGACY_FORMS = [f"{order}{time}" for sep in "/- " for order in (f"d{sep}M{sep}yyyy", f"yyyy{sep}M{sep}d") for time in ("", " H:m:s", " H:m")]

# Provider granularities and the patterns they stand for.
GRANULARITY = {
    "yyyy-MM-dd": "yyyy-MM-dd",
    "YYYY-MM-DD": "yyyy-MM-dd",
    "yyyy-MM-ddTHH": "yyyy-MM-dd'T'HH",
    "yyyy-MM-ddTHH:mm": "yyyy-MM-dd'T'HH:mm",
    "yyyy-MM-ddTHH:mm:ss": "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-ddTHH:mm:ssZ": "yyyy-MM-dd'T'HH:mm:ss'Z'",
    "yyyy-MM-ddTHH:mm:ss.SSSZ": "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'",
    "yyyy-MM-ddTHH:mm:ss.SSS": "yyyy-MM-dd'T'HH:mm:ss.SSS",
    "yyyy-MM-ddTHH:mm:ss.SSSXXX": "yyyy-MM-dd'T'HH:mm:ss.SSSXXX",
    "yyyy-MM-ddTHH:mm:ss.SSSXXXZ": "yyyy-MM-dd'T'HH:mm:ss.SSSXXX'Z'",
}
DEFAULT_PATTERN = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def _shape(form: str) -> str:
    """A pattern that all texts of a form match: it says little about numbers, but parsing what cannot fit costs an exception each."""
    out, quoted = [], False
    for m in re.finditer(r"'|([A-Za-z])\1*|.", form):
        part = m.group(0)
        if part == "'":
            quoted = not quoted
        elif quoted:
            out.append(re.escape(part))
        elif part in "[]":
            out.append("(?:" if part == "[" else ")?")
        elif part[0] == "X":
            out.append("(?:Z|[+-][0-9:]+)")
        elif part == "MMM":
            out.append(r"\p{L}+\.?")
        elif part == "yyyy":
            out.append("[+-]?[0-9]{4,}")
        elif len(part) == 2 and part.isalpha():
            out.append("[0-9]{2}")
        elif part[0].isalpha():
            out.append("[+-]?[0-9]+")
        else:
            out.append(re.escape(part))
    return f"(?i)\\A{''.join(out)}\\z"


def _first(value: Column, forms: list[str]) -> Column:
    return F.coalesce(*[F.when(value.rlike(_shape(f)), F.try_to_timestamp(value, F.lit(f))) for f in forms])


def parse_date(value: Column) -> Column:
    """The first form that fits, as a timestamp; null where none does."""
    return _first(F.trim(value), FORMS)


def parse_legacy(value: Column, end_of_day: bool = False) -> Column:
    """Day-month-year or year-month-day with ``/``, ``-`` or a space; optionally the day's last second."""
    parsed = _first(F.trim(value), LEGACY_FORMS)
    return F.date_trunc("day", parsed) + F.expr("INTERVAL '23:59:59' HOUR TO SECOND") if end_of_day else parsed


def is_date(value: Column) -> Column:
    return parse_date(value).isNotNull()


def format_for(value: Column, granularity: str | None) -> Column:
    """A timestamp as a provider of that granularity wants it."""
    return F.date_format(value, GRANULARITY.get(granularity or "", DEFAULT_PATTERN))


def machine(value: Column) -> Column:
    return F.date_format(value, DEFAULT_PATTERN)


def human(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd HH:mm:ss")
