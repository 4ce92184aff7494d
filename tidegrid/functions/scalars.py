"""Scalar expressions for sites, dates, readings, classes and output formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spaces, tabs and carriage returns.
BLANKS = " \t\r"

_READING = r"^(<[ \t\r]*)?([0-9]+(?:\.[0-9]+)?)$"


def site_key(site: Column) -> Column:
    """Sites are equal without regard to case, outer blanks, and ``-`` or ``_`` for a space."""
    return F.lower(F.translate(F.trim(site, F.lit(BLANKS)), "-_", "  "))


def usable_reading(text: Column) -> Column:
    """True if the text is a plain ASCII number or ``<`` and one, with blanks around it."""
    return F.coalesce(F.trim(text, F.lit(BLANKS)).rlike(_READING), F.lit(False))


def reading_value(text: Column, censored_share: float = 0.5) -> Column:
    """The number of a usable reading; ``<x`` counts as ``censored_share`` of x; else NULL."""
    trimmed = F.trim(text, F.lit(BLANKS))
    number = F.regexp_extract(trimmed, _READING, 2).try_cast("double")
    return F.when(F.startswith(trimmed, F.lit("<")), number * censored_share).otherwise(number)


def is_below_limit(text: Column) -> Column:
    return F.startswith(F.trim(text, F.lit(BLANKS)), F.lit("<"))


def count_value(text: Column) -> Column:
    """A cell count with optional thousands separators; anything else is NULL."""
    trimmed = F.trim(text, F.lit(BLANKS))
    plain = F.when(trimmed.rlike(r"^(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?$"), F.replace(trimmed, F.lit(","), F.lit("")))
    return plain.try_cast("double")


def monday(moment: Column) -> Column:
    return F.to_date(F.date_trunc("week", moment))


def settled(value: Column, digits: int = 6) -> Column:
    """Rounded so that sums which differ in their last bits agree: exact halves are lifted first.

    On doubles this is far cheaper than ``round``, which goes through decimals.
    """
    scale = 10.0**digits
    return F.rint(value * scale + 1e-3) / scale


def wall_micros(moment: Column) -> Column:
    """Microseconds of wall-clock time since 1970-01-01 00:00, whatever the session's time zone."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp")
    return F.timestamp_diff("MICROSECOND", epoch, moment.cast("timestamp"))
