"""Rows that fail to parse: typed records on one side, failures with their reason on the other.

Each delivered line is assembled into a record without blanks around its quoted fields, read by
Python's csv reader in strict mode inside a partition-wise Arrow map, and only a record whose
structure is sound reaches the typed field constructors. The reader's own exceptions decide on
quotes that aren't closed or are followed by text; they are caught before any field is typed.
"""

from __future__ import annotations

import csv
import re
import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from datetime import date

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.runtime import BROADCAST_ROWS, fits, materialise

#: A delivery is cut into blocks of so many lines, so that one long delivery is no hot key.
BLOCK_LINES = 50_000

MONTHS = (
    "january february march april may june july august september october november december".split()
)

_BLANKS = " \t\r"
_BEFORE_QUOTE, _AFTER_QUOTE = re.compile(r',[ \t]+(?=")'), re.compile(r'"[ \t]+(?=,)')
_QUOTED = re.compile(r'(^|,)"(?:[^"]|"")*"(?=,|$)')
_SLASHED = re.compile(r"([0-9]{1,2})/([0-9]{1,2})/([0-9]{4}|[0-9]{2})")
_DAY = re.compile(r"[0-9]{1,2}")
_YEAR = re.compile(r"[0-9]{4}")
_RESULT = re.compile(r"(<?)[ \t\r]*([0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)((?:\.[0-9]+)?)")


class QuotingError(ValueError):
    """Quotes stand where none may, or aren't closed on the line."""


class ColumnsError(ValueError):
    """The number of fields isn't that of the header."""


class FieldError(ValueError):
    """A field has no valid value."""


REASONS = {QuotingError: "quoting", ColumnsError: "columns", FieldError: "values"}


def assemble(line: str) -> str:
    """One line as one record for the csv reader.

    A carriage return or line feed within the line becomes a tab or vertical tab, so that it ends
    no record. Blanks at the ends and between a comma and a quote go, whichever way the quote
    faces: that changes neither the order of quotes and commas nor which quotes are written twice.
    """
    record = line.strip(_BLANKS)
    if "\r" in record or "\n" in record:
        record = record.replace("\r", "\t").replace("\n", "\v")
    if '"' in record:
        record = _AFTER_QUOTE.sub('"', _BEFORE_QUOTE.sub(",", record))
    return record


def read_fields(line: str) -> list[str]:
    """The fields of one line by the strict csv reader, without the blanks around them.

    The reader raises for quotes that aren't closed and for text after a closing quote. A quote
    within an unquoted field passes it and is looked for afterwards, in fields that hold quotes.
    """
    record = assemble(line)
    try:
        fields = next(csv.reader((record,), strict=True), [])
    except csv.Error as error:
        raise QuotingError(str(error)) from error
    if any('"' in field for field in fields) and '"' in _QUOTED.sub(r"\1", record):
        raise QuotingError("a quote stands within an unquoted field")
    return [field.strip(_BLANKS) for field in fields]


def calendar_date(year: int, month: int, day: int) -> date:
    try:
        return date(year, month, day)
    except ValueError as error:
        raise FieldError(str(error)) from error


def slashed_date(text: str) -> date:
    """month/day/year; a year of two digits is 20yy."""
    found = _SLASHED.fullmatch(text)
    if not found:
        raise FieldError(f"no date: {text[:80]}")
    month, day, year = found.groups()
    return calendar_date(int(year) + (2000 if len(year) == 2 else 0), int(month), int(day))


def named_date(month: str, day: str, year: str) -> date:
    """A full English month name in any case, a day and a year of four digits."""
    name = month.lower()
    if name not in MONTHS or not _DAY.fullmatch(day) or not _YEAR.fullmatch(year):
        raise FieldError(f"no date: {month[:40]} {day[:40]} {year[:40]}")
    return calendar_date(int(year), MONTHS.index(name) + 1, int(day))


def measurement(text: str) -> tuple[float | None, bool | None]:
    """(number, below the reporting limit); an empty field is a valid measurement of nothing."""
    if not text:
        return None, None
    found = _RESULT.fullmatch(text)
    if not found:
        raise FieldError(f"no result: {text[:80]}")
    mark, whole, fraction = found.groups()
    return float(whole.replace(",", "") + fraction), mark == "<"


@dataclass(frozen=True)
class Layout:
    """A header's field names and the constructor that types a record under it."""

    names: tuple[str, ...]
    construct: Callable[[list[str]], tuple[date, float | None, bool | None]]


MEASUREMENT_LAYOUTS = (
    Layout(("collectdate", "domoic result"), lambda f: (slashed_date(f[0]), *measurement(f[1]))),
    Layout(
        ("harvest month", "harvest date", "harvest year", "domoic acid"),
        lambda f: (named_date(f[0], f[1], f[2]), *measurement(f[3])),
    ),
)


def _layout_of(header: str | None, layouts: tuple[Layout, ...]) -> int | None:
    """The number of the layout that a header line names, or None."""
    try:
        fields = tuple(f.lower() for f in read_fields((header or "").lstrip("\ufeff")))
    except QuotingError:
        return None
    return next((n for n, layout in enumerate(layouts) if layout.names == fields), None)


_OUT = "measured_on date, result double, below_limit boolean, reason string, detail string"


def parse_lines(
    lines: DataFrame,
    *,
    line_id: str = "line_id",
    delivery: str = "delivery_id",
    line_no: str = "line_no",
    raw: str = "raw_line",
    layouts: tuple[Layout, ...] = MEASUREMENT_LAYOUTS,
    keep: Sequence[str] = (),
    block_lines: int = BLOCK_LINES,
    broadcast_deliveries: int = BROADCAST_ROWS,
) -> DataFrame:
    """(line_id, delivery, line_no, measured_on, result, below_limit, reason, detail, *keep), one row per data line.

    ``reason`` is NULL for a typed measurement, else ``quoting``, ``columns`` or ``values``,
    the first that applies in this order; ``detail`` says what was found. Line 1 of a delivery
    is its header and no data line; lines that are NULL or hold only blanks are none either.
    Lines of a delivery without header, of one whose header fits no layout, or without a
    delivery get the reason ``header``. Repeated lines are all kept, each under its own id;
    further columns are ignored unless named in ``keep``, whose names must not be among those above; an
    empty table gives an empty result.

    Headers are read first, as one layout number per delivery. Up to ``broadcast_deliveries`` of
    them are broadcast, and lines are then read once and not shuffled; more reach their lines by an
    equi-join on delivery and block of lines, so that the largest group is ``block_lines`` lines
    however long a delivery is.
    """
    block = F.floor(F.col(line_no) / block_lines)
    body = lines.where((F.col(line_no) > 1) | F.col(line_no).isNull()).select(
        F.col(line_id).alias("line_id"), F.col(delivery).alias("delivery_id"), F.col(line_no).alias("line_no"), F.col(raw).alias("raw_line"), *keep,
    ).where(F.length(F.trim("raw_line", F.lit(_BLANKS))) > 0)

    def recognise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        for batch in batches:
            found = [_layout_of(head, layouts) for head in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int32())], ["delivery_id", "layout"])

    kinds = dict(body.dtypes)
    first = lines.where((F.col(line_no) == 1) & F.col(delivery).isNotNull()).groupBy(F.col(delivery).alias("delivery_id")).agg(F.min_by(raw, line_id).alias("header"))
    headers = materialise(first.mapInArrow(recognise, f"delivery_id {kinds['delivery_id']}, layout int"), "headers")
    if fits(headers, broadcast_deliveries):
        joined = body.join(F.broadcast(headers), "delivery_id", "left")
    else:
        body = body.withColumn("_block", block)
        keyed = body.select("delivery_id", "_block").distinct().join(headers, "delivery_id")
        joined = body.join(keyed, ["delivery_id", "_block"], "left")
    kept = joined.select("line_id", "delivery_id", "line_no", "raw_line", "layout", *keep)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        for batch in batches:
            days, results, below, reasons, details = [], [], [], [], []
            for line, number in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                day = value = mark = reason = detail = None
                if number is None:
                    reason, detail = "header", "the delivery has no header of a known layout"
                else:
                    layout = layouts[number]
                    try:
                        fields = read_fields(line)
                        if len(fields) != len(layout.names):
                            raise ColumnsError(f"{len(fields)} fields, the header has {len(layout.names)}")
                        day, value, mark = layout.construct(fields)
                    except (QuotingError, ColumnsError, FieldError) as error:
                        reason, detail = REASONS[type(error)], str(error)
                days.append(day)
                results.append(value)
                below.append(mark)
                reasons.append(reason)
                details.append(detail)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), batch.column(2),
                    pa.array(days, pa.date32()), pa.array(results, pa.float64()),
                    pa.array(below, pa.bool_()), pa.array(reasons, pa.string()), pa.array(details, pa.string()), *batch.columns[5:],
                ],
                ["line_id", "delivery_id", "line_no", "measured_on", "result", "below_limit", "reason", "detail", *keep],
            )

    schema = f"line_id {kinds['line_id']}, delivery_id {kinds['delivery_id']}, line_no {kinds['line_no']}, {_OUT}" + "".join(f", {c} {kinds[c]}" for c in keep)
    return kept.mapInArrow(parse, schema)


def is_header(raw: Column, layouts: tuple[Layout, ...] = MEASUREMENT_LAYOUTS) -> Column:
    """Whether a line holds the names of a layout and nothing else, quotes, blanks and case aside."""
    plain = F.lower(F.regexp_replace(raw, "[\ufeff\"\r]", ""))
    return F.array_join(F.transform(F.split(plain, ","), lambda name: F.trim(name, F.lit(_BLANKS))), ",").isin([",".join(x.names) for x in layouts])


def valid_rows(parsed: DataFrame) -> DataFrame:
    """The typed measurements of :func:`parse_lines`."""
    return parsed.where("reason IS NULL").drop("reason", "detail")


def failed_rows(parsed: DataFrame) -> DataFrame:
    """(line_id, reason) of the lines of :func:`parse_lines` that fail."""
    return parsed.where("reason IS NOT NULL").select("line_id", "reason")
