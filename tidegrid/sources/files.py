"""Readers and writers of the file forms that series come in."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.functions.scalars import count_value
from tidegrid.operators.dirty_rows import MONTHS, QuotingError, is_header, parse_lines, read_fields, valid_rows
from tidegrid.runtime import discard_at_end, fits, shared_dir


def scratch(spark: SparkSession, label: str) -> str:
    """A path of its own in the folder that all executors share."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def _write(df: DataFrame, kind: str, path: str, **options) -> str:
    df.write.mode("overwrite").format(kind).options(**options).save(path)
    if path.startswith(shared_dir(df.sparkSession)):
        discard_at_end(df.sparkSession, path)
    return path


def write_parquet(df: DataFrame, path: str) -> str:
    return _write(df, "parquet", path)


def write_csv(df: DataFrame, path: str) -> str:
    return _write(df, "csv", path, header=True)


def write_json(df: DataFrame, path: str) -> str:
    return _write(df, "json", path)


def csv_to_parquet(spark: SparkSession, source: str, target: str, schema: T.StructType | None = None) -> str:
    """CSV with a header as Parquet; without a schema all columns stay text."""
    reader = spark.read.option("header", True)
    return write_parquet((reader.schema(schema) if schema else reader).csv(source), target)


def site_title(file_name: Column) -> Column:
    """``long-beach-da.csv`` as ``Long Beach``."""
    stem = F.regexp_replace(F.regexp_replace(file_name, r"^.*/", ""), r"\.csv$", "")
    return F.initcap(F.translate(F.regexp_replace(stem, "[-_](da|pn)$", ""), "-_", "  "))


def _calendar_date(year: Column, month: Column, day: Column) -> Column:
    """NULL where the calendar has no such date."""
    text = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.to_date(F.try_to_timestamp(F.when(year.isNotNull() & month.isNotNull() & day.isNotNull(), text), F.lit("yyyy-MM-dd")))


def date_from_parts(month: Column, day: Column, year: Column) -> Column:
    """A month's full English name in any case, a day and a year of four digits; anything else is NULL."""
    number = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.trim(month)))
    plain = lambda c, pattern: F.when(F.trim(c).rlike(pattern), F.trim(c))
    return _calendar_date(plain(year, "^[0-9]{4}$"), F.when(number > 0, number.cast("string")), plain(day, "^[0-9]{1,2}$"))


def lenient_date(text: Column) -> Column:
    """Month/day/year with a year of four digits, or of two meaning 20yy, mixed in one column; anything else is NULL."""
    trimmed = F.trim(text)
    part = lambda n: F.when(trimmed.rlike(_SLASHED), F.regexp_extract(trimmed, _SLASHED, n))
    year = part(3)
    return _calendar_date(F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year), part(1), part(2))


_SLASHED = "^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4}|[0-9]{2})$"


def series_of_lines(parsed: DataFrame, file: str, censored: str = "drop") -> DataFrame:
    """(date, site, da_raw) of the measurements of ``parse_lines`` that have a number; the site is the file's name.

    Results below the reporting limit are dropped, or count as half with ``censored`` = ``half``.
    """
    rows = valid_rows(parsed).where("result IS NOT NULL")
    rows = rows.where("NOT below_limit") if censored == "drop" else rows
    value = F.when(F.col("below_limit"), F.col("result") / 2).otherwise(F.col("result"))
    return rows.select(F.col("measured_on").alias("date"), site_title(F.col(file)).alias("site"), value.alias("da_raw"))


def read_measurements(spark: SparkSession, paths: list[str], censored: str = "drop") -> DataFrame:
    """(date, site, da_raw) of CSV files in either layout, told apart by their header.

    All files are read in one scan of lines, which are typed by :func:`parse_lines`: a file is a delivery,
    and a line that holds the names of a layout its header. Lines that fail, and files without known
    header, have no rows; :func:`failed_rows` has their reasons.
    """
    if not paths:
        raise ValueError("no measurement file given")
    return series_of_lines(read_lines(spark, paths), "file", censored)


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The lines of measurement files as typed rows, with ``file``, and the reason where one fails."""
    lines = spark.read.text(paths).select(F.col("value").alias("raw_line"), F.col("_metadata.file_path").alias("file"))
    numbered = lines.select(
        F.monotonically_increasing_id().alias("line_id"), "raw_line", "file", F.col("file").alias("delivery_id"),
        F.when(is_header(F.col("raw_line")), 1).otherwise(2).alias("line_no"),
    )
    return parse_lines(numbered, keep=["file"])


def read_counts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(date, site, pn) of cell-count files; the count's column is the one that names the genus.

    All files are read in one scan of lines. A file's header is its first line that names a date and the
    genus, and says where both stand; lines with bad quotes, too few fields, no date or no number, and files
    without header have no rows.
    """
    if not paths:
        raise ValueError("no count file given")
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    names = F.lower("line")
    headers = lines.where(names.contains("date") & names.contains("pseudo") & names.contains("nitzschia")).groupBy("file").agg(F.min("line").alias("header"))
    met = lines.join(F.broadcast(headers) if fits(headers) else headers, "file").where("line <> header").select("file", "line", "header")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[str, tuple[int, int] | None] = {}
        for batch in batches:
            rows = []
            for file, line, header in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if header not in places:
                    fields = [f.lstrip("\ufeff").strip().lower() for f in read_fields(header)]
                    count = next((i for i, f in enumerate(fields) if "pseudo" in f and "nitzschia" in f), None)
                    places[header] = (fields.index("date"), count) if "date" in fields and count is not None else None
                if places[header] is None:
                    continue
                try:
                    fields = read_fields(line)
                except QuotingError:
                    continue
                if len(fields) > max(places[header]):
                    rows.append((file, *(fields[i] for i in places[header])))
            columns = list(zip(*rows)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["file", "day", "count"])

    typed = met.mapInArrow(cut, "file string, day string, count string")
    return typed.select(lenient_date(F.col("day")).alias("date"), site_title(F.col("file")).alias("site"), count_value(F.col("count")).alias("pn")).dropna()


def fetch_chunks(tasks: DataFrame, url: str, fetch: Callable[[str], bytes], attempts: int = 3) -> DataFrame:
    """The download tasks with (body, error): each URL is fetched on an executor, a failed one again and then passed over.

    ``fetch`` gives the bytes of a URL or raises. A chunk that fails every time has a NULL body and the last
    error, so one bad chunk costs no other; a NULL URL is an error of its own. Tasks are spread evenly, as
    they have few rows and long waits.
    """
    spread = tasks.repartition(4 * tasks.sparkSession.sparkContext.defaultParallelism)
    at = spread.columns.index(url)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, errors = [], []
            for address in batch.column(at).to_pylist():
                body, error = None, "no address"
                for _ in range(attempts if address is not None else 0):
                    try:
                        body, error = fetch(address), None
                        break
                    except Exception as failure:  # whatever a source may raise
                        error = f"{type(failure).__name__}: {failure}"
                bodies.append(body)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bodies, pa.binary()), pa.array(errors, pa.string())], [*batch.schema.names, "body", "error"])

    return spread.mapInArrow(run, T.StructType([*spread.schema.fields, T.StructField("body", T.BinaryType()), T.StructField("error", T.StringType())]))


def month_chunks(pairs: DataFrame, first: str, last: str, url: Column) -> DataFrame:
    """(*pairs, chunk_start, chunk_end, url): a download task per pair and month between two dates."""
    a, b = F.lit(first).cast("date"), F.lit(last).cast("date")
    month = F.explode(F.sequence(F.trunc(a, "month"), F.trunc(b, "month"), F.expr("interval 1 month"))).alias("m")
    cut = pairs.select("*", month)
    start, end = F.greatest("m", a).cast("string"), F.least(F.last_day("m"), b).cast("string")
    filled = F.replace(F.replace(url, F.lit("{start_date}"), start), F.lit("{end_date}"), end)
    return cut.select(*pairs.columns, start.alias("chunk_start"), end.alias("chunk_end"), filled.alias("url"))


_FLOW = (
    "value struct<timeSeries: array<struct<variable: struct<variableCode: array<struct<value: string>>>,"
    "values: array<struct<value: array<struct<dateTime: string, value: string>>>>>>>"
)


def parse_flow_json(df: DataFrame, column: str, code: str) -> DataFrame:
    """The other columns with (moment, value) of the series of that code, or of the only one there is.

    Of the series the first block of values is read; negative and non-numeric values are left out.
    """
    series = F.from_json(column, _FLOW)["value"]["timeSeries"]
    wanted = F.filter(series, lambda s: s["variable"]["variableCode"][0]["value"] == code)
    chosen = F.when(F.size(wanted) > 0, wanted[0]).when(F.size(series) == 1, series[0])
    rest = [c for c in df.columns if c != column]
    points = df.select(*rest, F.explode(chosen["values"][0]["value"]).alias("p"))
    value = F.col("p.value").try_cast("double")
    return points.select(*rest, F.try_to_timestamp("p.dateTime").alias("moment"), value.alias("value")).where("value >= 0")
