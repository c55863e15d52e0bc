"""CDX lines: seven fields, single blanks between them, ``-`` for what isn't known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import bare_id, cdx_date, dash_to_null, first_header, null_to_dash, parse_rfc3339

FIELDS = ("url", "type", "id", "date", "file", "offset", "raw_size")
_NULLABLE = ("url", "file", "offset", "raw_size")


def parse_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """The input with the seven fields and ``bad``: a line that hasn't seven parts, or whose raw_size isn't a number."""
    parts = F.split(F.col(line), " ", -1)
    fits = F.size(parts) == 7
    value = lambda k: F.when(fits, dash_to_null(F.get(parts, k)) if FIELDS[k] in _NULLABLE else F.get(parts, k))
    size = value(6)
    number = F.when(size.rlike("^[0-9]{1,18}$"), size.cast("bigint"))
    bad = ~F.coalesce(fits, F.lit(False)) | (size.isNotNull() & number.isNull())
    return lines.select("*", *[value(k).alias(FIELDS[k]) for k in range(6)], number.alias("raw_size"), bad.alias("bad"))


def stop_on_bad(parsed: DataFrame, file: str = "path", order: str = "line_no") -> DataFrame:
    """Lines before the first bad one of each file. Files without bad lines aren't shuffled apart from a small join."""
    first = parsed.where("bad").groupBy(file).agg(F.min(order).alias("_first"))
    both = parsed.join(first, file, "left")
    return both.where(F.col("_first").isNull() | (F.col(order) < F.col("_first"))).drop("_first")


def format_line(row: dict[str, Column] | None = None) -> Column:
    """A line from the seven columns; a blank within a field is written as %20, so that the line can be read again."""
    get = row or {c: F.col(c) for c in FIELDS}
    return F.concat_ws(" ", *[F.replace(null_to_dash(get[c]), F.lit(" "), F.lit("%20")) for c in FIELDS])


def from_records(records: DataFrame, headers: str = "headers", keep: dict[str, str] | None = None) -> DataFrame:
    """The seven fields of WARC records; those of the file are taken from columns path, offset, raw_size. ``keep``: other columns and their new names."""
    h = F.col(headers)
    return records.select(
        *[F.col(c).alias(n) for n, c in (keep or {}).items()],
        first_header(h, "WARC-Target-URI").alias("url"), first_header(h, "WARC-Type").alias("type"), bare_id(first_header(h, "WARC-Record-ID")).alias("id"),
        cdx_date(parse_rfc3339(first_header(h, "WARC-Date"))).alias("date"), F.col("path").alias("file"), F.col("offset").cast("string").alias("offset"), F.col("raw_size").cast("bigint").alias("raw_size"),
    )


def read_cdx(spark: SparkSession, path: str, on_error: str = "stop") -> DataFrame:
    """Lines of CDX files: path, line_no and the seven fields. ``on_error``: stop (a file ends before its first bad line), skip, or fail.

    ``line_no`` orders the lines of a file: the start of the block that holds it, and its
    place among the lines of the task that reads it. Files are read in blocks by any
    number of tasks; no line is moved.
    """
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), place.alias("line_no"), F.rtrim(F.col("value"), F.lit("\r")).alias("line"))
    whole = lines.where("line <> ''")
    parsed = parse_lines(whole)
    if on_error == "fail":
        parsed = parsed.withColumn("bad", F.when(F.col("bad"), F.raise_error(F.concat(F.lit("bad CDX line: "), "line"))).otherwise(False)).where("NOT bad")
    elif on_error == "skip":
        parsed = parsed.where("NOT bad")
    elif on_error == "stop":
        parsed = stop_on_bad(parsed)
    else:
        raise ValueError("on_error is stop, skip or fail")
    return parsed.select("path", "line_no", *FIELDS)
