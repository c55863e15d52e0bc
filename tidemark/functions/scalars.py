"""Scalar functions over archive columns; each takes and gives a Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.schema import ACTIVE, CDX_DATE

KINDS = ("none", "any", "list", "prefix")


def cdx_date(ts: Column) -> Column:
    """Fourteen digits; parts of a second are cut off."""
    return F.date_format(ts, CDX_DATE)


def parse_cdx_date(text: Column) -> Column:
    """The time of fourteen digits, without a zone; null where it isn't one."""
    return F.when(text.rlike("^[0-9]{14}$"), F.try_to_timestamp(text, F.lit(CDX_DATE))).cast("timestamp_ntz")


def parse_rfc3339(text: Column) -> Column:
    """The UTC time of ``2024-01-02T03:04:05Z``, or one with an offset; null where it isn't one."""
    ok = text.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$")
    return F.to_utc_timestamp(F.when(ok, F.try_to_timestamp(F.upper(text))), F.current_timezone()).cast("timestamp_ntz")


def bare_id(text: Column) -> Column:
    """A record id without the angle brackets around it."""
    return F.trim(text, F.lit("<>"))


def dash_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit("-"))


def null_to_dash(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("-"))


def is_active(flags: Column) -> Column:
    return flags.bitwiseAND(F.lit(ACTIVE)) == ACTIVE


def little_endian_u32(data: Column, first: int = 5) -> Column:
    """The unsigned number in four bytes, the first of them the ``first``-th (from 1)."""
    digits = [F.hex(F.substring(data, first + k, 1)) for k in (3, 2, 1, 0)]
    return F.when(F.octet_length(data) >= first + 3, F.conv(F.concat(*digits), 16, 10).cast("bigint"))


def kind_number(name: Column) -> Column:
    """Unknown names are none."""
    found = F.lit(0)
    for number, known in enumerate(KINDS[1:], 1):
        found = F.when(name == known, number).otherwise(found)
    return found.cast("smallint")


def kind_name(number: Column) -> Column:
    found = F.lit(KINDS[0])
    for k, name in enumerate(KINDS[1:], 1):
        found = F.when(number == k, name).otherwise(found)
    return found


def first_header(headers: Column, name: str) -> Column:
    return F.try_element_at(F.try_element_at(headers, F.lit(name)), F.lit(1))
