"""How a record is shown: its own bytes, with or without headers, or as it is stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import first_header

OCTETS = "application/octet-stream"


def header_lines(headers: Column, size: Column) -> Column:
    """Version line, headers by name, Content-Length last, and the blank line."""
    keys = F.array_sort(F.filter(F.map_keys(headers), lambda k: k != "Content-Length"))
    lines = F.flatten(F.transform(keys, lambda k: F.transform(F.try_element_at(headers, k), lambda v: F.concat(k, F.lit(": "), v, F.lit("\r\n")))))
    return F.concat(F.lit("WARC/1.1\r\n"), F.array_join(lines, ""), F.lit("Content-Length: "), size.cast("string"), F.lit("\r\n\r\n"))


def serialise(headers: Column, body: Column) -> Column:
    """The bytes of a record; equal records have equal bytes."""
    data = F.coalesce(body.cast("binary"), F.lit(b""))
    return F.concat(header_lines(headers, F.octet_length(data)).cast("binary"), data, F.lit(b"\r\n\r\n"))


def render(records: DataFrame, flags: str = "", headers: str = "headers", body: str = "body", raw: str = "raw", dict_id: str = "dict_id") -> DataFrame:
    """Records with ``content_type``, ``response`` and ``http_headers``.

    Flags: ``h`` the record's headers come first, ``d`` it is to be saved, ``r`` the stored bytes; others mean nothing.
    """
    h, d = "h" in flags, "d" in flags
    if "r" in flags:
        known = F.coalesce(F.col(dict_id).cast("string"), F.lit(""))
        return records.select("*", F.lit(None).cast("string").alias("content_type"), F.col(raw).alias("response"), F.create_map(F.lit("Warc-Dictionary-Id"), F.array(known)).alias("http_headers"))
    data = F.coalesce(F.col(body).cast("binary"), F.lit(b""))
    whole = serialise(F.col(headers), F.col(body)) if h else data
    kind = F.lit(OCTETS) if d else F.lit("application/warc") if h else F.coalesce(first_header(F.col(headers), "Content-Type"), F.lit(OCTETS))
    mirrored = F.transform_keys(F.col(headers), lambda k, _: F.concat(F.lit("Warc-Header-"), k))
    return records.select("*", kind.alias("content_type"), whole.alias("response"), mirrored.alias("http_headers"))


def gather_headers(pairs: DataFrame, record: str = "record_id") -> DataFrame:
    """(record, headers) from rows (record, pos, key, value): of type, id and date the last holds, of others all, in order; lengths aren't kept."""
    single = F.col("key").isin("WARC-Type", "WARC-Record-ID", "WARC-Date")
    kept = pairs.where(F.col("key") != "Content-Length")
    each = kept.groupBy(record, "key").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("found"))
    values = F.when(single, F.array(F.element_at("found", -1)["value"])).otherwise(F.transform("found", lambda p: p["value"]))
    return each.groupBy(record).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", values.alias("value"))))).alias("headers"))
