"""Point lookups: by record id, and by URL and nearest date."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import is_active


def by_id(records: DataFrame, identifier: str) -> DataFrame:
    """The active record of that identifier; of several, the one with the least id."""
    return records.where(is_active(F.col("flags")) & (F.col("identifier") == identifier)).orderBy("id").limit(1)


def _seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1_000_000


def nearest(records: DataFrame, uri: str, when: dt.datetime | None = None) -> DataFrame:
    """The active capture of ``uri`` that is nearest to ``when`` (now, in UTC); of equally near ones, the one with the least id."""
    at = when or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    mine = records.where((F.col("uri") == uri) & (F.col("type") != "request") & is_active(F.col("flags")))
    return mine.orderBy(F.abs(_seconds(F.col("date")) - _seconds(F.lit(at).cast("timestamp_ntz"))), "id").limit(1)


def nearest_batch(records: DataFrame, requests: DataFrame, request_id: str = "request_id") -> DataFrame:
    """For each request (request_id, uri, at) the capture that ``nearest`` finds; requests that find none give no row.

    One equi-join by URL and a map-side combined minimum, so a URL with many captures isn't sorted.
    """
    live = records.where((F.col("type") != "request") & is_active(F.col("flags"))).select(F.col("uri").alias("_uri"), F.struct(*records.columns).alias("hit"))
    asked = requests.select(F.col(request_id).alias("_request"), F.col("uri").alias("_wanted"), F.col("at").alias("_at"))
    both = asked.join(live, F.col("_wanted") == F.col("_uri"))
    apart = F.abs(_seconds(F.col("hit.date")) - _seconds(F.col("_at")))
    best = both.groupBy("_request").agg(F.min_by("hit", F.struct(apart, F.col("hit.id"))).alias("hit"))
    return best.select(F.col("_request").alias(request_id), "hit.*")


def first_capture_rank(records: DataFrame) -> DataFrame:
    """Each record with its place among the captures of its URL, by date, then id."""
    return records.withColumn("place", F.row_number().over(Window.partitionBy("uri").orderBy("date", "id")))
