"""Changes to the index and the collections, as tables that replace the old ones."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import parse_cdx_date
from tidemark.functions.urlkey import massage_url
from tidemark.operators.layout import running
from tidemark.schema import ACTIVE, MANIFEST, SPLIT_THRESHOLD

#: zstd's own default.
LEVEL = 3


def _of(collection: str, dict_id: int | None, dict_type: str | None) -> Column:
    """Null-safe, so that records without a dictionary can be named too."""
    return F.col("collection").eqNullSafe(F.lit(collection)) & F.col("dict_id").eqNullSafe(F.lit(dict_id).cast("bigint")) & F.col("dict_type").eqNullSafe(F.lit(dict_type).cast("string"))


def activate(records: DataFrame, collection: str, dict_id: int | None = None, dict_type: str | None = None) -> DataFrame:
    flags = F.when(_of(collection, dict_id, dict_type), F.col("flags").bitwiseOR(F.lit(ACTIVE))).otherwise(F.col("flags"))
    return records.withColumn("flags", flags.cast("int"))


def delete_by_dictionary(records: DataFrame, collection: str, dict_id: int | None = None, dict_type: str | None = None) -> DataFrame:
    return records.where(~_of(collection, dict_id, dict_type))


def delete_collection(records: DataFrame, collection: str) -> DataFrame:
    """A collection that isn't there changes nothing."""
    return records.where(~F.col("collection").eqNullSafe(F.lit(collection)))


def validate_manifests(manifests: DataFrame) -> DataFrame:
    """Manifests that can be used: not compressed, or by zstd with a dictionary's id. Others, and broken ones, are left out."""
    named = F.col("uuid").isNotNull() & F.col("slug").isNotNull()
    return manifests.where(named & (F.col("compression").isNull() | ((F.col("compression") == "zstd") & F.col("dict_id").isNotNull())))


def create_collection(collections: DataFrame, slug: str, compression: str | None = None, dict_id: int | None = None, threshold: int = SPLIT_THRESHOLD) -> tuple[DataFrame, bool]:
    """The collections with another one, and True; or as they were and False where the slug is taken."""
    if compression is not None and (compression != "zstd" or dict_id is None):
        raise ValueError("compression is zstd with a dictionary's id")
    if not collections.where(F.col("slug") == slug).isEmpty():
        return collections, False
    spark: SparkSession = collections.sparkSession
    row = spark.createDataFrame([(str(uuid.uuid4()), slug, compression, LEVEL, dict_id, threshold)], MANIFEST)
    return collections.unionByName(row), True


def index_records(lines: DataFrame, collections: DataFrame, first_id: int = 0) -> DataFrame:
    """Index rows from CDX lines (slug, line_no, and the seven fields), numbered on from ``first_id`` by slug and line.

    Lines without a date or an offset that can be read are left out. Numbers come from
    counts by slug and places within it, both added up from ranges of lines, so no task sorts a whole collection.
    """
    good = lines.join(collections.select("slug", F.col("uuid").alias("collection"), "compression", "dict_id"), "slug")
    good = good.select("*", parse_cdx_date(F.col("date")).alias("when"), F.expr("try_cast(offset AS BIGINT)").alias("at")).where("when IS NOT NULL AND at IS NOT NULL")
    sizes = good.groupBy("slug").count().select("slug", (F.coalesce(F.sum("count").over(Window.orderBy("slug").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + first_id).alias("base"))
    placed = running(good, "slug", "line_no").join(sizes, "slug").withColumnRenamed("_place", "place")
    return placed.select(
        (F.col("base") + F.col("place")).cast("bigint").alias("id"), F.lit(ACTIVE).alias("flags"), F.col("when").alias("date"), F.col("id").alias("identifier"), "collection",
        F.col("file").alias("filename"), F.col("at").alias("offset"), "type", F.col("url").alias("uri"), F.col("compression").alias("dict_type"), F.col("dict_id").cast("bigint").alias("dict_id"),
        massage_url(F.col("url")).alias("massaged_url"), F.coalesce("raw_size", F.lit(0)).cast("bigint").alias("raw_size"),
    )
