"""Table shapes and constants of the archive."""

from __future__ import annotations

from pyspark.sql import types as T

#: Bit 0 of ``flags``: the record can be found.
ACTIVE = 1
#: A new file is begun where a write would bring one to this size.
SPLIT_THRESHOLD = 4_294_967_295
#: Bytes of framed records that are written at once.
PUSH_BATCH = 50_000_000
#: Bytes of records, about, that a task reads before it hands them on.
READ_BATCH = 16_000_000
#: Rows that a search returns unless it is told otherwise.
SEARCH_LIMIT = 100
DICTIONARY_SAMPLES, DICTIONARY_BYTES = 100_000, 5_000_000
#: Text form of dates in CDX lines.
CDX_DATE = "yyyyMMddHHmmss"

RECORDS = T.StructType([
    T.StructField("id", T.LongType(), False), T.StructField("flags", T.IntegerType(), False),
    T.StructField("date", T.TimestampNTZType(), False), T.StructField("identifier", T.StringType(), False),
    T.StructField("collection", T.StringType(), False), T.StructField("filename", T.StringType(), False),
    T.StructField("offset", T.LongType(), False), T.StructField("type", T.StringType(), False),
    T.StructField("uri", T.StringType()), T.StructField("dict_type", T.StringType()), T.StructField("dict_id", T.LongType()),
    T.StructField("massaged_url", T.StringType(), False), T.StructField("raw_size", T.LongType(), False),
])
ACTIONS = ("read", "write", "delete")
TOKENS = T.StructType([T.StructField("token", T.StringType(), False), T.StructField("comment", T.StringType())]
    + [T.StructField(f"{a}_perms_kind", T.ShortType(), False) for a in ACTIONS]
    + [T.StructField(f"{a}_perms", T.StringType()) for a in ACTIONS])
MANIFEST = T.StructType([
    T.StructField("uuid", T.StringType()), T.StructField("slug", T.StringType()), T.StructField("compression", T.StringType()),
    T.StructField("compression_level", T.IntegerType()), T.StructField("dict_id", T.LongType()), T.StructField("split_threshold", T.LongType()),
])
WARC = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("raw_size", T.LongType()),
    T.StructField("headers", T.MapType(T.StringType(), T.ArrayType(T.StringType()))), T.StructField("body", T.BinaryType()),
])
CDX = T.StructType([T.StructField(c, T.StringType()) for c in ("url", "type", "id", "date", "file", "offset")] + [T.StructField("raw_size", T.LongType())])
