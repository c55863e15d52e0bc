"""Archive records derived from the driver's tables, for Spark and for the oracle alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.urlkey import massage_url

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function as a query by its name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as a response, a request and a metadata record."""
    return _captures(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _captures(pages: DataFrame) -> DataFrame:
    pages = pages.select("*", F.explode(F.array(*map(F.lit, range(3)))).alias("k"))
    more = [c for c in ("massaged_url",) if c in pages.columns]
    return pages.select(
        (F.col("page_id") * 3 + F.col("k")).alias("id"),
        F.when((F.col("page_id") * 3 + F.col("k")) % 10 != 9, 1).otherwise(0).alias("flags"),
        F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, CAST(page_id * 37 + k * 1009 AS INT))").alias("date"),
        F.concat(F.lit("urn:cap:"), (F.col("page_id") * 3 + F.col("k")).cast("string")).alias("identifier"),
        F.concat(F.lit("web-"), (F.col("page_id") % 4).cast("string")).alias("collection"),
        F.element_at(F.array(*map(F.lit, ("response", "request", "metadata"))), ((F.col("k") + F.col("page_id")) % 3 + 1).cast("int")).alias("type"),
        F.col("url").alias("uri"), F.octet_length("html").cast("bigint").alias("raw_size"), F.col("html").alias("body"), "page_id", *more,
    )


CAPTURES = """captures AS (SELECT p.page_id * 3 + k AS id, CAST((p.page_id * 3 + k) % 10 <> 9 AS INTEGER) AS flags,
  TIMESTAMP '2024-01-01' + to_hours(p.page_id * 37 + k * 1009) AS date, 'urn:cap:' || (p.page_id * 3 + k) AS identifier,
  'web-' || (p.page_id % 4) AS collection, ['response', 'request', 'metadata'][(k + p.page_id) % 3 + 1] AS type,
  url AS uri, strlen(html) AS raw_size, html AS body, page_id FROM pages p, (VALUES (0), (1), (2)) t(k))"""


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures with the keys of their URLs, which are made before a page becomes several captures."""
    return _captures(spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("massaged_url", massage_url(F.col("url"))))


def massage_sql(source: str, out: str, url: str = "uri") -> str:
    part = lambda k: f"url_decode(replace(regexp_extract(p, '^([^=]*)=?(.*)$', {k}), '+', ' '))"
    return f"""{out}_parts AS (SELECT *, regexp_extract({url}, '^([Hh][Tt][Tt][Pp][Ss]?)://(?:[^/?#@]*@)?([^/?#: ]+)(?::([0-9]*))?([^?# ]*)(?:\\?([^# ]*))?(?:#.*)?$',
    ['scheme', 'host', 'port', 'path', 'query']) AS u FROM {source}),
{out}_pairs AS (SELECT *, array_to_string([x.k || '=' || x.v for x in list_sort([{{'k': {part(1)}, 'v': url_encode({part(2)})}}
    for p in string_split(u.query, '&') if p <> ''])], '&') AS pairs FROM {out}_parts),
{out} AS (SELECT * EXCLUDE (u, pairs), CASE WHEN u.host IS NULL OR u.host = '' THEN '' ELSE
    CASE WHEN regexp_full_match(u.host, '[0-9.]+') THEN u.host ELSE array_to_string(list_reverse(string_split(trim(lower(u.host), '.'), '.')), ',') END
    || CASE WHEN u.port = '' OR TRY_CAST(u.port AS INTEGER) = CASE lower(u.scheme) WHEN 'http' THEN 80 ELSE 443 END THEN '' ELSE ':' || TRY_CAST(u.port AS INTEGER) END
    || ')' || CASE WHEN u.path = '' THEN '/' ELSE u.path END || CASE WHEN coalesce(pairs, '') = '' THEN '' ELSE '?' || pairs END END AS massaged_url FROM {out}_pairs)"""


KEYED = f"{CAPTURES},\n{massage_sql('captures', 'keyed')}"


def values(spark: SparkSession, rows: str, names: str) -> DataFrame:
    """A small table from the same VALUES that the oracle reads."""
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({names})")


def dated(df: DataFrame, *columns: str) -> DataFrame:
    """Times as text, which both engines write alike."""
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in columns or ("date",)})


def shown(c: str = "date") -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c.split('.')[-1]}"
