"""Queries: canonical keys, search, lookup, grep, access."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.checkpoint import shared_dir
from tidemark.functions.scalars import bare_id, cdx_date, is_active, parse_cdx_date, parse_rfc3339
from tidemark.functions.urlkey import domain_reverse, massage_url
from tidemark.operators import access
from tidemark.operators.dictionary import sample_records
from tidemark.operators.grep import as_csv_rows, grep
from tidemark.operators.lookup import by_id, first_capture_rank, nearest, nearest_batch
from tidemark.operators.search import Match, as_json, as_tsv, http_search_args, key_pattern, search, search_args
from tidemark.operators.snapshot import read_snapshot, write_snapshot
from tidemark.plans.views import CAPTURES, KEYED, captures, dated, keyed, massage_sql, query, shown, values

URLS = (
    "(1,'http://a.com:80/'),(2,'https://a.com:443/'),(3,'http://a.com:8080/x'),(4,'http://10.0.0.1/p'),(5,'https://b.a.com.:8443/x?'),"
    "(6,'http://u:pw@A.Example.COM/Path?b=2&a=1&a=0#frag'),(7,'http://a.com'),(8,'http://a.com?z&y=a=b'),(9,'http://a.com/?q=a+b&r=%7Ex'),"
    "(10,'not a url'),(11,NULL),(12,'http://a.com/?a=%26&a=%2F*'),(13,'http://my_host.a.com/p-q/r.html'),(14,'HTTPS://X.org/%41'),(15,'')"
)


@query(f"WITH {KEYED} SELECT id, uri, massaged_url FROM keyed")
def url_massage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed(spark, sf_dir).select("id", "uri", "massaged_url")


@query(f"WITH src AS (SELECT * FROM (VALUES {URLS}) t(n, url)), {massage_sql('src', 'keyed', 'url')} SELECT n, url, massaged_url FROM keyed")
def url_massage_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(spark, URLS, "n, url").select("n", "url", massage_url(F.col("url")).alias("massaged_url"))


@query("""SELECT page_id, regexp_extract(url, '://([^/?#:]+)', 1) AS host,
  array_to_string(list_reverse(string_split(trim(regexp_extract(url, '://([^/?#:]+)', 1), '.'), '.')), ',') AS reversed FROM pages""")
def domain_reversed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.regexp_extract("url", "://([^/?#:]+)", 1).alias("host"))
    return pages.select("page_id", "host", domain_reverse(F.col("host")).alias("reversed"))


PORTED = f"""ported AS (SELECT * REPLACE (regexp_replace(uri, '^(https?://[^/?#:]*)', '\\1:' || (8078 + page_id % 4)) AS uri) FROM captures),
{massage_sql('ported', 'keyed')}"""


@query(f"WITH {CAPTURES}, {PORTED} SELECT id, uri, massaged_url FROM keyed WHERE regexp_matches(massaged_url, '(?s){key_pattern(port=8080)}')")
def search_port(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs with the ports 8078 to 8081, searched for one of them."""
    ported = F.regexp_replace("uri", F.lit("^(https?://[^/?#:]*)"), F.concat(F.lit("$1:"), (F.col("page_id") % 4 + 8078).cast("string")))
    rows = captures(spark, sf_dir).withColumn("uri", ported).withColumn("massaged_url", massage_url(F.col("uri")))
    return search(rows, port=8080, limit=None).select("id", "uri", "massaged_url")


def _bound(name: str, how: dict) -> None:
    """A search whose arguments come from a binding."""
    _search(name, **{k: v for k, v in how.items() if v is not None})


def _search(name: str, limit: int | None = None, **how) -> None:
    pattern = "(?s)" + key_pattern(**how).replace("'", "''")
    last = "" if limit is None else f" ORDER BY id LIMIT {limit}"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search(keyed(spark, sf_dir), limit=limit, **how).select("id", "uri", "massaged_url")

    run.__name__ = name
    query(f"WITH {KEYED} SELECT id, uri, massaged_url FROM keyed WHERE regexp_matches(massaged_url, '{pattern}'){last}")(run)


_search("search_domain", host=Match("example.org"))
_search("search_domain_path", host=Match("example.org"), path=Match("/en"))
_search("search_host_exact", host=Match("m.therou.example.com", True))
_search("search_path_prefix", path=Match("/es/"))
_search("search_path_exact", host=Match("example.com"), path=Match("/en/853/", True))
_search("search_all_limit", limit=100)
_search("search_strict", host=Match("example.org"), path=Match("/en"), mode="strict")


# a host beats a domain and an exact path a path; of a request's parameters the last holds
_bound("search_arguments", search_args(host="m.therou.example.com", domain="example.org", path="/", exact_path=None))
_bound("search_request", http_search_args([("host", "nobody.example"), ("domain", "example.org"), ("path_exact", "/none"), ("path", "/en"), ("limit", "3")]))

#: The index stored as snapshots, sorted by key; patterns are those of the keys by hand, not of ``key_pattern``.
STORED = f"WITH {KEYED} SELECT id, massaged_url FROM keyed WHERE starts_with(massaged_url, 'org,example') AND (massaged_url[12] = ',' OR massaged_url[12] = ')' OR massaged_url[12] = ':')"


@query(STORED)
def search_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A strict search over a stored index, whose row groups are passed over by the key's beginning."""
    path = f"{shared_dir(spark)}/tidemark/searched-{uuid.uuid4().hex}"
    write_snapshot(keyed(spark, sf_dir).select("id", "massaged_url"), path, sort_by="massaged_url")
    return search(read_snapshot(spark, path), Match("example.org"), mode="strict", limit=None).select("id", "massaged_url")


@query(f"WITH {KEYED} SELECT type, identifier, uri, {shown()}, collection FROM keyed WHERE regexp_matches(massaged_url, '{key_pattern(Match("example.net"))}')")
def search_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dated(as_tsv(search(keyed(spark, sf_dir), Match("example.net"), limit=None)))


@query(f"""WITH {KEYED} SELECT id, CAST(json_object('uri', uri, 'identifier', identifier, 'type', type, 'collection', collection, 'date', strftime(date, '%Y-%m-%d %H:%M:%S')) AS VARCHAR) AS json
FROM keyed WHERE regexp_matches(massaged_url, '{key_pattern(Match("example.org"))}')""")
def search_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_json(search(keyed(spark, sf_dir), Match("example.org"), limit=None))


@query(f"WITH {CAPTURES} SELECT id, identifier, uri, {shown()} FROM captures WHERE flags & 1 = 1 AND identifier = 'urn:cap:40'")
def get_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dated(by_id(captures(spark, sf_dir), "urn:cap:40").select("id", "identifier", "uri", "date"))


@query(f"""WITH {CAPTURES} SELECT id, uri, {shown()}, type FROM captures WHERE flags & 1 = 1 AND type <> 'request' AND uri = 'https://thther.example.org/en/685'
ORDER BY abs(epoch(date) - epoch(TIMESTAMP '2024-01-20 06:00:00')), id LIMIT 1""")
def get_by_uri_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dated(nearest(captures(spark, sf_dir), "https://thther.example.org/en/685", dt.datetime(2024, 1, 20, 6)).select("id", "uri", "date", "type"))


@query(f"""WITH {CAPTURES}, asked AS (SELECT page_id AS request_id, url, TIMESTAMP '2024-01-15' + to_hours(page_id * 5) AS moment FROM pages),
ranked AS (SELECT request_id, id, date, type, row_number() OVER (PARTITION BY request_id ORDER BY abs(epoch(date) - epoch(moment)), id) AS r
FROM asked JOIN captures ON uri = url WHERE flags & 1 = 1 AND type <> 'request')
SELECT request_id, id, {shown()}, type FROM ranked WHERE r = 1""")
def nearest_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    asked = pages.select(F.col("page_id").alias("request_id"), F.col("url").alias("uri"), F.expr("TIMESTAMP_NTZ'2024-01-15 00:00:00' + make_dt_interval(0, CAST(page_id * 5 AS INT))").alias("at"))
    return dated(nearest_batch(captures(spark, sf_dir).select("id", "date", "type", "uri", "flags"), asked).select("request_id", "id", "date", "type"))


@query("""WITH firsts AS (SELECT user_id, min(ts) AS moment FROM events GROUP BY user_id),
ranked AS (SELECT f.user_id, e.event_id, row_number() OVER (PARTITION BY f.user_id ORDER BY abs(epoch_us(e.ts) - epoch_us(f.moment + INTERVAL 3 DAY)), e.event_id) AS r FROM firsts f JOIN events e ON e.user_id = f.user_id)
SELECT user_id, event_id FROM ranked WHERE r = 1""")
def nearest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's event nearest to three days after their first one."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), F.col("ts").alias("date"), F.col("user_id").alias("uri"), F.lit("event").alias("type"), F.lit(1).alias("flags"))
    asked = events.groupBy("uri").agg((F.min("date") + F.expr("INTERVAL 3 DAYS")).alias("at")).select(F.col("uri").alias("request_id"), "uri", "at")
    return nearest_batch(events, asked).select(F.col("request_id").alias("user_id"), F.col("id").alias("event_id"))


@query(f"WITH {CAPTURES} SELECT id, flags FROM captures WHERE flags & 1 = 1")
def active_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures(spark, sf_dir).where(is_active(F.col("flags"))).select("id", "flags")


@query(f"WITH {CAPTURES} SELECT id, uri, {shown()}, row_number() OVER (PARTITION BY uri ORDER BY date, id) AS place FROM captures")
def capture_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dated(first_capture_rank(captures(spark, sf_dir)).select("id", "uri", "date", F.col("place").cast("bigint").alias("place")))


@query(f"WITH {CAPTURES} SELECT id, identifier FROM captures WHERE flags & 1 = 1 AND collection = 'web-1' ORDER BY md5(CAST(id AS VARCHAR)), id LIMIT 50")
def sample_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_records(captures(spark, sf_dir), "web-1", 50).select("id", "identifier")


def _grep_sql(patterns: list[str]) -> str:
    each = " UNION ALL ".join(
        f"SELECT '{p}' AS pattern, doc_id, source, regexp_extract_all(text, '{p}') AS ms, string_split_regex(text, '{p}') AS ps FROM documents WHERE regexp_matches(text, '{p}')" for p in patterns
    )
    return f"""WITH found AS ({each}), flat AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM found),
placed AS (SELECT *, strlen(array_to_string(ps[1:i], '')) + strlen(array_to_string(ms[1:i - 1], '')) AS s FROM flat)
SELECT pattern, ms[i] AS match, s AS start, s + strlen(ms[i]) AS "end", source AS collection, 'doc-' || doc_id AS identifier, '' AS uri FROM placed"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("source").alias("collection"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("identifier"), F.lit(None).cast("string").alias("uri"), F.col("text").alias("body"))


def _grep(name: str, patterns: list[str]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return as_csv_rows(grep(_documents(spark, sf_dir), patterns))

    run.__name__ = name
    query(_grep_sql(patterns))(run)


_grep("grep_single", ["[0-9]+"])
_grep("grep_multi", ["[0-9]{4}", "License", "[a-z]+@[a-z]+"])
_grep("grep_multibyte", ["é[a-z]+"])

ASKED = "('k1','web-1'),('k1','web-2'),('k2','web-1'),('k2','news'),('k3','web-9'),('k3','news'),('k4','web-1'),('k5','web-1'),('nobody','web-1'),('k6','web-1'),('k7','web-1')"
TOKENS = (
    "('k1','all',1,0,0,'','',''),('k2','some',2,2,0,'web-1,web-3','web-1',''),('k3','start',3,0,3,'web-','','w'),('k4','none',0,1,1,'','',''),"
    "('k5','odd',9,0,0,'web-1','',''),('k6','empty list',2,0,0,'','',''),('k7','empty prefix',3,0,0,'','','')"
)
_NAMES = "token, comment, read_perms_kind, write_perms_kind, delete_perms_kind, read_perms, write_perms, delete_perms"
_ALLOWED = "CASE kind WHEN 1 THEN true WHEN 2 THEN list_contains(string_split(perms, ','), slug) WHEN 3 THEN starts_with(slug, perms) ELSE false END"


def _tokens(spark: SparkSession) -> DataFrame:
    return values(spark, TOKENS, _NAMES)


def _access_sql(kind: int, perms: str) -> str:
    return f"""WITH asked AS (SELECT * FROM (VALUES {ASKED}) t(token, slug)), known AS (SELECT * FROM (VALUES {TOKENS}) t({_NAMES})),
found AS (SELECT a.token, slug, CASE WHEN k.token IS NULL THEN {kind} ELSE read_perms_kind END AS kind, CASE WHEN k.token IS NULL THEN '{perms}' ELSE read_perms END AS perms
FROM asked a LEFT JOIN known k ON a.token = k.token) SELECT token, slug, {_ALLOWED} AS allowed FROM found"""


@query(_access_sql(1, ""))
def perm_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.check(values(spark, ASKED, "token, slug"), _tokens(spark))


@query(_access_sql(3, "news"))
def perm_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = access.Config(anonymous={"read": ("prefix", "news"), "write": ("none", ""), "delete": ("none", "")})
    return access.check(values(spark, ASKED, "token, slug"), _tokens(spark), config)


@query(f"""WITH known AS (SELECT * FROM (VALUES {TOKENS}) t({_NAMES})) SELECT token, comment,
  {", ".join(f"CASE {a}_perms_kind WHEN 1 THEN 'any' WHEN 2 THEN 'list' WHEN 3 THEN 'prefix' ELSE 'none' END || '(' || {a}_perms || ')' AS {a}" for a in ("read", "write", "delete"))} FROM known""")
def token_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.list_tokens(_tokens(spark))


@query("""SELECT * FROM (VALUES ('all', 'any()', 'list(web-1,web-3)', 'prefix(w)', true), ('first wins', 'any()', 'list()', 'none()', true), ('nothing', 'none()', 'none()', 'none()', true)) t(comment, read, write, delete, is_uuid)""")
def token_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New tokens: any beats a list, a list a prefix."""
    made = access.new_token(spark, "all", read_any=True, write_list=["web-1", "web-3"], delete_prefix="w")
    made = made.union(access.new_token(spark, "first wins", read_any=True, read_list=["x"], write_list=[], write_prefix="y")).union(access.new_token(spark, "nothing"))
    shown_ = access.list_tokens(made)
    return shown_.select("comment", "read", "write", "delete", F.col("token").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$").alias("is_uuid"))


@query(f"SELECT token, comment FROM (VALUES {TOKENS}) t({_NAMES}) WHERE token <> 'k3'")
def token_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.delete_token(_tokens(spark), "k3").select("token", "comment")


@query(f"WITH {CAPTURES} SELECT id, collection FROM captures WHERE collection IN ('web-1', 'web-3')")
def readable_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = captures(spark, sf_dir)
    names = values(spark, "('web-0','web-0'),('web-1','web-1'),('web-2','web-2'),('web-3','web-3')", "uuid, slug")
    return access.readable(rows, names, _tokens(spark), "k2").select("id", "collection")


DATES = "(1,'20240131235959','2024-01-31T23:59:59Z','<urn:a>'),(2,'2024','2024-01-31','urn:b'),(3,'20241301000000','2024-02-30T00:00:00Z','<<c>'),(4,NULL,NULL,NULL),(5,'20240229000001','2024-02-29T01:00:01Z','>d<')"


@query(f"""SELECT n, strftime(CASE WHEN regexp_full_match(a, '[0-9]{{14}}') THEN try_strptime(a, '%Y%m%d%H%M%S') END, '%Y%m%d%H%M%S') AS cdx,
strftime(try_strptime(b, '%Y-%m-%dT%H:%M:%SZ'), '%Y%m%d%H%M%S') AS rfc, trim(c, '<>') AS bare FROM (VALUES {DATES}) t(n, a, b, c)""")
def scalar_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, DATES, "n, a, b, c")
    return rows.select("n", cdx_date(parse_cdx_date(F.col("a"))).alias("cdx"), cdx_date(parse_rfc3339(F.col("b"))).alias("rfc"), bare_id(F.col("c")).alias("bare"))
