"""Queries: CDX, WARC, layout, rendering, changes to the index, dictionaries, ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.checkpoint import materialise, shared_dir
from tidemark.functions.scalars import little_endian_u32
from tidemark.operators import mutations
from tidemark.operators.dictionary import compressed, rebuild, sample_records, train_dictionary
from tidemark.operators.layout import assign_files, file_numbers, read_order, running_offsets, warc_filename
from tidemark.operators.render import gather_headers, render, serialise
from tidemark.plans.views import CAPTURES, KEYED, captures, dated, query, shown, values
from tidemark.sources.cdx import FIELDS, format_line, from_records, parse_lines, stop_on_bad
from tidemark.sources.repository import dictionary_names, slice_raw
from tidemark.sources.warc import read_warc, write_warc


def _uuid(df: DataFrame, tag: str) -> str:
    import uuid

    return f"{shared_dir(df.sparkSession)}/tidemark/{tag}-{uuid.uuid4().hex}"


def _cdx(rows: DataFrame) -> DataFrame:
    """CDX lines of captures: collection, line_no, line."""
    fields = dict(zip(FIELDS, (F.when(F.col("id") % 7 != 0, F.col("uri")), F.col("type"), F.col("identifier"), F.date_format("date", "yyyyMMddHHmmss"),
        F.concat(F.lit("records."), (F.col("id") % 5).cast("string"), F.lit(".warc")), F.col("id") * 100, F.col("raw_size"))))
    return rows.select("collection", F.col("id").alias("line_no"), format_line(fields).alias("line"))


_LINE = """coalesce(CASE WHEN id % 7 <> 0 THEN uri END, '-') || ' ' || type || ' ' || identifier || ' ' || strftime(date, '%Y%m%d%H%M%S') || ' records.' || (id % 5) || '.warc ' || (id * 100) || ' ' || raw_size"""


@query(f"WITH {CAPTURES} SELECT collection, id AS line_no, {_LINE} AS line FROM captures")
def cdx_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cdx(captures(spark, sf_dir))


@query(f"""WITH {CAPTURES} SELECT id AS line_no, CASE WHEN id % 7 <> 0 THEN uri END AS url, type, identifier AS id, strftime(date, '%Y%m%d%H%M%S') AS date,
'records.' || (id % 5) || '.warc' AS file, CAST(id * 100 AS VARCHAR) AS "offset", raw_size FROM captures""")
def cdx_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_lines(_cdx(captures(spark, sf_dir))).select("line_no", *FIELDS)


LINES = (
    "('a',1,'http://x/ response urn:1 20240101000000 records.0.warc 0 10'),('a',2,'- warcinfo urn:2 20240101000000 - - -'),('a',3,'broken line'),('a',4,'http://y/ response urn:3 20240101000000 records.0.warc 10 5'),"
    "('b',1,'http://x/ response urn:4 20240101000000 records.1.warc x 10'),('b',2,'http://x/ response urn:5 20240101000000 records.0.warc 7 1 more'),('c',1,'http://z/ response urn:6 20240101000000 records.1.warc 7 size'),('d',1,'- - - - - - 3')"
)


@query(f"""WITH lines AS (SELECT * FROM (VALUES {LINES}) t(path, line_no, line)), parts AS (SELECT *, string_split(line, ' ') AS p FROM lines),
marked AS (SELECT *, len(p) <> 7 OR (p[7] <> '-' AND TRY_CAST(p[7] AS BIGINT) IS NULL) AS bad FROM parts),
firsts AS (SELECT path, min(line_no) AS first FROM marked WHERE bad GROUP BY path)
SELECT m.path, line_no, p[3] AS id, nullif(p[1], '-') AS url, TRY_CAST(nullif(p[6], '-') AS BIGINT) AS "offset", TRY_CAST(nullif(p[7], '-') AS BIGINT) AS raw_size
FROM marked m LEFT JOIN firsts f ON m.path = f.path WHERE first IS NULL OR line_no < first""")
def cdx_stop_on_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = stop_on_bad(parse_lines(values(spark, LINES, "path, line_no, line")))
    return good.select("path", "line_no", "id", "url", F.expr("try_cast(offset AS BIGINT)").alias("offset"), "raw_size")


_FILES = f"""WITH {CAPTURES}, lines AS (SELECT id AS line_no, 'records.' || ((id * 7 + 3) % 5) || '.warc' AS file, id * 100 AS "offset" FROM captures),
firsts AS (SELECT file, min(line_no) AS first_line FROM lines GROUP BY file), ids AS (SELECT *, CAST(row_number() OVER (ORDER BY first_line) - 1 AS INTEGER) AS file_id FROM firsts)"""


def _file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("records."), ((F.col("id") * 7 + 3) % 5).cast("string"), F.lit(".warc"))
    return captures(spark, sf_dir).select(F.col("id").alias("line_no"), name.alias("file"), (F.col("id") * 100).alias("offset"))


@query(f"{_FILES} SELECT * FROM ids")
def cdx_first_seen_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_numbers(_file_lines(spark, sf_dir))


@query(f'{_FILES} SELECT l.file, line_no, "offset", file_id FROM lines l JOIN ids i ON l.file = i.file')
def rebuild_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_order(_file_lines(spark, sf_dir)).select("file", "line_no", "offset", "file_id")


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("source").alias("collection"), F.col("doc_id").alias("id"), F.octet_length("text").cast("bigint").alias("raw_size"))


@query("SELECT source AS collection, doc_id AS id, strlen(text) AS raw_size, CAST(coalesce(sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM documents")
def layout_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return running_offsets(_sizes(spark, sf_dir))


def _split_sql(test: str) -> str:
    return f"""WITH RECURSIVE rows_ AS (SELECT source, doc_id, strlen(text) AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents),
packed AS (SELECT source, doc_id, size, r, CAST(0 AS BIGINT) AS file_no, CAST(0 AS BIGINT) AS "offset" FROM rows_ WHERE r = 1 UNION ALL
SELECT n.source, n.doc_id, n.size, n.r, CASE WHEN p."offset" + p.size + n.size {test} 20000 THEN p.file_no + 1 ELSE p.file_no END, CASE WHEN p."offset" + p.size + n.size {test} 20000 THEN 0 ELSE p."offset" + p.size END
FROM packed p JOIN rows_ n ON n.source = p.source AND n.r = p.r + 1)
SELECT source AS collection, doc_id AS id, size AS raw_size, file_no, "offset" FROM packed"""


@query(_split_sql(">="))
def layout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_files(_sizes(spark, sf_dir), 20_000)


@query(_split_sql(">"))
def layout_split_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_files(_sizes(spark, sf_dir), 20_000, inclusive=False)


NAMES = "(0,7,'zstd'),(1,NULL,'zstd'),(2,7,NULL),(3,NULL,NULL)"


@query(f"SELECT n, 'records.' || n || coalesce('.' || d, '') || '.warc' || coalesce('.' || c, '') AS filename FROM (VALUES {NAMES}) t(n, d, c)")
def warc_filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(spark, NAMES, "n, d, c").select("n", warc_filename(F.col("n"), F.col("d"), F.col("c")).alias("filename"))


def _warc(rows: DataFrame) -> DataFrame:
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), F.array(v).alias("value"))
    headers = F.map_from_entries(F.array(
        entry("WARC-Type", F.col("type")), entry("WARC-Record-ID", F.concat(F.lit("<"), F.col("identifier"), F.lit(">"))),
        entry("WARC-Date", F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss'Z'")), entry("WARC-Target-URI", F.col("uri")), entry("Content-Type", F.lit("text/html")),
    ))
    return rows.select("*", headers.alias("headers"))


_HEAD = """'WARC/1.1' || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'WARC-Date: ' || strftime(date, '%Y-%m-%dT%H:%M:%SZ') || chr(13) || chr(10) || 'WARC-Record-ID: <' || identifier || '>' || chr(13) || chr(10)
|| 'WARC-Target-URI: ' || uri || chr(13) || chr(10) || 'WARC-Type: ' || type || chr(13) || chr(10) || 'Content-Length: ' || raw_size || chr(13) || chr(10) || chr(13) || chr(10)"""
_WHOLE = f"{_HEAD} || body || chr(13) || chr(10) || chr(13) || chr(10)"


@query(f"WITH {CAPTURES} SELECT id, strlen({_WHOLE}) AS size, md5({_WHOLE}) AS digest FROM captures")
def warc_serialize(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _warc(captures(spark, sf_dir)).select("id", serialise(F.col("headers"), F.col("body")).alias("data"))
    return data.select("id", F.octet_length("data").cast("bigint").alias("size"), F.md5("data").alias("digest"))


PAIRS = "(1,0,'WARC-Type','a'),(1,1,'WARC-Type','response'),(1,2,'X','1'),(1,3,'X','2'),(1,4,'Content-Length','9'),(2,0,'WARC-Date','d1'),(2,1,'WARC-Date','d0'),(2,2,'x','3')"


@query("SELECT * FROM (VALUES (1, 'WARC-Type', 'response'), (1, 'X', '1|2'), (2, 'WARC-Date', 'd0'), (2, 'x', '3')) t(record_id, key, vals)")
def warc_header_multimap(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = gather_headers(values(spark, PAIRS, "record_id, pos, key, value"))
    return made.select("record_id", F.explode("headers").alias("key", "v")).select("record_id", "key", F.array_join("v", "|").alias("vals"))


def _render(name: str, flags: str, kind: str, data: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = render(_warc(captures(spark, sf_dir)).withColumn("raw", F.col("body").cast("binary")).withColumn("dict_id", F.lit(None).cast("bigint")), flags)
        head = F.try_element_at(F.try_element_at("http_headers", F.lit("Warc-Header-WARC-Type")), F.lit(1))
        return rows.select("id", "content_type", F.md5("response").alias("digest"), head.alias("header_type"))

    run.__name__ = name
    query(f"WITH {CAPTURES} SELECT id, {kind} AS content_type, md5({data}) AS digest, {'NULL' if 'r' in flags else 'type'} AS header_type FROM captures")(run)


_render("record_render_plain", "", "'text/html'", "body")
_render("record_render_h", "h", "'application/warc'", _WHOLE)
_render("record_render_r", "r", "NULL", "body")
_render("record_render_d", "d", "'application/octet-stream'", "body")
_render("record_render_hd", "hd", "'application/octet-stream'", _WHOLE)


@query("SELECT page_id, hex(encode(html)[CAST(page_id % 50 + 1 AS INTEGER):CAST(page_id % 50 + 40 AS INTEGER)]) AS part FROM pages")
def raw_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", F.hex(slice_raw(F.col("html").cast("binary"), F.col("page_id") % 50, F.lit(40))).alias("part"))


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures(spark, sf_dir).select("id", "flags", "collection", F.when(F.col("id") % 3 == 0, F.lit(5)).cast("bigint").alias("dict_id"), F.when(F.col("id") % 3 == 0, F.lit("zstd")).alias("dict_type"))


_MARKED = f"{CAPTURES}, marked AS (SELECT id, flags, collection, CAST(CASE WHEN id % 3 = 0 THEN 5 END AS BIGINT) AS dict_id, CASE WHEN id % 3 = 0 THEN 'zstd' END AS dict_type FROM captures)"


@query(f"WITH {_MARKED} SELECT id, CASE WHEN collection = 'web-1' AND dict_id = 5 AND dict_type = 'zstd' THEN flags | 1 ELSE flags END AS flags FROM marked")
def activate_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutations.activate(_marked(spark, sf_dir), "web-1", 5, "zstd").select("id", "flags")


@query(f"WITH {_MARKED} SELECT * FROM marked WHERE NOT (collection = 'web-1' AND dict_id IS NULL AND dict_type IS NULL)")
def delete_by_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutations.delete_by_dictionary(_marked(spark, sf_dir), "web-1")


@query(f"WITH {_MARKED} SELECT * FROM marked WHERE collection <> 'web-2'")
def delete_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutations.delete_collection(_marked(spark, sf_dir), "web-2")


MANIFESTS = "('u1','web-0',NULL,3,NULL),('u2','web-1','zstd',3,5),('u3','web-2','zstd',3,NULL),('u4','web-3','gzip',3,5),(NULL,'x',NULL,3,NULL)"


@query(f"SELECT uuid, slug FROM (VALUES {MANIFESTS}) t(uuid, slug, compression, compression_level, dict_id) WHERE uuid IS NOT NULL AND (compression IS NULL OR (compression = 'zstd' AND dict_id IS NOT NULL))")
def manifest_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutations.validate_manifests(values(spark, MANIFESTS, "uuid, slug, compression, compression_level, dict_id")).select("uuid", "slug")


DICTS = "('web.5.zstd'),('news.4294967295.zstd'),('news.4294967296.zstd'),('a.b.zstd'),('a.7'),('a.b.8.zstd')"


@query(f"""SELECT name, split_part(name, '.', 1) AS dict_slug, CAST(split_part(name, '.', 2) AS BIGINT) AS dict_id FROM (VALUES {DICTS}) t(name)
WHERE len(string_split(name, '.')) = 3 AND TRY_CAST(split_part(name, '.', 2) AS UINTEGER) IS NOT NULL""")
def dict_filename_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary_names(values(spark, DICTS, "name"))


@query("SELECT page_id, CAST((page_id % 200) + 256 * ((page_id * 3) % 256) + 65536 * ((page_id * 7) % 256) + 16777216 * ((page_id * 11) % 256) AS BIGINT) AS number FROM pages")
def little_endian(spark: SparkSession, sf_dir: str) -> DataFrame:
    byte = lambda k, m=256: F.lpad(F.hex((F.col("page_id") * k) % m), 2, "0")
    data = F.unhex(F.concat(F.lit("37A430EC"), byte(1, 200), byte(3), byte(7), byte(11)))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", little_endian_u32(data).alias("number"))


_SLUGS = "('web-0','c0',NULL,NULL),('web-1','c1','zstd',5),('web-2','c2',NULL,NULL)"


@query(f"""WITH {KEYED}, slugs AS (SELECT * FROM (VALUES {_SLUGS}) t(slug, uuid, compression, dict_id)),
rows_ AS (SELECT k.*, s.*, row_number() OVER (ORDER BY collection, k.id) AS n FROM keyed k JOIN slugs s ON slug = collection)
SELECT n AS id, 1 AS flags, {shown()}, identifier, uuid AS collection, 'records.' || (id % 5) || '.warc' AS filename, id * 100 AS "offset", type, CASE WHEN id % 7 <> 0 THEN uri END AS uri, compression AS dict_type,
CAST(dict_id AS BIGINT) AS dict_id, CASE WHEN id % 7 <> 0 THEN massaged_url ELSE '' END AS massaged_url, raw_size FROM rows_""")
def index_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CDX lines of three collections as index rows; the lines of the fourth, which isn't known, are left out."""
    lines = parse_lines(_cdx(captures(spark, sf_dir))).withColumnRenamed("collection", "slug")
    return dated(mutations.index_records(lines, values(spark, _SLUGS, "slug, uuid, compression, dict_id")))


@query(f"WITH {CAPTURES} SELECT uri AS url, type, identifier AS id, strftime(date, '%Y%m%d%H%M%S') AS date, strlen({_WHOLE}) AS raw_size FROM captures")
def warc_to_cdx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as WARC files, read by the data source and shown as CDX fields."""
    rows = captures(spark, sf_dir)
    path = _uuid(rows, "warc")
    write_warc(_warc(rows).select(F.lit("").alias("path"), F.lit(0).cast("bigint").alias("offset"), "raw_size", "headers", F.col("body").cast("binary").alias("body")), path)
    return from_records(read_warc(spark, path)).select("url", "type", "id", "date", "raw_size")


@query(f"WITH {CAPTURES} SELECT identifier, uri, md5(body) AS digest FROM captures")
def warc_parse_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = captures(spark, sf_dir)
    path = _uuid(rows, "warc")
    write_warc(_warc(rows).select(F.lit("").alias("path"), F.lit(0).cast("bigint").alias("offset"), "raw_size", "headers", F.col("body").cast("binary").alias("body")), path)
    back = read_warc(spark, path)
    return back.select(F.trim(F.col("headers")["WARC-Record-ID"][0], F.lit("<>")).alias("identifier"), F.col("headers")["WARC-Target-URI"][0].alias("uri"), F.md5("body").alias("digest"))


@query("SELECT page_id, md5(html) AS digest FROM pages")
def zstd_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    samples = sample_records(pages.select(F.col("page_id").alias("id"), F.lit(1).alias("flags"), F.col("html").alias("body")))
    dictionary = train_dictionary(samples)[1]
    small = materialise(pages.select("page_id", compressed(F.col("html"), dictionary).alias("z")), "zstd")
    return small.select("page_id", F.md5(compressed(F.col("z"), dictionary, back=True)).alias("digest"))


@query(f"WITH {CAPTURES} SELECT id, flags, 5 AS dict_id, md5(body) AS digest FROM captures")
def rebuild_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All collections encoded with a new dictionary, packed anew, and read back."""
    rows = captures(spark, sf_dir)
    dictionary = train_dictionary(sample_records(rows))[1]
    old = rows.select("id", "flags", "collection", F.col("body").cast("binary").alias("raw"), "raw_size", F.lit(None).cast("string").alias("filename"), F.lit(None).cast("bigint").alias("offset"), F.lit(None).cast("bigint").alias("dict_id"), F.lit(None).cast("string").alias("dict_type"))
    fresh = materialise(rebuild(old, dictionary, 5, threshold=100_000), "rebuilt")
    return fresh.select("id", "flags", F.col("dict_id").cast("int").alias("dict_id"), F.md5(compressed(F.col("raw"), dictionary, back=True)).alias("digest"))


@query(f"WITH {CAPTURES} SELECT identifier, md5(body) AS digest FROM captures")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records as they arrive in a folder, each identifier once."""
    from tidemark.streaming.ingest import append_batches, stream_records

    rows = captures(spark, sf_dir)
    path = _uuid(rows, "arriving")
    write_warc(_warc(rows).select(F.lit("").alias("path"), F.lit(0).cast("bigint").alias("offset"), "raw_size", "headers", F.col("body").cast("binary").alias("body")), path)
    append_batches(stream_records(spark, path), f"{path}-table", f"{path}-state", once=True).awaitTermination()
    return spark.read.parquet(f"{path}-table").select("identifier", F.md5("body").alias("digest"))


@query(f"WITH {CAPTURES} SELECT id, identifier, type, uri, strftime(date, '%Y%m%d%H%M%S') AS date FROM captures")
def record_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first values of each record's headers."""
    from tidemark.functions.scalars import bare_id, cdx_date, first_header, parse_rfc3339

    h = F.col("headers")
    return _warc(captures(spark, sf_dir)).select(
        "id", bare_id(first_header(h, "WARC-Record-ID")).alias("identifier"), first_header(h, "WARC-Type").alias("type"),
        first_header(h, "WARC-Target-URI").alias("uri"), cdx_date(parse_rfc3339(first_header(h, "WARC-Date"))).alias("date"),
    )


@query(f"""WITH {CAPTURES}, slugs AS (SELECT * FROM (VALUES {_SLUGS}) t(slug, uuid, compression, dict_id))
SELECT id, uuid, dict_id FROM captures JOIN slugs ON slug = collection""")
def collection_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    slugs = values(spark, _SLUGS, "slug, uuid, compression, dict_id")
    rows = captures(spark, sf_dir)
    return rows.join(slugs, rows.collection == slugs.slug).select("id", "uuid", "dict_id")


@query(f"WITH slugs AS (SELECT * FROM (VALUES {_SLUGS}) t(slug, uuid, compression, dict_id)) SELECT slug FROM slugs WHERE dict_id IS NULL OR dict_id IN (5)")
def dictionary_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collections whose dictionary is there, or that need none."""
    slugs, known = values(spark, _SLUGS, "slug, uuid, compression, dict_id"), values(spark, "(5),(6)", "number")
    return slugs.where("dict_id IS NULL").union(slugs.join(known, slugs.dict_id == known.number, "left_semi")).select("slug")


@query("SELECT page_id, CASE WHEN url LIKE 'https:%' THEN 443 ELSE 80 END AS port FROM pages")
def default_ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.functions.urlkey import default_port

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", default_port(F.regexp_extract("url", "^([a-z]+):", 1)).alias("port"))
