"""Queries: archives on disk, from empty folders to rebuilt collections; formats of files."""

from __future__ import annotations

import gzip
import lzma
import os
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.checkpoint import materialise, shared_dir
from tidemark.functions.scalars import bare_id
from tidemark.operators.access import new_token
from tidemark.operators.archive import Archive
from tidemark.operators.render import serialise
from tidemark.plans.files import _HEAD, _WHOLE, _warc
from tidemark.plans.views import CAPTURES, captures, dated, massage_sql, query, shown, values
from tidemark.schema import MANIFEST, RECORDS, TOKENS
from tidemark.sources.repository import init_layout, read_collections
from tidemark.sources.warc import read_warc, write_warc
from tidemark.streaming.ingest import push_stream

#: Collections of the archives below: those that the captures name.
SLUGS = ("web-0", "web-1", "web-2", "web-3")
#: A few files for each collection.
THRESHOLD = 200_000


def _path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/tidemark/{tag}-{uuid.uuid4().hex}"


def _archive(spark: SparkSession, tag: str, threshold: int = THRESHOLD) -> Archive:
    made = Archive.init(spark, _path(spark, tag))
    for slug in SLUGS:
        made.create_collection(slug, threshold=threshold, warcinfo=False)
    return made


def _push_all(archive: Archive, rows: DataFrame) -> DataFrame:
    """Each collection's records pushed to it; the CDX fields with slug."""
    out = None
    for slug in SLUGS:
        pushed = archive.push(slug, rows.where(F.col("collection") == slug).select("id", "headers", F.col("body").cast("binary").alias("body"))).withColumn("slug", F.lit(slug))
        out = pushed if out is None else out.union(pushed)
    return out


def _named(archive: Archive, rows: DataFrame) -> DataFrame:
    """Index rows with the collection's slug in place of its uuid."""
    slugs = archive.collections().select(F.col("uuid").alias("_uuid"), "slug")
    return rows.join(F.broadcast(slugs), F.col("collection") == F.col("_uuid")).drop("_uuid", "collection").withColumnRenamed("slug", "collection")


_CREATED = "('plain',CAST(NULL AS VARCHAR),false,4294967295),('packed','zstd',true,4294967295),('small',NULL,false,1000)"


@query(f"""SELECT slug, compression, 3 AS compression_level, has_dictionary, threshold AS split_threshold, 'warcinfo' AS type, 'records.1.' AS file_begins, true AS holds_manifest, slug <> 'plain' AS second_try
FROM (VALUES {_CREATED}) t(slug, compression, has_dictionary, threshold)""")
def collection_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collections with and without a dictionary; a taken slug changes nothing, a dictionary that isn't there is an error."""
    archive = Archive.init(spark, _path(spark, "archive"))
    archive.create_collection("plain")
    source = captures(spark, sf_dir)
    archive.push("plain", _warc(source).select("id", "headers", F.col("body").cast("binary").alias("body")))
    number = archive.train_dictionary("plain")
    again = {"plain": archive.create_collection("plain", number), "packed": archive.create_collection("packed", number), "small": archive.create_collection("small", threshold=1000)}
    try:
        archive.create_collection("none", number + 1)
    except KeyError:
        pass
    first = archive.fetch(_info(archive)).select("collection", "type", "filename", F.col("body").cast("string").alias("body"))
    all_ = archive.collections().join(first, F.col("uuid") == F.col("collection"))
    tried = F.element_at(F.create_map(*[F.lit(x) for kv in again.items() for x in kv]), F.col("slug"))
    return all_.select("slug", "compression", "compression_level", F.col("dict_id").isNotNull().alias("has_dictionary"), "split_threshold", "type", F.regexp_extract(F.col("filename"), r"(records\.[0-9]+\.)", 1).alias("file_begins"), F.col("body").contains(F.col("uuid")).alias("holds_manifest"), tried.alias("second_try"))


def _info(archive: Archive) -> DataFrame:
    return archive.records().where("type = 'warcinfo'")


@query(f"SELECT to_json({{'slug': slug, 'compression_level': 3, 'split_threshold': {THRESHOLD}}}) AS json FROM (VALUES {', '.join(f'({s!r})' for s in SLUGS)}) t(slug)")
def collection_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All manifests of an archive as JSON (the uuid, which is random, taken out)."""
    rows = _archive(spark, "archive").collections()
    return rows.select(F.to_json(F.struct(*[c for c in ("slug", "compression", "compression_level", "dict_id", "split_threshold")])).alias("json"))


_ORDER = "row_number() OVER (PARTITION BY collection ORDER BY CASE WHEN type = 'response' THEN 0 ELSE 1 END, id)"
_PACKED = f"""WITH RECURSIVE {CAPTURES}, sized AS (SELECT id, collection, identifier, strlen({_WHOLE}) AS size, {_ORDER} AS r FROM captures),
packed AS (SELECT collection, identifier, size, r, CAST(1 AS BIGINT) AS file_no, CAST(0 AS BIGINT) AS pos FROM sized WHERE r = 1 UNION ALL
SELECT n.collection, n.identifier, n.size, n.r, CASE WHEN p.pos + p.size + n.size >= {THRESHOLD} THEN p.file_no + 1 ELSE p.file_no END, CASE WHEN p.pos + p.size + n.size >= {THRESHOLD} THEN 0 ELSE p.pos + p.size END
FROM packed p JOIN sized n ON n.collection = p.collection AND n.r = p.r + 1)"""


@query(f"{_PACKED} SELECT collection, identifier, r AS id, 'records.' || file_no || '.warc' AS filename, pos AS \"offset\", size AS raw_size FROM packed")
def push_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pushes to each collection, responses and then all else: the second goes on in the last file of the first."""
    archive, rows = _archive(spark, "archive"), _warc(captures(spark, sf_dir))
    _push_all(archive, rows.where("type = 'response'"))
    _push_all(archive, rows.where("type <> 'response'"))
    return _named(archive, archive.records()).select("collection", "identifier", "id", "filename", "offset", "raw_size")


_PUSHED = f"WITH {CAPTURES},\n{massage_sql('captures', 'keyed')}"


@query(f"{_PUSHED} SELECT identifier, 1 AS flags, {shown()}, collection, type, uri, massaged_url FROM keyed")
def push_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index rows that pushes leave."""
    archive = _archive(spark, "archive")
    _push_all(archive, _warc(captures(spark, sf_dir)))
    return dated(_named(archive, archive.records()).select("identifier", "flags", "date", "collection", "type", "uri", "massaged_url"))


@query(f"{_PUSHED} SELECT identifier, 1 AS flags, {shown()}, collection, type, uri, massaged_url, strlen({_WHOLE}) AS raw_size FROM keyed")
def index_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index made anew from the CDX files that pushes leave."""
    archive = _archive(spark, "archive")
    _push_all(archive, _warc(captures(spark, sf_dir)))
    return dated(_named(archive, archive.load_index()).select("identifier", "flags", "date", "collection", "type", "uri", "massaged_url", "raw_size"))


@query(f"WITH {CAPTURES} SELECT identifier AS id, uri AS url, md5(body) AS digest FROM captures")
def push_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records pushed to compressed collections, then read by file and offset out of their index."""
    archive, rows = Archive.init(spark, _path(spark, "archive")), captures(spark, sf_dir)
    archive.create_collection("all")
    archive.push("all", _warc(rows).select("id", "headers", F.col("body").cast("binary").alias("body")))
    number = archive.train_dictionary("all")
    for slug in SLUGS:
        archive.create_collection(slug, number, threshold=THRESHOLD, warcinfo=False)
    _push_all(archive, _warc(rows))
    packed = archive.fetch(archive.records().where("dict_id IS NOT NULL"))
    return packed.select(F.col("identifier").alias("id"), F.col("uri").alias("url"), F.md5("body").alias("digest"))


@query(f"WITH {CAPTURES} SELECT identifier, collection, strlen({_WHOLE}) AS raw_size, md5({_WHOLE}) AS digest FROM captures")
def raw_push(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records sent as frames of a CDX line and bytes, which are stored as they come."""
    archive, rows = _archive(spark, "archive"), _warc(captures(spark, sf_dir))
    whole = rows.select("id", "collection", "type", "identifier", "uri", F.date_format("date", "yyyyMMddHHmmss").alias("when"), serialise(F.col("headers"), F.col("body")).alias("raw"))
    line = F.concat_ws(" ", "uri", "type", "identifier", "when", F.lit("-"), F.lit("-"), F.octet_length("raw").cast("string"))
    framed = whole.select("collection", "id", F.concat(line.cast("binary"), F.lit(b"\n"), "raw").alias("frame"))
    for slug in SLUGS:
        folder = _path(spark, "frames").removeprefix("file://")
        _write_frames(framed.where(F.col("collection") == slug), folder)
        archive.push_raw(slug, folder)
    return _named(archive, archive.fetch(archive.records(), raw=True)).select("identifier", "collection", "raw_size", F.md5("raw").alias("digest"))


def _write_frames(frames: DataFrame, folder: str) -> None:
    os.makedirs(folder)

    def write(batches):
        import pyarrow as pa

        for b in batches:
            with open(f"{folder}/{uuid.uuid4().hex}.frames", "wb") as out:
                for frame in b.column("frame").to_pylist():
                    out.write(frame)
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    materialise(frames.select("frame").mapInArrow(write, "n bigint"), "frames-written")


@query(f"""WITH {CAPTURES} SELECT identifier, collection, 1 AS flags, {shown()}, type, uri, true AS has_dictionary, true AS named_by_it, md5(body) AS digest, 'zstd' AS compression, 0 AS old_files FROM captures""")
def rebuild_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collections pushed as they are, then rebuilt with a dictionary that was trained on one of them: rows, files, manifests and CDX lines are those of the new encoding."""
    archive = _archive(spark, "archive")
    _push_all(archive, _warc(captures(spark, sf_dir)))
    number = archive.train_dictionary("web-0")
    for slug in SLUGS:
        archive.rebuild(slug, number)
    manifests = archive.collections()
    old = sum(name.endswith(".warc") for r in manifests.collect() for name in os.listdir(archive.folder(r.uuid)))
    packing = manifests.select(F.col("uuid").alias("collection"), "compression", F.col("dict_id").alias("_d"))
    rows = archive.fetch(archive.load_index()).join(packing, "collection")
    named = F.split("filename", "/")[1].rlike(rf"^records\.[0-9]+\.{number}\.warc\.zstd$")
    return dated(_named(archive, rows).select("identifier", "collection", "flags", "date", "type", "uri", (F.col("dict_id") == F.col("_d")).alias("has_dictionary"), named.alias("named_by_it"), F.md5("body").alias("digest"), "compression", F.lit(old).alias("old_files")))


@query(f"{_PUSHED} SELECT identifier, 1 AS flags, {shown()}, type, uri, massaged_url, md5(body) AS digest FROM keyed")
def stream_push(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of files that arrive in a folder, pushed to a collection as a stream by a token that may write, and refused to one that may not."""
    rows, path = captures(spark, sf_dir), _path(spark, "arriving")
    write_warc(_warc(rows).select(F.lit("").alias("path"), F.lit(0).cast("bigint").alias("offset"), "raw_size", "headers", F.col("body").cast("binary").alias("body")), path)
    archive = Archive.init(spark, _path(spark, "archive"))
    archive.create_collection("all", threshold=THRESHOLD, warcinfo=False)
    tokens = new_token(spark, "writer", write_list=["all"]).union(new_token(spark, "reader", read_any=True))
    ids = {r.comment: r.token for r in tokens.collect()}
    tokens = spark.createDataFrame([(ids["writer"], "writer", 0, 2, 0, "", "all", ""), (ids["reader"], "reader", 1, 0, 0, "", "", "")], TOKENS)
    try:
        archive.push("all", _warc(rows).select("id", "headers", F.col("body").cast("binary").alias("body")), token=ids["reader"], tokens=tokens)
    except PermissionError:
        pass
    push_stream(archive, "all", path, f"{path}-state", once=True, token=ids["writer"], tokens=tokens).awaitTermination()
    return dated(archive.fetch(archive.records()).select("identifier", "flags", "date", "type", "uri", "massaged_url", F.md5("body").alias("digest")))


@query("SELECT * FROM (VALUES ('web-1', 0, 0), ('none', 1, 1)) t(slug, folders, found)")
def collection_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two collections, how many of whose folders and rows are left when one was deleted, and one that isn't there."""
    archive = Archive.init(spark, _path(spark, "archive"))
    uuids = {}
    for slug in ("web-1", "none"):
        archive.create_collection(slug)
        uuids[slug] = archive.collection(slug).uuid
    archive.delete_collection("web-1")
    archive.delete_collection("nobody")
    counts = {r.collection: r["count"] for r in archive.records().groupBy("collection").count().collect()}
    return spark.createDataFrame([(s, int(os.path.isdir(archive.folder(u))), counts.get(u, 0)) for s, u in uuids.items()], "slug string, folders int, found int")


@query("SELECT * FROM (VALUES (true, true, true, false)) t(same_bytes, listed, there, other_there)")
def dictionary_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary trained on stored records, kept, fetched by its id and listed."""
    archive = Archive.init(spark, _path(spark, "archive"))
    archive.create_collection("all", warcinfo=False)
    archive.push("all", _warc(captures(spark, sf_dir)).select("id", "headers", F.col("body").cast("binary").alias("body")))
    number = archive.train_dictionary("all")
    data = archive.dictionary(number)
    rows = archive.dictionaries().where(F.col("dict_id") == number)
    return rows.select((F.md5("bytes") == F.md5(F.lit(data))).alias("same_bytes"), (F.col("dict_slug") == "all").alias("listed"), F.lit(archive.has_dictionary(number)).alias("there"), F.lit(archive.has_dictionary(number + 1)).alias("other_there"))


@query("SELECT * FROM (VALUES ('config.json'), ('data/buffer'), ('data/dict/zstd'), ('data/repository')) t(path)")
def layout_init(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _path(spark, "layout").removeprefix("file://")
    init_layout(root)
    try:
        init_layout(root)  # not empty any more
    except FileExistsError:
        pass
    there = [os.path.relpath(os.path.join(d, n), root) for d, folders, files in os.walk(root) for n in (*folders, *files) if n in files or not os.listdir(os.path.join(d, n))]
    return spark.createDataFrame([(p,) for p in there], "path string")


@query("SELECT * FROM (VALUES ('u1', 'plain'), ('u2', 'packed')) t(uuid, slug)")
def repository_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests that can be used; broken ones, and such as ask for what isn't there, are passed over."""
    root = _path(spark, "repository").removeprefix("file://")
    texts = {
        "a": '{"uuid": "u1", "slug": "plain", "compression_level": 3, "split_threshold": 5}', "b": '{"uuid": "u2", "slug": "packed", "compression": "zstd", "dict_id": 7, "compression_level": 3, "split_threshold": 5}',
        "c": '{"uuid": "u3", "slug": "no dictionary", "compression": "zstd"}', "d": "not json", "e": '{"uuid": "u5", "slug": "other", "compression": "gzip", "dict_id": 7}', "f": '{"slug": "no uuid"}',
    }
    for name, text in texts.items():
        os.makedirs(f"{root}/{name}")
        with open(f"{root}/{name}/manifest.json", "w") as out:
            out.write(text)
    os.makedirs(f"{root}/no-manifest")
    return read_collections(spark, f"file://{root}").select("uuid", "slug")


@query("""SELECT * FROM (VALUES (0, '', true, NULL, 'first'), (1, 'response', false, '2024-01-01T00:00:00Z', 'second'), (2, '', true, NULL, '')) t(n, type, derived_id, date, body)""")
def header_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without a type, an id or a date, and one without a length, which has no body and is the last."""
    root = _path(spark, "defaults").removeprefix("file://")
    os.makedirs(root)
    with open(f"{root}/a.warc", "wb") as out:
        out.write(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nfirst\r\n\r\n")
        out.write(b"WARC/1.1\r\nWARC-Type: request\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Length: 6\r\n\r\nsecond\r\n\r\n")
        out.write(b"WARC/1.1\r\nX-Other: y\r\n\r\n")
    h = F.col("headers")
    rows = read_warc(spark, root)
    return rows.select(
        (F.when(F.col("offset") == 0, 0).when(F.col("body") == F.lit(b"second"), 1).otherwise(2)).alias("n"), h["WARC-Type"][0].alias("type"),
        bare_id(h["WARC-Record-ID"][0]).startswith("urn:sha256:").alias("derived_id"), F.try_element_at(h["WARC-Date"], F.lit(1)).alias("date"), F.col("body").cast("string").alias("body"),
    )


@query(f"WITH {CAPTURES} SELECT ending, identifier, md5(body) AS digest FROM captures, (VALUES ('gz'), ('zst'), ('xz'), ('warc')) t(ending)")
def warc_compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records out of plain files and of files compressed in three ways."""
    rows, path = captures(spark, sf_dir), _path(spark, "packed-warc")
    write_warc(_warc(rows).select(F.lit("").alias("path"), F.lit(0).cast("bigint").alias("offset"), "raw_size", "headers", F.col("body").cast("binary").alias("body")), path)
    _compress_files(spark, path.removeprefix("file://"))
    return read_warc(spark, path).select(F.element_at(F.split("path", r"\."), -1).alias("ending"), bare_id(F.col("headers")["WARC-Record-ID"][0]).alias("identifier"), F.md5("body").alias("digest"))


def _compress_files(spark: SparkSession, folder: str) -> None:
    """Each file of a folder compressed beside itself in three ways, each of them by a task of its own, as a stream."""

    def pack(arrived):
        import pyarrow as pa
        import zstandard

        kinds = {"gz": gzip.open, "zst": zstandard.open, "xz": lzma.open}
        for b in arrived:
            for name, ending in zip(b.column("name").to_pylist(), b.column("ending").to_pylist()):
                with open(name, "rb") as data, kinds[ending](f"{name}.{ending}", "wb") as out:
                    shutil.copyfileobj(data, out, 1 << 20)
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    jobs = [(k, f"{folder}/{name}", ending) for k, (ending, name) in enumerate((e, n) for e in ("xz", "gz", "zst") for n in sorted(os.listdir(folder)))]
    if jobs:
        spread = spark.createDataFrame(jobs, "k int, name string, ending string").repartitionByRange(len(jobs), "k")
        spread.mapInArrow(pack, "n bigint").write.format("noop").mode("overwrite").save()


_SHAPES = [(t, f.name, f.dataType.simpleString(), f.nullable) for t, shape in (("records", RECORDS), ("tokens", TOKENS), ("collections", MANIFEST)) for f in shape]
_EXPECTED = """records id bigint 0, records flags int 0, records date timestamp_ntz 0, records identifier string 0, records collection string 0, records filename string 0, records offset bigint 0, records type string 0,
records uri string 1, records dict_type string 1, records dict_id bigint 1, records massaged_url string 0, records raw_size bigint 0, tokens token string 0, tokens comment string 1, tokens read_perms_kind smallint 0,
tokens write_perms_kind smallint 0, tokens delete_perms_kind smallint 0, tokens read_perms string 1, tokens write_perms string 1, tokens delete_perms string 1, collections uuid string 1, collections slug string 1,
collections compression string 1, collections compression_level int 1, collections dict_id bigint 1, collections split_threshold bigint 1"""


@query(f"SELECT p[1] AS table_name, p[2] AS column_name, p[3] AS kind, p[4] = '1' AS nullable FROM (SELECT string_split(trim(x, ' ' || chr(10)), ' ') AS p FROM (SELECT unnest(string_split('{_EXPECTED}', ',')) AS x))")
def schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shapes of tables that are kept."""
    return spark.createDataFrame(_SHAPES, "table_name string, column_name string, kind string, nullable boolean")
