"""An archive on disk: collections that are created, pushed to, rebuilt and deleted, with their index.

Below a root that all executors mount: ``config.json``, ``data/dict/zstd`` (dictionaries),
``data/repository/<uuid>`` (manifest, record files, ``index.cdx``), and ``data/index/<uuid>``
(the collection's index rows as snapshots, one of which is current). Files are written
by tasks; a push becomes visible by its index rows and CDX lines, which come last, so one
that fails leaves bytes that nothing refers to and the next push overwrites.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid as uuids

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.checkpoint import discard, materialise
from tidemark.functions.scalars import parse_cdx_date
from tidemark.functions.urlkey import massage_url
from tidemark.operators.access import Config, check
from tidemark.operators.dictionary import dictionary_id, inactive, sample_records, train_dictionary
from tidemark.operators.mutations import LEVEL, activate, delete_by_dictionary, index_records
from tidemark.operators.push import push, push_stored, write_lines
from tidemark.operators.render import serialise
from tidemark.operators.snapshot import append_snapshot, read_snapshots, write_snapshot
from tidemark.schema import ACTIVE, DICTIONARY_BYTES, DICTIONARY_SAMPLES, MANIFEST, RECORDS, SPLIT_THRESHOLD
from tidemark.sources.cdx import read_cdx
from tidemark.sources.repository import dictionary_of, fetch_records, init_layout, read_collections, read_dictionaries, read_frame_files

SOFTWARE = "tidemark"


class Archive:
    """Operations on the archive below ``root``; each takes and gives DataFrames."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.plain = spark, root.rstrip("/"), root.removeprefix("file://").rstrip("/")

    @classmethod
    def init(cls, spark: SparkSession, root: str, config: dict | None = None) -> Archive:
        init_layout(root.removeprefix("file://"), config)
        return cls(spark, root)

    def folder(self, uuid: str) -> str:
        return f"{self.plain}/data/repository/{uuid}"

    def _index(self, uuid: str) -> str:
        return f"{self.root}/data/index/{uuid}"

    def collections(self) -> DataFrame:
        """Every usable manifest with all its fields."""
        if not any(os.scandir(f"{self.plain}/data/repository")):
            return self.spark.createDataFrame([], MANIFEST)
        return read_collections(self.spark, f"{self.root}/data/repository")

    def collection(self, slug: str | None = None, uuid: str | None = None):
        """One manifest, by slug or by uuid; None where there is none."""
        found = self.collections()
        return found.where(F.col("uuid") == uuid if uuid is not None else F.col("slug") == slug).first()

    def _known(self, slug: str):
        found = self.collection(slug)
        if found is None:
            raise KeyError(slug)
        return found

    # dictionaries

    def dictionaries(self) -> DataFrame:
        return read_dictionaries(self.spark, f"{self.root}/data/dict/zstd")

    def has_dictionary(self, number: int) -> bool:
        return any(name.split(".")[1:2] == [str(number)] for name in os.listdir(f"{self.plain}/data/dict/zstd"))

    def dictionary(self, number: int | None) -> bytes | None:
        """The bytes of one dictionary; only its file is read."""
        return None if number is None else dictionary_of(f"{self.plain}/data/dict/zstd", number)

    def add_dictionary(self, slug: str, data: bytes) -> int:
        """Stores a dictionary under the id in its bytes."""
        number = dictionary_id(data)
        if self.has_dictionary(number):
            raise FileExistsError(f"there is a dictionary {number} already")
        path = f"{self.plain}/data/dict/zstd/{slug}.{number}.zstdict"
        with open(f"{path}.{uuids.uuid4().hex}.new", "wb") as out:
            out.write(data)
        os.replace(out.name, path)
        return number

    def train_dictionary(self, slug: str, samples: int = DICTIONARY_SAMPLES, size: int = DICTIONARY_BYTES, seed: int | None = None) -> int:
        """Trains a dictionary on a sample of a collection's records, which are read from their files, and stores it."""
        known = self._known(slug)
        chosen = sample_records(self.records(known.uuid), known.uuid, samples)
        read = self.fetch(chosen).select(serialise(F.col("headers"), F.col("body")).alias("body"))
        taken = {int(n.split(".")[1]) for n in os.listdir(f"{self.plain}/data/dict/zstd") if n.split(".")[1:2] and n.split(".")[1].isdigit()}
        return self.add_dictionary(slug, train_dictionary(read, taken, size, seed=seed)[1])

    # collections

    def _write_manifest(self, manifest: dict) -> None:
        path = f"{self.folder(manifest['uuid'])}/manifest.json"
        with open(f"{path}.new", "w") as out:
            json.dump(manifest, out)
        os.replace(f"{path}.new", path)

    def create_collection(self, slug: str, dict_id: int | None = None, threshold: int = SPLIT_THRESHOLD, level: int = LEVEL, warcinfo: bool = True) -> bool:
        """Makes a collection with its manifest and, as its first record, a ``warcinfo`` that holds the manifest.

        False, and nothing happens, where the slug is taken; a dictionary that isn't there is an error.
        """
        if self.collection(slug) is not None:
            return False
        if dict_id is not None and not self.has_dictionary(dict_id):
            raise KeyError(f"no dictionary {dict_id}")
        made = {"uuid": str(uuids.uuid4()), "slug": slug, "compression": None if dict_id is None else "zstd", "compression_level": level, "dict_id": dict_id, "split_threshold": threshold}
        os.makedirs(self.folder(made["uuid"]))
        self._write_manifest(made)
        if warcinfo:
            body = f"format: WARC File Format 1.1\r\nsoftware: {SOFTWARE}\r\ncollection-manifest: {json.dumps(made)}\r\n"
            headers = {"WARC-Type": ["warcinfo"], "WARC-Record-ID": [f"<urn:uuid:{uuids.uuid4()}>"], "Content-Type": ["application/warc-fields"]}
            row = self.spark.createDataFrame([(0, headers, bytearray(body.encode()))], "id bigint, headers map<string,array<string>>, body binary")
            now = F.array(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
            self.push(slug, row.withColumn("headers", F.map_concat("headers", F.create_map(F.lit("WARC-Date"), now))))
        return True

    def delete_collection(self, slug: str, token: str | None = None, tokens: DataFrame | None = None, config: Config = Config()) -> bool:
        """Deletes a collection's rows, then its files. One that isn't there changes nothing."""
        self._ask(slug, "delete", token, tokens, config)
        known = self.collection(slug)
        if known is None:
            return False
        for path in (self._index(known.uuid).removeprefix("file://"), self.folder(known.uuid)):
            shutil.rmtree(path, ignore_errors=True)
        return True

    # records

    def records(self, uuid: str | None = None) -> DataFrame:
        """The index rows of all collections, or of one."""
        root = f"{self.plain}/data/index"
        names = [uuid] if uuid is not None else sorted(os.listdir(root)) if os.path.isdir(root) else []
        there = [n for n in names if os.path.isdir(f"{root}/{n}")]
        found = read_snapshots(self.spark, [f"{self.root}/data/index/{n}" for n in there])
        return self.spark.createDataFrame([], RECORDS) if found is None else found

    def fetch(self, records: DataFrame, raw: bool = False) -> DataFrame:
        """Index rows with what their files hold at their places."""
        placed = records.withColumn("filename", F.concat("collection", F.lit("/"), "filename"))
        return fetch_records(placed, f"{self.plain}/data/repository", dictionaries=f"{self.plain}/data/dict/zstd", raw=raw)

    def _add_rows(self, manifest, index: DataFrame) -> DataFrame:
        """Index rows for pushed CDX fields (record_no and the seven), numbered on from those that are there."""
        old = self.records(manifest.uuid)
        first = old.agg(F.max("id")).first()[0]
        rows = index.select(
            (F.col("record_no") + (first or 0)).cast("bigint").alias("id"), F.lit(ACTIVE).cast("int").alias("flags"), F.coalesce(parse_cdx_date(F.col("date")), F.lit("1970-01-01").cast("timestamp_ntz")).alias("date"),
            F.coalesce("id", F.lit("")).alias("identifier"), F.lit(manifest.uuid).alias("collection"), F.col("file").alias("filename"), F.col("offset").cast("bigint").alias("offset"), F.coalesce("type", F.lit("")).alias("type"),
            F.col("url").alias("uri"), F.lit(manifest.compression).cast("string").alias("dict_type"), F.lit(manifest.dict_id).cast("bigint").alias("dict_id"), massage_url(F.col("url")).alias("massaged_url"), F.col("raw_size").cast("bigint").alias("raw_size"),
        )
        append_snapshot(rows, self._index(manifest.uuid), sort_by="massaged_url")
        return index

    def _ask(self, slug: str, action: str, token: str | None, tokens: DataFrame | None, config: Config) -> None:
        """An error unless a token, or an anonymous visitor, may do something to a collection; with no table of tokens everyone may."""
        if tokens is not None:
            asked = self.spark.createDataFrame([(token, slug)], "token string, slug string")
            if not check(asked, tokens, config, action).first()["allowed"]:
                raise PermissionError(f"{action} {slug}")

    def push(self, slug: str, records: DataFrame, order: str = "id", token: str | None = None, tokens: DataFrame | None = None, config: Config = Config()) -> DataFrame:
        """Appends records (order, headers, body) to the collection's last file and new ones after it, then to ``index.cdx``, then to the index.

        Returns record_no (1, 2, ... by ``order``) and the seven CDX fields. Where ``tokens`` are given, ``token`` must be allowed to write.
        """
        self._ask(slug, "write", token, tokens, config)
        known = self._known(slug)
        index = push(records, f"file://{self.folder(known.uuid)}", self.dictionary(known.dict_id), known.dict_id, known.split_threshold, known.compression_level, order)
        return self._add_rows(known, index)

    def push_raw(self, slug: str, frames: str, token: str | None = None, tokens: DataFrame | None = None, config: Config = Config()) -> DataFrame:
        """Appends pushed frames (files of CDX lines, each followed by as many bytes as it says) without looking into them.

        The bytes must be encoded as the collection's are; what the lines say is taken as it is. Each
        file is read by one task, in batches; a bad frame fails the push before anything is written.
        """
        self._ask(slug, "write", token, tokens, config)
        known = self._known(slug)
        index = push_stored(read_frame_files(self.spark, frames), f"file://{self.folder(known.uuid)}", known.dict_id, known.split_threshold)
        return self._add_rows(known, index)

    def load_index(self) -> DataFrame:
        """The index rows that all collections' CDX files give, in place of those that are there."""
        all_ = self.collections().collect()
        for known in all_:
            path = f"{self.folder(known.uuid)}/index.cdx"
            if os.path.exists(path):
                lines = read_cdx(self.spark, f"file://{path}", "skip").withColumn("slug", F.lit(known.slug))
                rows = index_records(lines, self.spark.createDataFrame([known], MANIFEST))
                write_snapshot(materialise(rows, "loaded-index"), self._index(known.uuid), sort_by="massaged_url")
        return self.records()

    def rebuild(self, slug: str, dict_id: int) -> DataFrame:
        """Encodes a collection anew with another dictionary; returns its new index rows.

        Records are read by their index from front to back of each file. New files are written beside the
        old ones, then rows for them that aren't active, then, in one change of the index, those are activated (with the
        flags that the old ones had) and the old ones deleted; manifest and ``index.cdx`` follow, and at last the old files
        go. A rebuild that fails before the change of the index leaves the old records in use, and can be begun again.
        """
        known = self._known(slug)
        if known.dict_id == dict_id:
            raise ValueError("the collection has that dictionary already")
        data, uuid, folder = self.dictionary(dict_id), known.uuid, self.folder(known.uuid)
        old = materialise(delete_by_dictionary(self.records(uuid), uuid, dict_id, "zstd"), "old-index")  # without rows of a rebuild that was broken off
        content = self.fetch(old).select("id", serialise(F.col("headers"), F.col("body")).alias("raw"))
        placed = push_stored(content, f"file://{folder}", dict_id, known.split_threshold, inclusive=False, dictionary=data, level=known.compression_level, fresh=True, index=None)
        fresh = old.drop("filename", "offset", "raw_size", "dict_id", "dict_type").join(placed, "id")
        fresh = fresh.withColumns({"dict_id": F.lit(dict_id).cast("bigint"), "dict_type": F.lit("zstd")}).select(RECORDS.fieldNames())
        write_snapshot(old.unionByName(inactive(fresh)), self._index(uuid), sort_by="massaged_url")
        swapped = delete_by_dictionary(activate(self.records(uuid), uuid, dict_id, "zstd"), uuid, known.dict_id, known.compression)
        flags = old.select("id", F.col("flags").alias("was"))
        write_snapshot(swapped.join(flags, "id").withColumn("flags", F.col("was")).select(RECORDS.fieldNames()), self._index(uuid), sort_by="massaged_url")
        now = self.records(uuid)
        lines = now.select("id", F.col("uri").alias("url"), "type", "identifier", F.date_format("date", "yyyyMMddHHmmss").alias("date"), F.col("filename").alias("file"), F.col("offset").cast("string").alias("offset"), "raw_size")
        write_lines(lines.withColumnRenamed("id", "record_no").withColumnRenamed("identifier", "id"), f"file://{folder}/.index.cdx")
        self._write_manifest({k: known[k] for k in MANIFEST.fieldNames()} | {"dict_id": dict_id, "compression": "zstd"})
        shutil.rmtree(f"{folder}/index.cdx", ignore_errors=True)
        os.replace(f"{folder}/.index.cdx", f"{folder}/index.cdx")
        used = {r.filename for r in now.select("filename").distinct().collect()}  # a row for each file
        for name in os.listdir(folder):
            if name.startswith("records.") and name not in used:
                os.remove(f"{folder}/{name}")
        discard(old)
        return now
