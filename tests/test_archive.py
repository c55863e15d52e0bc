from __future__ import annotations

import gzip
import os

import pytest
from pyspark.sql import functions as F

from conftest import SF
from tidemark.operators.archive import Archive
from tidemark.operators.layout import running
from tidemark.operators.search import Match, search
from tidemark.operators.snapshot import read_snapshot, write_snapshot
from tidemark.plans.views import keyed
from tidemark.sources.warc import list_files, write_record
from tidemark.streaming.ingest import append_batches, stream_records


def _records(spark, numbers):
    rows = [(k, {"WARC-Type": ["response"], "WARC-Record-ID": [f"<urn:{k}>"], "WARC-Date": ["2024-01-01T00:00:00Z"], "WARC-Target-URI": [f"http://a.com/{k}"]}, bytearray(b"body %d " % k * 40)) for k in numbers]
    return spark.createDataFrame(rows, "id long, headers map<string,array<string>>, body binary")


def _bodies(archive):
    return {r.identifier: bytes(r.body) for r in archive.fetch(archive.records()).collect()}


def test_a_push_that_failed_is_written_over(spark, tmp_path):
    archive = Archive.init(spark, f"file://{tmp_path}/a")
    assert archive.records().count() == 0 and archive.collections().count() == 0
    archive.create_collection("c", threshold=3000, warcinfo=False)
    archive.push("c", _records(spark, range(3)))
    folder = archive.folder(archive.collection("c").uuid)
    with open(f"{folder}/records.1.warc", "ab") as out:
        out.write(b"left by a push that failed")
    archive.push("c", _records(spark, range(3, 40)))
    archive.push("c", _records(spark, []))
    assert _bodies(archive) == {f"urn:{k}": b"body %d " % k * 40 for k in range(40)}
    assert sorted(r.id for r in archive.records().collect()) == list(range(1, 41))
    assert len([n for n in os.listdir(folder) if n.startswith("records.")]) > 3


def test_a_rebuild_keeps_flags_and_can_be_begun_again(spark, tmp_path):
    archive = Archive.init(spark, f"file://{tmp_path}/a")
    archive.create_collection("c", warcinfo=False)
    archive.push("c", _records(spark, range(30)))
    known = archive.collection("c")
    off = archive.records(known.uuid).withColumn("flags", F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("flags")))
    write_snapshot(off, archive._index(known.uuid))
    number = archive.train_dictionary("c", seed=1)
    # rows and files of a rebuild that was broken off
    rows = archive.records(known.uuid).withColumns({"flags": F.lit(0), "dict_id": F.lit(number).cast("bigint"), "dict_type": F.lit("zstd"), "filename": F.lit(f"records.1.{number}.warc.zstd")})
    write_snapshot(archive.records(known.uuid).unionByName(rows), archive._index(known.uuid))
    with open(f"{archive.folder(known.uuid)}/records.1.{number}.warc.zstd", "wb") as out:
        out.write(b"half a file")
    archive.rebuild("c", number)
    assert {r.id: r.flags for r in archive.records().collect()} == {k: 0 if k % 3 == 0 else 1 for k in range(1, 31)}
    assert _bodies(archive) == {f"urn:{k}": b"body %d " % k * 40 for k in range(30)}
    with pytest.raises(ValueError):
        archive.rebuild("c", number)
    archive.push("c", _records(spark, range(30, 33)))  # goes on in the new encoding
    assert len(_bodies(archive)) == 33 and archive.records().where(F.col("dict_id") == number).count() == 33


def test_a_bad_frame_fails_before_anything_is_written(spark, tmp_path):
    archive = Archive.init(spark, f"file://{tmp_path}/a")
    archive.create_collection("c", warcinfo=False)
    data = write_record({"WARC-Type": ["response"], "WARC-Record-ID": ["<urn:1>"]}, b"x")
    for bad in (b"http://a/ response urn:1 20240101000000 - - %d\n" % (len(data) + 1) + data, b"http://a/ response urn:1 20240101000000 - - 0\n", b"no line"):
        (tmp_path / "f").write_bytes(b"http://a/ response urn:1 20240101000000 - - %d\n" % len(data) + data + bad)
        with pytest.raises(Exception, match="frame"):
            archive.push_raw("c", str(tmp_path / "f"))
        assert archive.records().count() == 0 and not any(n.startswith("records.") for n in os.listdir(archive.folder(archive.collection("c").uuid)))


def test_running_numbers(spark):
    rows = [(None if k % 3 == 0 else "ab"[k % 2], (k * 37) % 101, k % 5 if k % 7 else None) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, o int, n int").repartition(7)
    out = running(df, "g", "o", "n").collect()
    for g in (None, "a", "b"):
        mine = sorted((r for r in out if r.g == g), key=lambda r: r._place)
        assert [r._place for r in mine] == list(range(1, len(mine) + 1)) and [r.o for r in mine] == sorted(r.o for r in mine)
        total = 0
        for r in mine:
            assert r._before == total
            total += r.n or 0
    assert len(out) == 500 and running(df.limit(0), "g", "o").count() == 0


def test_a_search_over_a_stored_index_is_pushed_down(spark, tmp_path):
    write_snapshot(keyed(spark, SF).select("id", "massaged_url"), str(tmp_path / "index"), sort_by="massaged_url")
    found = search(read_snapshot(spark, str(tmp_path / "index")), Match("example.org"), mode="strict", limit=None)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(massaged_url,org,example" in plan and found.count() > 0


def test_compressed_files_are_streamed(spark, tmp_path):
    data = [write_record({"WARC-Type": ["response"], "WARC-Record-ID": [f"<urn:{k}>"]}, b"%d" % k) for k in range(4)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc").write_bytes(b"".join(data[:2]))
    (tmp_path / "in" / "b.warc.gz").write_bytes(gzip.compress(data[2]) + gzip.compress(data[3]))
    append_batches(stream_records(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination()
    assert {r.identifier for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {f"urn:{k}" for k in range(4)}


def test_files_are_listed_by_other_file_systems_too(tmp_path, monkeypatch):
    from pyarrow import fs

    from tidemark.sources import warc

    (tmp_path / "d").mkdir()
    for name in ("b.warc", "d/a.warc", "_no", ".no"):
        (tmp_path / name).write_bytes(b"x")
    monkeypatch.setattr(warc, "_remote", lambda path: (fs.LocalFileSystem(), path.removeprefix("hdfs://h")) if path.startswith("hdfs://") else None)
    assert list_files(f"hdfs://h{tmp_path}") == [f"hdfs://h{tmp_path}/b.warc", f"hdfs://h{tmp_path}/d/a.warc"]
    assert warc.opened(f"hdfs://h{tmp_path}/b.warc").read() == b"x"


def test_dates_beyond_2262_are_fetched_and_no_file_is_one_task_s(spark, tmp_path):
    archive = Archive.init(spark, f"file://{tmp_path}/a")
    archive.create_collection("c", warcinfo=False)
    late = F.transform_values("headers", lambda k, v: F.when(k == "WARC-Date", F.array(F.lit("2400-01-01T00:00:00Z"))).otherwise(v))
    archive.push("c", _records(spark, range(40)).withColumn("headers", late))
    assert _bodies(archive) == {f"urn:{k}": b"body %d " % k * 40 for k in range(40)}
    assert {r.date.year for r in archive.records().collect()} == {2400}
    fetched = archive.fetch(archive.records())
    assert fetched.select(F.spark_partition_id().alias("p")).distinct().count() > 1 and len(os.listdir(archive.folder(archive.collection("c").uuid))) == 3


def test_files_are_read_in_batches_of_bytes(spark, tmp_path, monkeypatch):
    from tidemark.sources import warc

    data = [write_record({"WARC-Type": ["response"], "WARC-Record-ID": [f"<urn:{k}>"]}, b"x" * 100) for k in range(10)]
    (tmp_path / "a.warc").write_bytes(b"".join(data))
    monkeypatch.setattr(warc, "READ_BATCH", 2 * len(data[0]))
    made = list(warc.batches_of(str(tmp_path / "a.warc")))
    assert [b.num_rows for b in made] == [2] * 5 and sum(b.column("raw_size").to_pylist()[0] for b in made) == 5 * len(data[0])


def test_a_stream_leaves_contents_to_the_tasks(spark, tmp_path):
    (tmp_path / "in dir").mkdir()
    (tmp_path / "in dir" / "a.warc").write_bytes(write_record({"WARC-Type": ["response"], "WARC-Record-ID": ["<urn:1>"]}, b"1"))
    query = append_batches(stream_records(spark, str(tmp_path / "in dir")), str(tmp_path / "out"), str(tmp_path / "state"), once=True)
    query.awaitTermination()
    assert "content#" not in query._jsq.explainInternal(True).split("Physical Plan")[-1]
    assert [(r.identifier, bytes(r.body)) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("urn:1", b"1")]


def test_samples_stay_where_they_are(spark):
    from tidemark.operators.dictionary import sample_records, train_dictionary

    rows = spark.range(400).select("id", F.lit(1).alias("flags"), F.repeat(F.concat(F.lit("text "), F.col("id")), 20).alias("body"))
    wanted = [r.id for r in rows.orderBy(F.md5(F.col("id").cast("string").cast("binary")), "id").limit(50).collect()]
    chosen = sample_records(rows, n=50)
    assert sorted(r.id for r in chosen.collect()) == sorted(wanted)
    plan = chosen._jdf.queryExecution().optimizedPlan().toString()
    assert "body" not in plan[plan.index("GlobalLimit") :].split("Range")[0]
    with pytest.raises(ValueError, match="nothing"):
        train_dictionary(rows.where("id < 0"))
    assert train_dictionary(chosen.repartition(7))[1] == train_dictionary(chosen.repartition(3))[1]


def test_files_are_compressed_by_tasks(spark, tmp_path):
    from tidemark.plans.storage import _compress_files
    from tidemark.sources.warc import opened

    for name in ("a.warc", "b.warc"):
        (tmp_path / name).write_bytes(name.encode() * 99)
    _compress_files(spark, str(tmp_path))
    assert len(os.listdir(tmp_path)) == 8
    for name in os.listdir(tmp_path):
        with opened(str(tmp_path / name)) as data:
            assert data.read() == name[:6].encode() * 99
