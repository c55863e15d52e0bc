from __future__ import annotations

import gzip
import io
import json
import lzma

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import access, mutations
from tidemark.operators.dictionary import compressed, dictionary_id, train_dictionary
from tidemark.operators.grep import grep
from tidemark.operators.layout import assign_files, next_fit
from tidemark.operators.snapshot import read_snapshot, write_snapshot
from tidemark.sources.cdx import read_cdx
from tidemark.sources.repository import dictionary_names, fetch_records, init_layout, read_collections, read_dictionaries, read_frames
from tidemark.sources.warc import BadRecord, read_record, read_warc, records_of, write_record

HEAD = {"WARC-Type": ["response"], "WARC-Record-ID": ["<urn:1>"], "X": ["a", "b"]}


def test_record_forms():
    data = write_record(HEAD, b"body\r\n\r\n")
    assert read_record(io.BytesIO(data)) == (HEAD, b"body\r\n\r\n", len(data))
    assert read_record(io.BytesIO(b"")) is None
    for bad in (data.replace(b"1.1", b"1.0"), data[:-1], data[:-6], b"WARC/1.1\r\nX: a\r\n", b"WARC/1.1\r\nno mark\r\n\r\n"):
        with pytest.raises(BadRecord):
            read_record(io.BytesIO(bad))
    stream = io.BytesIO(b"WARC/1.1\r\nx: 1\r\n\r\nrest")
    headers, body, size = read_record(stream, "f", 3)
    assert body == b"" and stream.read() == b"rest" and headers["WARC-Type"] == [""] and headers == read_record(io.BytesIO(b"WARC/1.1\r\nx: 1\r\n\r\n"), "f", 3)[0]


def test_scan_and_errors(spark, tmp_path):
    good = [write_record(HEAD, b"%d" % k * k) for k in range(4)]
    (tmp_path / "a.warc").write_bytes(b"".join(good[:2]) + b"WARC/1.0\r\n\r\n" + b"".join(good[2:]))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(good[0]) + gzip.compress(good[1]))
    (tmp_path / "c.warc.zst").write_bytes(zstandard.compress(good[0]) + zstandard.compress(good[1]))
    (tmp_path / "d.warc.xz").write_bytes(lzma.compress(good[3]))
    found = read_warc(spark, str(tmp_path)).groupBy(F.substring_index("path", "/", -1).alias("f")).count().collect()
    assert {r.f: r["count"] for r in found} == {"a.warc": 2, "b.warc.gz": 2, "c.warc.zst": 2, "d.warc.xz": 1}
    assert len(list(records_of(str(tmp_path / "a.warc"), "skip"))) == 4
    with pytest.raises(BadRecord):
        list(records_of(str(tmp_path / "a.warc"), "fail"))
    for path, at, size, headers, body in records_of(str(tmp_path / "a.warc"), "skip"):
        raw = (tmp_path / "a.warc").read_bytes()[at : at + size]
        assert raw == write_record(headers, body)


def test_fetch(spark, tmp_path):
    dictionary = train_dictionary(spark.createDataFrame([(b"some text that repeats %d " % k * 20,) for k in range(300)], "body binary"), size=4000)[1]
    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    plain = [write_record(HEAD, b"%d" % k) for k in range(3)]
    small = [packer.compress(p) for p in plain]
    rows = []
    for name, parts, d in (("p.warc", plain, None), ("z.warc.zstd", small, 7)):
        (tmp_path / name).write_bytes(b"".join(parts))
        at = 0
        for k, p in enumerate(parts):
            rows.append((len(rows), name, at, len(p), d))
            at += len(p)
    index = spark.createDataFrame(rows, "id long, filename string, offset long, raw_size long, dict_id long")
    got = fetch_records(index, str(tmp_path), dictionaries={7: dictionary}).orderBy("id").collect()
    assert [bytes(r.body) for r in got] == [b"0", b"1", b"2"] * 2 and got[0].headers["X"] == ["a", "b"]
    raw = fetch_records(index, str(tmp_path), raw=True).orderBy("id").collect()
    assert [bytes(r.raw) for r in raw] == plain + small
    body = spark.createDataFrame([(b"abc" * 40,), (None,)], "b binary")
    back = body.select(compressed(compressed(F.col("b"), dictionary), dictionary, back=True).alias("b")).collect()
    assert [r.b if r.b is None else bytes(r.b) for r in back] == [b"abc" * 40, None]
    clash = train_dictionary(body.where("b IS NOT NULL").union(spark.createDataFrame([(b"some text %d" % k * 9,) for k in range(200)], "b binary")), taken={0}, body="b", seed=1)
    assert clash[0] == dictionary_id(clash[1])


@given(st.lists(st.integers(0, 50), max_size=60), st.integers(1, 80), st.booleans())
@settings(deadline=None, max_examples=60)
def test_next_fit(sizes, threshold, inclusive):
    wanted, file_no, fill, empty = [], 0, 0, True
    for s in sizes:
        over = fill + s >= threshold if inclusive else fill + s > threshold
        if over and not empty:
            file_no, fill = file_no + 1, 0
        wanted.append(file_no)
        fill, empty = fill + s, False
    files, offsets, *state = next_fit(np.array(sizes, np.int64), threshold, inclusive)
    assert files.tolist() == wanted
    at = [sum(s for s, f in zip(sizes[:k], wanted[:k]) if f == wanted[k]) for k in range(len(sizes))]
    assert offsets.tolist() == at
    half = len(sizes) // 2
    one = next_fit(np.array(sizes[:half], np.int64), threshold, inclusive)
    two = next_fit(np.array(sizes[half:], np.int64), threshold, inclusive, *one[2:])
    assert one[0].tolist() + two[0].tolist() == wanted and list(two[2:]) == state


def test_packing_of_nothing(spark):
    none = spark.createDataFrame([], "collection string, id long, raw_size long")
    assert assign_files(none, 10).count() == 0


def test_grep_cases(spark):
    rows = [(1, "éa12b3 12"), (2, "12"), (3, ""), (4, None), (5, "aa")]
    df = spark.createDataFrame(rows, "n int, body string")
    found = lambda d, p, **how: sorted(map(tuple, grep(d, p, keep=("n",), **how).select("n", "pattern", "match", "start", "end").collect()))
    native = found(df, ["[0-9]+", "a"])
    assert native == [(1, "[0-9]+", "12", 3, 5), (1, "[0-9]+", "12", 8, 10), (1, "[0-9]+", "3", 6, 7), (1, "a", "a", 2, 3), (2, "[0-9]+", "12", 0, 2), (5, "a", "a", 0, 1), (5, "a", "a", 1, 2)]
    assert native == found(df, ["[0-9]+", "a"], native=False) == found(df.withColumn("body", F.col("body").cast("binary")), ["[0-9]+", "a"])
    assert found(df.where("n = 5"), ["x*"]) == [(5, "x*", "", k, k) for k in range(3)]
    many = spark.createDataFrame([(1, "ab " * 3000)], "n int, body string")
    assert found(many, ["b"]) == [(1, "b", "b", 3 * k + 1, 3 * k + 2) for k in range(3000)]


def test_cdx_reader(spark, tmp_path):
    line = "http://x/ response urn:{} 20240101000000 records.0.warc 0 10"
    (tmp_path / "index.cdx").write_text("\n".join([line.format(1), "bad", line.format(2)]) + "\n")
    ids = lambda how: sorted(r.id for r in read_cdx(spark, str(tmp_path), how).collect())
    assert ids("stop") == ["urn:1"] and ids("skip") == ["urn:1", "urn:2"]
    with pytest.raises(Exception, match="bad CDX line"):
        ids("fail")


def test_repository(spark, tmp_path):
    root = tmp_path / "archive"
    init_layout(str(root))
    with pytest.raises(FileExistsError):
        init_layout(str(root))
    for slug, m in (("a", {"uuid": "u", "slug": "a"}), ("b", {"uuid": "v", "slug": "b", "compression": "gzip"})):
        (root / "data/repository" / slug).mkdir()
        (root / "data/repository" / slug / "manifest.json").write_text(json.dumps(m))
    (root / "data/repository/c").mkdir()
    (root / "data/repository/c/manifest.json").write_text("{broken")
    known = read_collections(spark, str(root / "data/repository"))
    assert [r.slug for r in known.collect()] == ["a"]
    more, made = mutations.create_collection(known, "new")
    assert made and sorted(r.slug for r in more.collect()) == ["a", "new"]
    assert not mutations.create_collection(known, "a")[1]
    (root / "data/dict/zstd/web.7.zstd").write_bytes(b"x")
    assert [(r.dict_id, bytes(r.bytes)) for r in read_dictionaries(spark, str(root / "data/dict/zstd")).collect()] == [(7, b"x")]
    with pytest.raises(ValueError):
        dictionary_names(spark.createDataFrame([("a.1.z",), ("b.1.z",)], "name string"))


def test_frames():
    frame = lambda n: b"- response urn:%d 20240101000000 - - %d\n" % (n, n) + b"x" * n
    batches = list(read_frames(frame(5) + frame(6) + frame(20), 12))
    assert [[len(d) for _, d in b] for b in batches] == [[5, 6], [20]]
    for bad in (b"a b c\nx", b"- response urn:1 20240101000000 - - 0\n", frame(5)[:-1]):
        with pytest.raises(ValueError):
            list(read_frames(bad))


def test_tokens_and_snapshots(spark, tmp_path):
    token = access.new_token(spark, "c", read_any=True, read_list=["x"], write_list=["a", "b"], delete_prefix="w")
    assert [tuple(r)[1:] for r in access.list_tokens(token).collect()] == [("c", "any()", "list(a,b)", "prefix(w)")]
    path = f"file://{tmp_path}/index"
    first = write_snapshot(spark.range(3), path)
    held = read_snapshot(spark, path)
    write_snapshot(spark.range(5), path)
    assert held.count() == 3 and read_snapshot(spark, path).count() == 5 and read_snapshot(spark, path, first).count() == 3
