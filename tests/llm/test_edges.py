"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for each operator."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.llm import balancing, bitplanes, chaining, chunked_bpe, digest, language_id, line_frequency, pseudonyms, simhash, style_tree

KEY = b"a key for tests"
LONG = " ".join(f"word{k % 977} other{k % 31}" for k in range(60_000))
ROWS = [
    (1, "A plain text with a few words, and mail a.b@example.com in it.\nsecond line", "en", "s1", 10),
    (1, "A plain text with a few words, and mail a.b@example.com in it.\nsecond line", "en", "s1", 10),
    (2, None, "en", "s1", None),
    (3, "", None, None, 0),
    (4, LONG, "en", "s2", len(LONG)),
    (5, LONG, "de", "s2", len(LONG)),
    (None, "no id at all, but a text of more than fifty bytes that has a digest", "fr", "s2", 5),
    (None, None, None, None, None),
    (6, "   \n\n \t", "en", "s3", 6),
    (7, "z", "en", "s3", 1),
    (8, "é\U0001f600 ퟿" * 50, "fr", "s3", 9),
]
CLASHES = ["row", "id", "host", "hash", "line", "lines", "left", "frequent", "at", "salt", "n", "h0", "band", "root", "node", "keep", "tokens", "rate", "copies", "axis0", "new", "parts", "k1", "pos", "ref", "doc", "spans", "digest", "fingerprint", "key", "html", "rank"]
OPERATORS = {
    "line frequency": line_frequency.filter_frequent_lines,
    "chains": chaining.repeated_passages,
    "pseudonyms": lambda d: pseudonyms.pseudonymise(d, KEY),
    "simhash": simhash.near_duplicates,
    "digest": digest.fingerprint,
    "planes": bitplanes.bit_planes,
    "language": lambda d: language_id.identify(d, language_id.train(d)),
    "bpe": chunked_bpe.encode_chunked,
    "balancing": balancing.balanced_copies,
}
STAGES = {
    "line frequency": lambda d: line_frequency.filter_frequent_lines(d, keep_columns=True),
    "simhash": simhash.drop_near_duplicates,
    "pseudonyms": lambda d: pseudonyms.pseudonymise(d, KEY, keep_columns=True),
    "balancing": lambda d: balancing.balanced_copies(d, keep_columns=True),
}


@pytest.fixture(scope="module")
def messy(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(f"{c}!") for c in CLASHES})


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(messy, name):
    out = OPERATORS[name](messy)
    n = len(out.collect())
    assert len(set(out.columns)) == len(out.columns)
    one_each = {"line frequency", "pseudonyms", "digest", "language", "bpe", "balancing"}
    if name in one_each:
        assert n == len(ROWS)
    if name == "simhash":
        assert n == 8
    assert OPERATORS[name](messy.limit(0)).count() == 0
    assert OPERATORS[name](messy.where("text IS NULL").coalesce(1)).count() == (2 if name in one_each else 1 if name in ("simhash", "planes") else 0)


@pytest.mark.parametrize("name", STAGES)
def test_stage_keeps_columns(messy, name):
    out = STAGES[name](messy)
    assert out.columns == messy.columns and [f.dataType for f in out.schema] == [f.dataType for f in messy.schema]
    rows = out.collect()
    assert all(r["row"] == "row!" and r["id"] == "id!" for r in rows)
    if name in ("simhash", "pseudonyms"):  # clean rows stay
        assert {r.doc_id for r in rows} >= {1, 2, 3, 4, 6, 7, 8}
    assert STAGES[name](messy.limit(0)).count() == 0


def test_pages(spark):
    rows = [(1, "http://a/x", "<p>hello"), (1, "http://a/x", "<p>hello"), (2, None, None), (3, "", ""), (None, "x", "<" * 5000), (4, "http://a/", "<div>" * 5000 + "deep"), (5, "http://a/", "<p>" + LONG), (6, None, "plain")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("!") for c in CLASHES if c != "html"})
    out = style_tree.extract(df).collect()
    got = {r.page_id: r.text for r in out}
    assert got[1] == "hello" and got[2] is None and got[3] == "" and got[4] == "deep" and got[5] == LONG and got[6] == "plain"
    assert len(out) == len(rows) and style_tree.extract(df.limit(0)).count() == 0


BIG = [2**53 + 1, None, 2**53 + 3, -(2**63), 2**63 - 1]


@pytest.mark.parametrize("name", sorted({*OPERATORS, *STAGES}))
def test_ids_beside_a_null_stay_as_they_are(spark, name):
    """64-bit ids in one partition with a null one."""
    texts = [" ".join(f"{w}{(k * 7 + j) % 50}" for j in range(60)) for k, w in enumerate(("alpha", "beta", "gamma", "delta", "eps"))]
    rows = [(i, t, "en", f"s{k}", len(t)) for k, (i, t) in enumerate(zip(BIG, texts))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    named = {b for b in BIG if b is not None}
    for run in (OPERATORS.get(name), STAGES.get(name)):
        if run is None:
            continue
        out = run(df)
        assert {f.name: f.dataType.simpleString() for f in out.schema}.get("doc_id", "bigint") == "bigint"
        if name == "planes":
            got = {i for r in out.collect() for i in r.doc_ids}
            assert {r.doc_id for r in bitplanes.read_planes(out).collect()} == set(BIG)
        elif name == "chains":
            twice = df.union(df.select(df.doc_id - 1, "text", "lang", "source", "n_chars").where("doc_id > 0 AND doc_id IS NOT NULL")).coalesce(1)
            got = {i for r in run(twice).collect() for i in (r.doc_id, r.ref_doc_id)}
            assert got == {b for b in named if b > 0} | {b - 1 for b in named if b > 0}
            continue
        else:
            got = {r.doc_id for r in out.collect()}
        if name == "bpe":
            assert {r.doc_id: r.text for r in chunked_bpe.decode_ids(out).collect()} == dict(zip(BIG, texts))
        assert got - {None} == named if name != "balancing" or run is OPERATORS[name] else got <= set(BIG)


def test_page_ids_beside_a_null_stay_as_they_are(spark):
    df = spark.createDataFrame([(i, "http://a/", f"<p>text {i}</p>") for i in BIG], "page_id long, url string, html string").coalesce(1)
    assert {r.page_id: r.text for r in style_tree.extract(df).collect()} == {i: f"text {i}" for i in BIG}


def test_one_id_with_different_texts(spark):
    """op2: the least text stands for the id; op4: one document, by its least fingerprint; its stage keeps one row."""
    words = lambda a, n: " ".join(f"{a}{(k * k + 3 * k) % 97}x{k}" for k in range(n))
    rows = [(1, words("b", 80), "s"), (2, words("a", 80), "s"), (2, words("b", 80), "s"), (3, words("b", 80), "s"), (None, words("b", 80), "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {(r.doc_id, r.ref_doc_id) for r in chaining.repeated_passages(df).collect()} == {(3, 1)}
    out = simhash.near_duplicates(df).collect()
    assert sorted(r.doc_id for r in out) == [1, 2, 3]
    kept = simhash.drop_near_duplicates(df).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) in ([1, 2], [1]) and sum(r.doc_id is None for r in kept) == 1


def test_dropping_without_broadcasts_gives_the_same(spark, messy, monkeypatch):
    twice = messy.union(messy.withColumn("text", F.lit("other words of one id")))
    one = sorted(map(repr, simhash.drop_near_duplicates(twice).collect()))
    monkeypatch.setattr(simhash, "BROADCAST_IDS", -1)
    assert sorted(map(repr, simhash.drop_near_duplicates(twice).collect())) == one


def test_reading_back_nothing(spark, messy):
    empty = messy.limit(0)
    assert chunked_bpe.decode_ids(chunked_bpe.encode_chunked(empty)).count() == 0
    assert bitplanes.read_planes(bitplanes.bit_planes(empty)).count() == 0
    assert balancing.mixing_rates(empty).count() == 0 and language_id.train(empty) is None
    assert language_id.document_frequencies(empty)[1] == 0
    assert style_tree.importance(spark.createDataFrame([], "host string, html string")).count() == 0


@pytest.mark.filterwarnings("ignore:the constraints")
def test_pipeline_over_messy_documents(spark, messy, tmp_path):
    import corpus_pipeline

    messy.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts = {}
    for i, t, *_ in ROWS:
        texts.setdefault(i, set()).add(t)
    assert {r.doc_id for r in rows} <= {1, 4, 7, 8, None} and all(r.n_tokens == len(r.ids) > 0 for r in rows)
    for r in rows:  # all but the mail address is as it was
        assert any(t and "".join(t.split("a.b@example")) == "".join(chunked_bpe.decode(r.ids).split(chunked_bpe.decode(r.ids)[t.index("a.b@") : t.index("a.b@") + 11]) if "a.b@" in t else chunked_bpe.decode(r.ids)) for t in texts[r.doc_id])
    messy.limit(0).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
