from __future__ import annotations


import numpy as np

import corpus_pipeline
from conftest import SF
from tidemark.llm import _bpe, balancing, line_frequency, pseudonyms, simhash


def test_stages_and_run(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] and 4 <= len(corpus_pipeline.STAGES) <= 5
    # the same by hand: what each stage decides, applied with plain Python
    rows = {r.doc_id: r.asDict() for r in docs.collect()}
    for r in line_frequency.filter_frequent_lines(docs).collect():
        if not r.kept:
            del rows[r.doc_id]
        else:
            rows[r.doc_id] |= {"text": r.text, "n_chars": len(r.text)}
    ids = sorted(rows)
    prints, n = simhash.fingerprints([rows[k]["text"] for k in ids])
    root = list(range(len(ids)))
    for _ in range(len(ids)):
        before = root.copy()
        for i in range(len(ids)):
            near = (np.bitwise_count(prints ^ prints[i]).sum(1) <= 56) & (n > 0) & (n[i] > 0)
            root[i] = min(root[i], *(root[j] for j in np.flatnonzero(near)), root[root[i]])
        if root == before:
            break
    rows = {k: rows[k] for i, k in enumerate(ids) if root[i] == i}
    worker = pseudonyms.Pseudonymiser(pseudonyms.session_key(spark))
    for r in rows.values():
        r["text"] = worker.replace(r["text"])[0]
        r["n_chars"] = len(r["text"])
    left = spark.createDataFrame([tuple(r.values()) for r in rows.values()], docs.schema)
    wanted = []
    for r in balancing.balanced_ids(left).collect():
        wanted += [(r.doc_id, tuple(_bpe.encode(rows[r.doc_id]["text"]).tolist()))] * r.copies
    got = [(r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, SF).collect()]
    assert sorted(got) == sorted(wanted) and got

    at = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        at = stage(spark, at, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert at.columns == docs.columns and at.schema.simpleString() == docs.schema.simpleString(), name
            at.write.parquet(str(tmp_path / str(k)))
            at = spark.read.parquet(str(tmp_path / str(k)))


def test_all_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
