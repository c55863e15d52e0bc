"""From raw documents to token ids: quality rules, near-duplicates, personal data, mixing, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.checkpoint import discard, materialise
from tidemark.llm.balancing import balanced_ids
from tidemark.llm.chunked_bpe import encode_chunked
from tidemark.llm.line_frequency import filter_frequent_lines
from tidemark.llm.pseudonyms import pseudonymise, session_key
from tidemark.llm.simhash import drop_near_duplicates


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that too many documents of a source share go; documents that they made up go with them.

    Null, empty and blank texts go. A null source is a source; null ids and repeated rows stay, an empty table stays empty.
    """
    return filter_frequent_lines(docs, keep_columns=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the least id stays.

    Of rows with one id, one stays. Rows with a null id, or without words, all stay. An empty table stays empty.
    """
    return drop_near_duplicates(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values give way to pseudonyms of their format, by the secret of ``spark.tidemark.pseudonymKey`` or one of this session.

    Null and empty texts stay as they are; repeated rows, null ids and an empty table too.
    """
    return pseudonymise(docs, session_key(spark), keep_columns=True)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that all sources have equal shares of the token ids that ``bpe`` gives.

    Null and empty texts have no tokens and go. A null source or language is a value of its own; an empty table stays empty.
    """
    return balanced_ids(docs, keep_columns=True)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document: doc_id, n_tokens, ids. A null text has null ids, an empty one none; each row gives a row."""
    return encode_chunked(docs)


STAGES = [("quality rules", quality_rules), ("near duplicates", near_dedup), ("personal data", pii), ("mixing", mixing), ("encoding", bpe)]

#: SimHash, Feistel pseudonyms and BPE aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written as Parquet in the shared folder and read by the next, then deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            discard(before)
        before = docs
    return docs
