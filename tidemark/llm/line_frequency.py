"""Quality rules: cross-document line frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.checkpoint import materialise

#: Entries of the frequent-line table that may be broadcast: 16 bytes each, so 32 MB at most.
BROADCAST_ENTRIES = 2_000_000
#: Each host's frequent lines are kept in so many lists, by hash.
LISTS = 64
#: A line in more documents than this is frequent however many a host has.
MOST_DOCS = 1000


def normalised(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, r"[ \t\r\f\x0B]+", " ")))


def _is_line(key: Column) -> Column:
    return key != F.xxhash64(F.lit(""))


def _keys(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda x: F.xxhash64(normalised(x)))


def frequent_lines(docs: DataFrame, min_docs: int, max_share: float) -> DataFrame:
    """(host, line): hashes of the lines that more than max(min_docs, min(max_share x documents, MOST_DOCS)) of a host's distinct documents hold."""
    seen = docs.select("host", F.xxhash64("text").alias("doc"), F.explode(F.array_distinct(_keys(F.col("text")))).alias("line"))
    counted = seen.where(_is_line(F.col("line"))).groupBy("host", "line").agg(F.count_distinct("doc").alias("n"))
    hosts = docs.where(F.col("text").isNotNull()).groupBy("host").agg(F.count_distinct(F.xxhash64("text")).alias("docs"))
    # a line below min_docs is dropped before the join, which leaves few rows to move
    counted = counted.where(F.col("n") > min_docs)
    h = hosts.select(F.col("host").alias("h"), "docs")
    over = counted.join(h, counted.host.eqNullSafe(h.h)).where(F.col("n") > F.least(F.col("docs") * F.lit(max_share), F.lit(float(MOST_DOCS))))
    return over.select("host", "line")


def filter_frequent_lines(
    docs: DataFrame,
    min_docs: int = 10,
    max_share: float = 0.01,
    min_kept: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    keep_columns: bool = False,
) -> DataFrame:
    """Removes the lines that too many distinct documents of a host share; marks documents that are depleted.

    Too many are more than ``min_docs`` and either more than ``max_share`` of the host's distinct documents or more than MOST_DOCS.

    Lines are compared by a 64-bit hash of the lower-cased line with runs of blanks
    made one and outer blanks removed. Documents with equal texts count once, so
    copies of a document don't make its lines frequent. A document is kept if at least
    ``min_kept`` of its characters (line ends not counted) remain, and any remain.

    Returns one row for each row: doc_id, source, n_lines, n_removed, text (what
    remains), kept. With ``keep_columns``: the input's columns with the new text, for
    kept documents only, and ``n_chars``, if there is one, recounted.

    - null text: n_lines 0, n_removed 0, text null, not kept. Empty text, or only blanks (of any kind): not kept.
    - null doc_id: handled as any other row. Null source: a host of its own.
    - blank lines are never frequent; they stay where they are and count as lines.
    - repeated rows: each gives a row; they count once towards frequency.
    - empty table: empty result. Other columns play no part, whatever their names.
    """
    work = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(host_col).alias("host"))
    table = materialise(frequent_lines(work, min_docs, max_share), "frequent-lines")
    few = table.count() <= BROADCAST_ENTRIES
    if keep_columns:
        base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
        text, host, ident = F.col("row")[text_col], F.col("row")[host_col], F.col("row")[id_col]
    else:
        base = work.select(F.struct("id", "text", "host").alias("row"))
        text, host, ident = F.col("row.text"), F.col("row.host"), F.col("row.id")
    keyed = base.withColumn("lines", F.split(text, "\n")).withColumn("keys", _keys(text))
    if few:
        # a line is looked for in one short list
        lists = F.transform(F.sequence(F.lit(0), F.lit(LISTS - 1)), lambda k: F.filter("all", lambda x: F.pmod(x, F.lit(LISTS)) == k))
        right = table.groupBy("host").agg(F.collect_list("line").alias("all")).select(F.col("host").alias("at"), lists.alias("frequent"))
        joined = keyed.join(F.broadcast(right), host.eqNullSafe(F.col("at")), "left")
        gone = lambda key: F.array_contains(F.get(F.col("frequent"), F.pmod(key, F.lit(LISTS)).cast("int")), key)
    else:
        # the lines of each distinct text are joined to the table, and only its own frequent ones come back to it
        mark = lambda a, b: [F.xxhash64(a, b).alias("k1"), F.hash(b, a).alias("k2")]
        own = work.where(F.col("text").isNotNull()).select(*mark("host", "text"), "host", F.explode(F.array_distinct(_keys(F.col("text")))).alias("line"))
        right = table.select(F.col("host").alias("h"), F.col("line").alias("l"))
        mine = own.join(right, own.host.eqNullSafe(right.h) & (own.line == right.l), "left_semi").groupBy("k1", "k2").agg(F.collect_set("line").alias("frequent"))
        joined = keyed.select("*", *mark(host, text)).join(mine, ["k1", "k2"], "left")
        gone = lambda key: F.array_contains(F.col("frequent"), key)
    stays = lambda x, i: ~F.coalesce(gone(F.get(F.col("keys"), i)), F.lit(False))
    done = joined.withColumn("left", F.filter("lines", stays))
    n_all, n_left = F.coalesce(F.size("lines"), F.lit(0)), F.coalesce(F.size("left"), F.lit(0))
    n_all, n_left = F.greatest(n_all, F.lit(0)), F.greatest(n_left, F.lit(0))
    clean = F.array_join("left", "\n")
    chars = F.length(clean) - (n_left - 1)
    was = F.length(text) - (n_all - 1)
    kept = F.coalesce(clean.rlike(r"[^ \t\r\f\x0B\n]") & (chars >= was * F.lit(min_kept)), F.lit(False))
    if not keep_columns:
        return done.select(
            F.col("row.id").alias("doc_id"), F.col("row.host").alias("source"), n_all.alias("n_lines"),
            (n_all - n_left).alias("n_removed"), clean.alias("text"), kept.alias("kept"),
        )
    out = []
    for c in docs.columns:
        value = F.col("row")[c]
        if c == text_col:
            value = clean
        elif c == "n_chars":
            value = F.length(clean).cast(docs.schema[c].dataType)
        out.append(value.alias(c))
    return done.where(kept).select(*out)


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_frequent_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH docs AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
parts AS (
  SELECT doc_id, source, text, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS k FROM docs),
keyed AS (
  SELECT *, lower(trim(regexp_replace(line, '[ \t\r\f\v]+', ' ', 'g'))) AS norm FROM parts),
counted AS (
  SELECT source, norm, count(DISTINCT text) AS n FROM keyed WHERE norm <> '' GROUP BY source, norm HAVING count(DISTINCT text) > 10),
hosts AS (SELECT source, count(DISTINCT text) AS d FROM documents WHERE text IS NOT NULL GROUP BY source),
frequent AS (SELECT c.source, c.norm FROM counted c JOIN hosts h ON c.source = h.source WHERE c.n > least(h.d * 0.01, 1000)),
marked AS (
  SELECT k.*, f.norm IS NOT NULL AS gone FROM keyed k LEFT JOIN frequent f ON k.source = f.source AND k.norm = f.norm),
summed AS (
  SELECT doc_id, source, count(*) AS n_lines, sum(CASE WHEN gone THEN 1 ELSE 0 END) AS n_removed,
         coalesce(string_agg(CASE WHEN gone THEN NULL ELSE line END, chr(10) ORDER BY k), '') AS text,
         sum(length(line)) AS chars_was, sum(CASE WHEN gone THEN 0 ELSE length(line) END) AS chars_left,
         max(CASE WHEN NOT gone AND regexp_matches(line, '[^ \t\r\f\v]') THEN 1 ELSE 0 END) AS has_text
  FROM marked GROUP BY doc_id, source)
SELECT doc_id, source, CAST(n_lines AS INTEGER) AS n_lines, CAST(n_removed AS INTEGER) AS n_removed, text,
       has_text = 1 AND chars_left >= chars_was * 0.5 AS kept
FROM summed
"""
