"""Regular expressions over record bodies, with byte offsets."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def may_be_empty(pattern: str) -> bool:
    return re._parser.parse(pattern).getwidth()[0] == 0


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x)


def _native(bodies: DataFrame, patterns: list[str], text: Column) -> DataFrame:
    """Offsets are prefix sums of the bytes between and in matches, in blocks of the root of their number: n matches cost n**1.5 additions, no shuffle and no Python."""
    found = [F.struct(F.lit(p).alias("pattern"), F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias("ms"), F.split(text, p, -1).alias("ps")) for p in patterns]
    rows = bodies.where(reduce(Column.__or__, [text.rlike(p) for p in patterns])).select("row", F.inline(F.array(*found))).where(F.size("ms") > 0)
    size = lambda x: F.octet_length(x).cast("bigint")
    rows = rows.select("row", "pattern", "ms", F.transform("ps", size).alias("gap"), F.greatest(F.lit(1), F.floor(F.sqrt(F.size("ms")))).cast("int").alias("b"))
    rows = rows.withColumn("step", F.zip_with(F.slice("gap", F.lit(1), F.size("ms")), F.transform("ms", size), lambda g, m: g + m))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("ms") - 1) / F.col("b")).cast("int")), lambda k: _total(F.slice("step", k * F.col("b") + 1, F.col("b"))))
    rows = rows.withColumn("block", blocks)
    rows = rows.withColumn("base", F.transform("block", lambda _, k: _total(F.slice("block", F.lit(1), k))))

    def place(m: Column, i: Column) -> Column:
        k = F.floor(i / F.col("b")).cast("int")
        start = F.get("base", k) + _total(F.slice("step", k * F.col("b") + 1, i - k * F.col("b"))) + F.get("gap", i)
        return F.struct(m.alias("match"), start.alias("start"), (start + size(m)).alias("end"))

    return rows.select("row", "pattern", F.inline(F.transform("ms", place)))


def _python(bodies: DataFrame, patterns: list[str], body: Column) -> DataFrame:
    """For bytes that aren't text, and for expressions that match nothing at all."""

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = [(p, re.compile(p.encode())) for p in patterns]
        for frame in frames:
            rows = [
                (row, p, m.group().decode("utf-8", "replace"), m.start(), m.end())
                for row, data in zip(frame.row, frame.body)
                if data is not None
                for p, c in compiled
                for m in c.finditer(bytes(data))
            ]
            yield pd.DataFrame(rows, columns=["row", "pattern", "match", "start", "end"])

    shape = bodies.schema["row"].dataType.simpleString()
    return bodies.select("row", body.cast("binary").alias("body")).mapInPandas(find, f"row {shape}, pattern string, match string, start bigint, end bigint")


def grep(records: DataFrame, patterns: list[str], body: str = "body", keep: tuple[str, ...] = ("collection", "identifier", "uri"), native: bool | None = None) -> DataFrame:
    """A row for each match: pattern, match, first and past-the-last byte, and the columns in ``keep``.

    Matches of one pattern don't overlap. Text columns are handled by Spark's own
    expressions; binary bodies, and patterns that may match an empty text, in Python
    over bytes. Null bodies match nothing.
    """
    text = records.schema[body].dataType.simpleString() == "string"
    easy = [p for p in patterns if text and not may_be_empty(p)] if native is None else list(patterns) if native else []
    hard = [p for p in patterns if p not in easy]
    bodies = records.select(F.struct(*keep).alias("row"), F.col(body).alias("body"))
    out = None
    for some, how in ((easy, _native), (hard, _python)):
        if some:
            part = how(bodies, some, F.col("body"))
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no pattern is given")
    return out.select("pattern", "match", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "row.*")


def as_csv_rows(found: DataFrame) -> DataFrame:
    """The seven columns of the CSV form; a missing URL is empty."""
    return found.select("pattern", "collection", "match", "start", "end", "identifier", F.coalesce("uri", F.lit("")).alias("uri"))
