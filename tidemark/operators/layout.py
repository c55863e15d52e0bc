"""How records are placed in archive files: next-fit splitting and running offsets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.checkpoint import materialise
from tidemark.schema import SPLIT_THRESHOLD


def warc_filename(n: Column, dict_id: Column | None = None, compression: Column | None = None) -> Column:
    """``records.{n}[.{dictionary}].warc[.{algorithm}]``."""
    part = lambda c: F.lit("") if c is None else F.coalesce(F.concat(F.lit("."), c.cast("string")), F.lit(""))
    return F.concat(F.lit("records."), n.cast("string"), part(dict_id), F.lit(".warc"), part(compression))


def next_fit(sizes: np.ndarray, threshold: int, inclusive: bool = True, file_no: int = 0, fill: int = 0, empty: bool = True) -> tuple[np.ndarray, np.ndarray, int, int, bool]:
    """File number and offset of each record in order, and the state with which the next ones go on.

    A record that would bring its file to the threshold begins another; a new file
    takes any size. Each file's end is found by bisection in the running sums, so a file
    costs one search, not a step a record.
    """
    ends = np.cumsum(sizes, dtype=np.int64)
    files, offsets, at = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), 0
    while at < len(sizes):
        before = int(ends[at - 1]) if at else 0
        stop = int(np.searchsorted(ends, threshold - fill + before, side="left" if inclusive else "right"))
        if stop <= at and not empty:
            file_no, fill, empty = file_no + 1, 0, True
            continue
        stop = max(stop, at + 1)
        files[at:stop] = file_no
        offsets[at:stop] = fill + ends[at:stop] - sizes[at:stop] - before
        fill, empty, at = fill + int(ends[stop - 1]) - before, False, stop
    return files, offsets, file_no, fill, empty


def assign_files(records: DataFrame, threshold: int = SPLIT_THRESHOLD, group: str = "collection", order: str = "id", size: str = "raw_size", inclusive: bool = True, state: tuple[int, int, bool] = (0, 0, True)) -> DataFrame:
    """(group, order, size, file_no, offset) of each record; records of a group are packed in order.

    Packing depends on all earlier sizes of its group, so a group's narrow rows, never
    bodies, pass through one task; they are sorted (and spilled) by Spark and packed
    as a stream, so memory doesn't grow with a group. ``inclusive`` splits at the
    threshold itself, as pushes do; rebuilding splits above it. ``state``: number and size of the
    file that is gone on with, and whether it is empty.
    """
    narrow = records.select(group, order, F.col(size).cast("bigint").alias(size))
    kinds = {f.name: f.dataType.simpleString() for f in narrow.schema}

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, at = object(), state
        for frame in frames:
            for name, part in frame.groupby(group, sort=False, dropna=False):
                key = None if pd.isna(name) else name
                if key != now:
                    now, at = key, state
                files, offsets, *rest = next_fit(part[size].to_numpy(np.int64), threshold, inclusive, *at)
                at = tuple(rest)
                yield part.assign(file_no=files, offset=offsets)

    ordered = narrow.repartition(group).sortWithinPartitions(group, order)
    return ordered.mapInPandas(pack, f"{group} {kinds[group]}, {order} {kinds[order]}, {size} bigint, file_no bigint, offset bigint")


def running(rows: DataFrame, group: str, order: str, size: str | None = None) -> DataFrame:
    """Rows with ``_place`` (1, 2, ... by order in their group) and ``_before`` (the sum of ``size`` over those before).

    Rows are spread by ranges of (group, order) over all tasks, each of which numbers its own; then the
    totals of the tasks before are added. No group passes through one task.
    """

    def number(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, place, total = TaskContext.get().partitionId(), object(), 0, 0
        for b in arrived:
            if not b.num_rows:
                continue
            keys = b.column(group)
            codes = pd.factorize(keys.to_pandas(), use_na_sentinel=False)[0]
            sizes = np.zeros(b.num_rows, np.int64) if size is None else b.column(size).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            start = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
            if keys[0].as_py() != now:
                place = total = 0
            ends = np.cumsum(sizes)
            run = np.repeat(np.arange(len(start)), np.diff(np.append(start, b.num_rows)))
            places = np.arange(b.num_rows) - start[run] + 1
            before = ends - sizes - (ends - sizes)[start[run]]
            places[run == 0] += place
            before[run == 0] += total
            now, place, total = keys[b.num_rows - 1].as_py(), int(places[-1]), int(before[-1] + sizes[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, pa.int64()) for x in (np.full(b.num_rows, part), places, before))], [*b.schema.names, "_part", "_place", "_before"])

    shape = T.StructType([*rows.schema, *(T.StructField(c, T.LongType()) for c in ("_part", "_place", "_before"))])
    mine = materialise(rows.repartitionByRange(group, order).sortWithinPartitions(group, order).mapInArrow(number, shape), "numbered")
    last = F.lit(0) if size is None else F.coalesce(F.col(size), F.lit(0)).cast("bigint")
    each = mine.groupBy(F.col(group).alias("_group"), F.col("_part").alias("_task")).agg(F.max("_place").alias("n"), F.max(F.struct("_place", (F.col("_before") + last).alias("sum"))).alias("end"))
    earlier = Window.partitionBy("_group").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    base = each.select("_group", "_task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_n"), F.coalesce(F.sum("end.sum").over(earlier), F.lit(0)).alias("_s"))
    both = mine.join(base, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_task")))
    return both.select(*rows.columns, (F.col("_place") + F.col("_n")).alias("_place"), (F.col("_before") + F.col("_s")).alias("_before"))


def running_offsets(records: DataFrame, group: str = "collection", order: str = "id", size: str = "raw_size") -> DataFrame:
    """Each record's first byte where a group's records follow each other in one file."""
    return running(records, group, order, size).withColumnRenamed("_before", "offset").drop("_place")


def file_numbers(lines: DataFrame, name: str = "file", order: str = "line_no") -> DataFrame:
    """Each file name with its number by first appearance, from 0."""
    first = lines.where(F.col(name).isNotNull()).groupBy(name).agg(F.min(order).alias("first_line"))
    return first.withColumn("file_id", (F.row_number().over(Window.orderBy("first_line")) - 1).cast("int"))  # a row for each file


def read_order(lines: DataFrame, name: str = "file", order: str = "line_no", offset: str = "offset") -> DataFrame:
    """Lines with ``file_id``, each file's in one partition and by offset, so that files are read from front to back."""
    numbered = lines.join(file_numbers(lines, name, order).drop("first_line"), name)
    return numbered.repartition("file_id").sortWithinPartitions("file_id", offset)
