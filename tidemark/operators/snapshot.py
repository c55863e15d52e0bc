"""Tables that are replaced whole: a snapshot is written, then a pointer to it is changed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_POINTER = "CURRENT"


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def write_snapshot(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), sort_by: str | None = None) -> str:
    """Writes ``df`` beside earlier snapshots and makes it the current one; a failure before the last step changes nothing."""
    spark, name = df.sparkSession, f"snapshot-{uuid.uuid4().hex}"
    out = df.sortWithinPartitions(*partition_by, sort_by) if sort_by else df
    writer = out.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{path}/{name}")
    fs, fresh = _fs(spark, f"{path}/_{name}")
    stream = fs.create(fresh, True)
    stream.write(bytearray(name.encode()))
    stream.close()
    pointer = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{_POINTER}")
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    modes = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    modes[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fresh, pointer, modes)
    return name


def read_snapshot(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """The current snapshot, or the one of a name; a reader that holds one isn't disturbed by later writes."""
    return spark.read.parquet(f"{path}/{name or _current(spark, path)}")


def append_snapshot(df: DataFrame, path: str, sort_by: str | None = None) -> None:
    """Adds rows to the current snapshot; begins one where there is none. All of them are seen, or none."""
    fs, pointer = _fs(df.sparkSession, f"{path}/{_POINTER}")
    if not fs.exists(pointer):
        write_snapshot(df, path, sort_by=sort_by)
        return
    out = df.sortWithinPartitions(sort_by) if sort_by else df
    out.write.mode("append").parquet(f"{path}/{_current(df.sparkSession, path)}")


def _current(spark: SparkSession, path: str) -> str:
    fs, pointer = _fs(spark, f"{path}/{_POINTER}")
    stream = fs.open(pointer)
    name = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return name


def read_snapshots(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """The current snapshots of several tables of one shape as one table; None where there are none."""
    return spark.read.parquet(*[f"{p}/{_current(spark, p)}" for p in paths]) if paths else None
