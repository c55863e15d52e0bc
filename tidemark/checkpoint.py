"""Cutting lineage through the folder that all executors share.

An executor may be lost at any time, so nothing here keeps data on one machine:
intermediate tables are written as Parquet below ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset, a single-machine master (``local`` or ``local[n]``) gets a
    temporary folder; any other master is an error, since a folder of one machine
    can't be read by the others.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = getattr(sc, "_tidemark_shared", None)
    if made is None:
        made = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        sc._tidemark_shared = made
    return made


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._tidemark_path = path
    sc = spark.sparkContext
    if not hasattr(sc, "_tidemark_tables"):
        sc._tidemark_tables = set()
        atexit.register(clean, spark)
    sc._tidemark_tables.add(path)
    return back


def tasks(spark: SparkSession) -> int:
    """Into how many tasks rows are spread that are narrow but stand for much: Spark would bring them together again, were the number left open."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def clean(spark: SparkSession) -> None:
    """Deletes all intermediate tables of a session; what was built from them and isn't stored can't be read any more. Done when the session's process ends, too."""
    tables = getattr(spark.sparkContext, "_tidemark_tables", set())
    while tables:
        with contextlib.suppress(Exception):  # the session may have ended already
            _delete(spark, tables.pop())


def discard(df: DataFrame) -> None:
    """Deletes the files of a table from ``materialise`` that nothing needs any more."""
    path = getattr(df, "_tidemark_path", None)
    if path:
        _delete(df.sparkSession, path)
        getattr(df.sparkSession.sparkContext, "_tidemark_tables", set()).discard(path)
