"""Cutting lineage: written tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where none is set, a new local one if the session runs in one process, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="gridwake-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


_written: list[str] = []


def new_path(spark: SparkSession, tag: str) -> str:
    folder = f"{shared_dir(spark)}/gridwake-{uuid.uuid4().hex}"
    _written.append(folder)
    return f"{folder}/{tag}"


def clear(spark: SparkSession) -> int:
    """Remove the tables that this driver has written so far, and return how many folders that were; what reads them must be done."""
    n = 0
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        n += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


#: Write options for rows of some MB that are compressed already: a page is closed by its size and not after 100 rows.
LARGE_ROWS = {"compression": "none", "parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1"}


def materialize(df: DataFrame, tag: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write df once as Parquet in the shared folder, with options of the Parquet writer if given, and read it back.

    Later jobs start from the files, so a lost executor costs a reread and not a recomputation,
    and a table with several readers is computed once.
    """
    path = new_path(df.sparkSession, tag)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_checked(left: DataFrame, right: DataFrame, on, how: str = "left", max_rows: int = 100_000) -> DataFrame:
    """Join with a right side that is broadcast only if it has been counted to hold at most max_rows rows.

    A larger right side is joined by shuffle, where adaptive execution splits skewed keys.
    """
    if right.limit(max_rows + 1).count() <= max_rows:
        return left.join(F.broadcast(right), on, how)
    return left.join(right.hint("merge"), on, how)
