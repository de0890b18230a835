"""Folders and intermediate tables that driver and executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder for a query's files, in the folder that all hosts share (`spark.checkpoint.dir`); a local one only for local masters."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/') if '://' in base else 'file://' + os.path.abspath(base)}/tablesift/files-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Written to a new shared folder and read again: lineage ends here, and what comes after is planned by true sizes."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tablesift_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def discard(*tables: DataFrame) -> None:
    """Deletes materialized tables that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_tablesift_path", None):
            remove(df.sparkSession, path)


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, marked for broadcast if it has at most so many rows. df must be cheap to count."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
