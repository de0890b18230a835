"""A dictionary of values that grows batch by batch: dense ids from 0 that never change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import commits
from ..sources.exchange import discard, materialize
from .order import row_numbers

SCHEMA = "value string, id long"


def read(spark: SparkSession, path: str) -> DataFrame:
    """(value, id) of all committed batches."""
    known = commits.folders(spark, path)
    return spark.read.schema(SCHEMA).parquet(*known) if known else spark.createDataFrame([], SCHEMA)


def grow(cells: DataFrame, path: str, batch: str, tries: int = 10) -> DataFrame:
    """Adds the values of cells (value, more or none) that the dictionary lacks, and returns it. New values are numbered in their order after
    those there are, stretch by stretch, so no task sorts them all. A batch of one name is added once; where another writer was faster,
    what is new is worked out again. Nulls have no id."""
    spark = cells.sparkSession
    for _ in range(tries):
        known = commits.log(spark, path)
        if any(x["batch"] == batch for x in known):
            break
        start = known[-1]["next"] if known else 0
        new = materialize(cells.where("value is not null").select("value").distinct().join(read(spark, path), "value", "left_anti"))
        n = new.count()
        numbered = row_numbers(new, ["value"], "_at").select("value", (F.col("_at") + start).alias("id")) if n else new.select("value", F.lit(0).cast("long").alias("id"))
        try:
            commits.append(numbered, path, lambda df, folder: df.write.parquet(folder), batch, expect=len(known), next=start + n)
            break
        except commits.Conflict:
            continue
        finally:
            discard(new)
    else:
        raise commits.Conflict(path)
    return read(spark, path)


def encode(cells: DataFrame, words: DataFrame) -> DataFrame:
    """cells with ids in place of values."""
    return cells.join(words, "value").drop("value").withColumnRenamed("id", "value")
