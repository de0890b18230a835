"""Incremental cell index: a file stream of long tables appended to the index, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.lake import long_cells


def append_cells(spark: SparkSession, source: str, schema: str, table: str, value: str, target: str, checkpoint: str) -> StreamingQuery:
    """Cells of each file that appears under source go to target, once: a batch overwrites its own folder, so a batch that is run
    again after a failure leaves no duplicates."""
    rows = spark.readStream.schema(schema).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        long_cells(batch, table, value).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
