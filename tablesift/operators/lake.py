"""A lake of heterogeneous tables, and its cells in one long table."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Mode
from ..functions.text import clean, is_num
from .order import row_numbers

CELL_SCHEMA = "table_id int, column_id int, row_id long, value string"


@dataclass
class Lake:
    """Tables by name. A table's id is its place among the names in descending order, unless ids are given."""

    spark: SparkSession
    tables: dict[str, DataFrame]
    given_ids: dict[str, int] | None = None

    @property
    def ids(self) -> dict[str, int]:
        return self.given_ids or {name: i for i, name in enumerate(sorted(self.tables, reverse=True))}

    def dimension(self) -> DataFrame:
        """(table_id, table_name, resource_id)."""
        from ..functions.text import resource_id

        rows = self.spark.createDataFrame([(i, n) for n, i in self.ids.items()], "table_id int, table_name string")
        return rows.withColumn("resource_id", resource_id(F.col("table_name")))

    def cells(self, mode: Mode = "complex", order: dict[str, list[str]] | None = None, indexable: bool = True) -> DataFrame:
        """All tables' cells. Wide tables are never united: each is unpivoted by itself."""
        parts = [unpivot(df, self.ids[name], mode, (order or {}).get(name), indexable) for name, df in self.tables.items()]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], CELL_SCHEMA)


def unpivot(df: DataFrame, table_id: int, mode: Mode = "complex", order: list[str] | None = None, indexable: bool = True) -> DataFrame:
    """(table_id, column_id, row_id, value) of one table. Column ids count all columns; with `indexable`, only those of strings
    take part, and nulls and numbers don't. Rows are numbered by the columns in `order`; without it row_id is null,
    as Spark's rows have no order of their own."""
    numbered = row_numbers(df, order, "_row") if order else df.withColumn("_row", F.lit(None).cast("long"))
    kept = [(i, c) for i, (c, kind) in enumerate(df.dtypes) if kind == "string" or not indexable]
    if not kept:
        return df.sparkSession.createDataFrame([], CELL_SCHEMA)
    each = F.array(*[F.struct(F.lit(i).alias("column_id"), clean(F.col(f"`{c}`"), mode).alias("value")) for i, c in kept])
    cells = numbered.select("_row", F.explode(each).alias("x"))
    cells = cells.select(F.lit(table_id).alias("table_id"), "x.column_id", F.col("_row").alias("row_id"), "x.value")
    return cells.where(F.col("value").isNotNull() & ~is_num(F.col("value"))) if indexable else cells


def long_cells(df: DataFrame, table: str, value: str, mode: Mode = "complex") -> DataFrame:
    """Cells of a lake that lies in one table, `table` telling its members apart: one column each, value `value`."""
    v = clean(F.col(value), mode)
    return df.select(F.col(table).alias("table_id"), F.lit(0).alias("column_id"), v.alias("value")).where(v.isNotNull() & ~is_num(v))


def distinct_values(cells: DataFrame) -> DataFrame:
    return cells.select("value").distinct()


def value_frequency(cells: DataFrame) -> DataFrame:
    """(value, n_columns, n_cells)."""
    once = cells.groupBy("table_id", "column_id", "value").agg(F.count("*").alias("n"))
    return once.groupBy("value").agg(F.count("*").alias("n_columns"), F.sum("n").alias("n_cells"))


def dictionary(cells: DataFrame) -> DataFrame:
    """(value, id): a stable id for each value, its hash; equal on any cluster, and no pass over all values numbers them."""
    return distinct_values(cells).select("value", F.xxhash64("value").alias("id"))


def encode(cells: DataFrame) -> DataFrame:
    return cells.withColumn("value", F.xxhash64("value"))


def decode(encoded: DataFrame, words: DataFrame) -> DataFrame:
    return encoded.withColumnRenamed("value", "id").join(words, "id").drop("id")
