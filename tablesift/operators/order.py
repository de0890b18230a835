"""Row numbers in a global order without sorting all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _bounds(df: DataFrame, first: str, stretches: int) -> list:
    """Values that divide the rows by the column into about equal stretches: quantiles, or for other types values of a sample of hashes."""
    if isinstance(df.schema[first].dataType, NUMERIC):
        return df.agg(F.percentile_approx(first, [i / stretches for i in range(1, stretches)], F.lit(100 * stretches))).first()[0] or []
    # the least hashes of distinct values are a sample that is the same on any cluster
    sample = df.where(F.col(first).isNotNull()).select(first).distinct().orderBy(F.xxhash64(first), first).limit(20 * stretches)
    found = sample.select(F.sort_array(F.collect_list(first))).first()[0]
    return found[::20] if len(found) > stretches else found


def row_numbers(df: DataFrame, order: list[str], name: str, stretches: int = 64, by: list[str] | None = None) -> DataFrame:
    """Adds `name`: each row's place by the ascending columns, from 0 (nulls first); with `by` within each group of these.

    Rows are dealt into stretches of the first column's range, each sorted by itself, and a stretch's numbers start after the rows of
    those before it; no task sorts a whole group. Only the bounds reach the driver.
    """
    keys = by or []
    bounds = sorted(set(_bounds(df, order[0], stretches)))
    known = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast(f"array<{df.schema[order[0]].dataType.simpleString()}>")
    dealt = df.withColumn("_stretch", F.when(F.col(order[0]).isNull(), F.lit(-1)).otherwise(F.size(F.filter(known, lambda b: b < F.col(order[0])))))
    counts = dealt.groupBy(*keys, "_stretch").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)  # a row for each stretch
    starts = counts.select(*[F.col(k).alias(f"_by_{k}") for k in keys], F.col("_stretch").alias("_s"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy(*keys, "_stretch").orderBy(*order)) - 1
    same = (F.col("_stretch") == F.col("_s"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_by_{k}"))
    out = dealt.withColumn("_place", place).join(starts, same)
    return out.withColumn(name, F.col("_place") + F.col("_start")).drop("_stretch", "_s", "_start", "_place", *[f"_by_{k}" for k in keys])
