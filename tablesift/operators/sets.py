"""Rows and schemas compared as sets, dedup and deterministic order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import row_numbers


def row_intersection(a: DataFrame, b: DataFrame, columns: int = 3) -> DataFrame:
    """Distinct rows of the first columns that both tables have; columns go by position."""
    return a.select(a.columns[:columns]).intersect(b.select(b.columns[:columns]).toDF(*a.columns[:columns]))


def same_schema(a: DataFrame, b: DataFrame) -> bool:
    """Whether both have the same names and types, in any order: such tables are united, others joined."""
    return set(a.dtypes) == set(b.dtypes)


def common_attributes(a: DataFrame, b: DataFrame) -> list[str]:
    """Names that both have with one type, in the first table's order."""
    other = set(b.dtypes)
    return [name for name, kind in a.dtypes if (name, kind) in other]


def union_common(a: DataFrame, b: DataFrame, distinct: bool = False) -> DataFrame:
    names = common_attributes(a, b)
    out = a.select(*names).unionByName(b.select(*names))
    return out.distinct() if distinct else out


def first_of(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """One row for each key, the first in order (columns, ascending, nulls first; or expressions with a direction). With plain
    columns the rows are aggregated by a 128-bit hash of the key, so long keys are not sorted and a key that most rows have is combined
    before the shuffle."""
    if any(not isinstance(c, str) for c in order):
        return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
    nulls = [F.col(k).isNull() for k in keys]
    group = [F.xxhash64(*keys, *nulls), F.xxhash64(F.lit(7), *keys, *nulls)]
    place = F.struct(*[x for c in order for x in (F.col(c).isNotNull(), F.col(c))])
    return rows.groupBy(*group).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), place).alias("_first")).select("_first.*")


def _seeded(keys: list[str], seed: int) -> Column:
    """A digest that is the same in any engine."""
    return F.md5(F.concat_ws(",", F.lit(seed), *keys))


def shuffled(rows: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """A seeded order of whole rows that is the same on any cluster."""
    return rows.orderBy(_seeded(keys, seed), *keys)


def shuffled_places(rows: DataFrame, keys: list[str], seed: int, name: str = "place") -> DataFrame:
    """rows with their places in the order of `shuffled`, from 0, worked out stretch by stretch."""
    return row_numbers(rows.withColumn("_seeded", _seeded(keys, seed)), ["_seeded", *keys], name).drop("_seeded")


def drawn(rows: DataFrame, keys: list[str], n: int, seed: int, replace: bool = False) -> DataFrame:
    """n rows drawn by seed; with replacement a row may come several times: each draw is the row whose number a hash of the draw gives."""
    if not replace:
        return shuffled(rows, keys, seed).limit(n)
    numbered = row_numbers(rows, keys, "_at")
    total = rows.count()
    if not total:
        return rows.limit(0)
    number = F.conv(F.substring(_seeded(["id"], seed), 1, 15), 16, 10).cast("long")
    return numbered.join(rows.sparkSession.range(n).select((number % total).alias("_at")), "_at").drop("_at")


def slice_rows(rows: DataFrame, keys: list[str], first: int, n: int) -> DataFrame:
    """n rows in the order of keys, from number `first` (0 is the first)."""
    return rows.orderBy(*keys).offset(first).limit(n)
