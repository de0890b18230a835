"""Column profiles and type inference, one pass over the whole table each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean, clean_names
from ..config import Mode


def infer_types(df: DataFrame) -> dict[str, str]:
    """By column: boolean if it has exactly two distinct values and both read as booleans; else float if any value has a comma
    or dot, int if none has, where all values read as such; else string. Looks at every value, in one aggregation."""
    text = {c: F.col(f"`{c}`").cast("string") for c in df.columns}
    aggs: list[Column] = []
    for i, c in enumerate(text.values()):
        aggs += [
            F.approx_count_distinct(c).alias(f"d{i}"), F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"),
            F.bool_and(c.try_cast("boolean").isNotNull() | c.isNull()).alias(f"b{i}"),
            F.bool_or(F.contains(c, F.lit(",")) | F.contains(c, F.lit("."))).alias(f"p{i}"),
            F.bool_and(c.try_cast("float").isNotNull() | c.isNull()).alias(f"f{i}"), F.bool_and(c.try_cast("int").isNotNull() | c.isNull()).alias(f"i{i}"),
        ]
    # two distinct values: the least and the greatest differ and nothing else occurs
    first = df.agg(*aggs).first()
    between = {i: F.count_if((c != first[f"lo{i}"]) & (c != first[f"hi{i}"])).alias(f"m{i}") for i, c in enumerate(text.values()) if first[f"b{i}"] and first[f"lo{i}"] is not None and first[f"lo{i}"] != first[f"hi{i}"] and first[f"d{i}"] <= 3}
    middle = df.agg(*between.values()).first().asDict() if between else {}
    out = {}
    for i, name in enumerate(df.columns):
        if first[f"lo{i}"] is None:
            out[name] = "void"
        elif middle.get(f"m{i}") == 0:
            out[name] = "boolean"
        elif first[f"p{i}"]:
            out[name] = "float" if first[f"f{i}"] else "string"
        else:
            out[name] = "int" if first[f"i{i}"] else "string"
    return out


def load_table(df: DataFrame, headers: Mode = None, elements: Mode = None) -> DataFrame:
    """A lake table with cleaned headers and cells, inferred types, and without all-null columns."""
    df = df.toDF(*clean_names(df.columns, headers))
    df = df.select(*[clean(F.col(f"`{c}`"), elements).alias(c) for c in df.columns])
    kinds = infer_types(df)
    return df.select(*[F.col(f"`{c}`").try_cast(kinds[c]).alias(c) for c in df.columns if kinds[c] != "void"])


def null_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_id, column_name, n_rows, n_nulls, n_distinct, null_ratio) of each column. Each is counted by value by itself: a columnar
    source is read once in all, rows are not multiplied, and a value that most rows have is combined before the shuffle."""
    columns = columns or df.columns
    each = []
    for i, c in enumerate(columns):
        once = df.groupBy(F.col(f"`{c}`").alias("v")).agg(F.count("*").alias("c"))
        each.append(once.agg(F.lit(i).alias("column_id"), F.lit(c).alias("column_name"), F.coalesce(F.sum("c"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("c"))), F.lit(0)).alias("n_nulls"), F.count("v").alias("n_distinct")))
    return reduce(DataFrame.union, each).withColumn("null_ratio", _null_ratio())


def _null_ratio() -> Column:
    return F.when(F.col("n_rows") > 0, F.round(F.col("n_nulls") / F.col("n_rows"), 6)).otherwise(0.0)


def text_cells(df: DataFrame, table: Column | None = None) -> DataFrame:
    """(table_name, column_id, column_name, value) of all cells as text, nulls too: what `profile_cells` works on."""
    each = F.array(*[F.struct(F.lit(i).alias("column_id"), F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for i, c in enumerate(df.columns)])
    return df.select((table if table is not None else F.lit("")).alias("table_name"), F.explode(each).alias("x")).select("table_name", "x.*")


def profile_cells(cells: DataFrame) -> DataFrame:
    """(table_name, column_id, column_name, n_rows, n_nulls, n_distinct, null_ratio, kind) of every column of a lake, of any number of tables,
    in one job. cells: table_name, column_id, column_name, value.

    Cells are counted by (table, column, value) first; what a value says of its column's type is then merged by column: the
    same ladder as `infer_types`, whose exactly two boolean values are here the exact count of distinct ones.
    """
    column = ["table_name", "column_id", "column_name"]
    v = F.col("value")
    once = cells.groupBy(*column, "value").agg(F.count("*").alias("c"))
    every = lambda x: F.bool_and(x | v.isNull())
    merged = once.groupBy(*column).agg(
        F.sum("c").alias("n_rows"), F.coalesce(F.sum(F.when(v.isNull(), F.col("c"))), F.lit(0)).alias("n_nulls"), F.count(v).alias("n_distinct"),
        every(v.try_cast("boolean").isNotNull()).alias("_b"), F.bool_or(F.contains(v, F.lit(",")) | F.contains(v, F.lit("."))).alias("_p"),
        every(v.try_cast("float").isNotNull()).alias("_f"), every(v.try_cast("int").isNotNull()).alias("_i"),
    )
    kind = (
        F.when(F.col("n_distinct") == 0, "void").when(F.col("_b") & (F.col("n_distinct") == 2), "boolean")
        .when(F.col("_p"), F.when(F.col("_f"), "float").otherwise("string")).when(F.col("_i"), "int").otherwise("string")
    )
    return merged.select(*column, "n_rows", "n_nulls", "n_distinct", _null_ratio().alias("null_ratio"), kind.alias("kind"))


def drop_null_columns(df: DataFrame) -> DataFrame:
    if not df.columns:
        return df
    filled = df.agg(*[F.count(f"`{c}`").alias(str(i)) for i, c in enumerate(df.columns)]).first()
    return df.select(*[f"`{c}`" for i, c in enumerate(df.columns) if filled[i]])


def pin_column(df: DataFrame, name: str, most: int) -> DataFrame:
    """The column first, then the others, `most` in all."""
    return df.select(*[f"`{c}`" for c in [name, *(c for c in df.columns if c != name)][:most]])


#: SQL names of column types; any other is VARCHAR(255).
SQL_TYPES = [((T.ByteType, T.ShortType, T.IntegerType, T.LongType), "BIGINT"), ((T.FloatType, T.DoubleType, T.DecimalType), "FLOAT"), ((T.DateType,), "DATE"), ((T.TimestampType, T.TimestampNTZType), "DATETIME")]


def sql_type(kind: T.DataType) -> str:
    return next((name for kinds, name in SQL_TYPES if isinstance(kind, kinds)), "VARCHAR(255)")


def create_table_sql(df: DataFrame, name: str) -> str:
    columns = ",\n    ".join(f"{f.name} {sql_type(f.dataType)}" for f in df.schema.fields)
    return f"CREATE TABLE {name} (\n    {columns}\n);"


def preview(df: DataFrame, rows: int, seed: int = 0) -> str:
    """So many rows, drawn by hash, as a Markdown table."""
    drawn = df.orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns], F.lit(seed))).limit(rows).collect()
    line = lambda cells: "| " + " | ".join("null" if x is None else str(x) for x in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *(line(r) for r in drawn)])
