"""Statistics over evaluated and generated records."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import row_numbers


def majority(votes: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """The most frequent score of each key; of several the lowest. Unparsable votes (-1) count."""
    return votes.groupBy(*keys).agg(F.mode(score, True).alias(score))


def threshold_counts(scores: DataFrame, score: str, least: int, most: int) -> DataFrame:
    """(threshold, n, ratio) for each whole threshold: how many scores reach it. One count per score, then a running sum from
    the top: no row meets more than one threshold."""
    clipped = F.least(F.floor(score), F.lit(most)).cast("int")
    counts = scores.where(F.col(score).isNotNull()).groupBy(clipped.alias("threshold")).agg(F.count("*").alias("c"))
    grid = scores.sparkSession.range(least, most + 1).select(F.col("id").cast("int").alias("threshold"))
    low = counts.where(F.col("threshold") < least).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("low"))
    filled = grid.join(counts, "threshold", "left").select("threshold", F.coalesce("c", F.lit(0)).alias("c"))
    up = Window.orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(F.lit(0))
    out = filled.select("threshold", F.sum("c").over(up).alias("n"), F.sum("c").over(every).alias("above")).join(F.broadcast(low))
    return out.select("threshold", "n", F.round(F.col("n") / (F.col("above") + F.col("low")), 6).alias("ratio"))


def threshold_join(a: DataFrame, b: DataFrame, names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Two threshold tables side by side."""
    x, y = (df.select("threshold", F.col("n").alias(f"n_{n}"), F.col("ratio").alias(f"ratio_{n}")) for df, n in zip((a, b), names))
    return x.join(y, "threshold")


def running_rate(rows: DataFrame, order: list[str], success: str, step: int, by: list[str] | None = None) -> DataFrame:
    """(by..., n_rows, rate): the success rate of the first `step`, 2 `step`, ... rows. Rows are counted in blocks first, so
    that only one row per block is summed in order."""
    keys = by or []
    numbered = row_numbers(rows, order, "i", by=by).select(*keys, F.col(success).cast("double").alias("s"), "i")
    block = numbered.groupBy(*keys, F.floor(F.col("i") / step).alias("b")).agg(F.count("*").alias("c"), F.sum("s").alias("s"))
    # blocks of blocks: their sums come before each block's own running sum
    wide = block.withColumn("w", F.floor(F.col("b") / 1000))
    sums = wide.groupBy(*keys, "w").agg(F.sum("c").alias("wc"), F.sum("s").alias("ws"))
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("w").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("w").alias("_w"), *[F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(x) for x in ("wc", "ws")])
    up = Window.partitionBy(*keys, "w").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("w") == F.col("_w")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    run = wide.withColumns({"c": F.sum("c").over(up), "s": F.sum("s").over(up)}).join(sums, same)
    n = F.col("c") + F.col("wc")
    return run.select(*keys, n.alias("n_rows"), F.round((F.col("s") + F.col("ws")) / n, 6).alias("rate"))


def counts_with_total(rows: DataFrame, key: str, total: str = "total") -> DataFrame:
    """Counts by key, and one row for all."""
    out = rows.rollup(key).agg(F.count("*").alias("n"), F.grouping(key).alias("_all"))
    return out.select(F.when(F.col("_all") == 1, F.lit(total)).otherwise(F.col(key)).alias(key), "n")


def pivot_counts(rows: DataFrame, index: str, tag: str, values: list[str]) -> DataFrame:
    """Counts by index, a column for each value of the tag; none is 0."""
    return rows.groupBy(index).pivot(tag, values).count().na.fill(0, values)


def success_rates(rows: DataFrame, process: str, success: str) -> DataFrame:
    """(n_processes, n_success, mean_rate): successes in all, and the mean of the processes' own rates, however many rows each has."""
    each = rows.groupBy(process).agg(F.sum(F.col(success).cast("long")).alias("n"), F.avg(F.col(success).cast("double")).alias("rate"))
    return each.agg(F.count("*").alias("n_processes"), F.sum("n").alias("n_success"), F.round(F.avg("rate"), 6).alias("mean_rate"))


def table_shapes(shapes: DataFrame) -> DataFrame:
    """shapes: n_rows, n_columns of each table. Their number, and mean and deviation of both."""
    return shapes.agg(F.count("*").alias("n_tables"), *[x.alias(f"{name}_{c}") for c in ("rows", "columns") for name, x in (("mean", F.round(F.avg(f"n_{c}"), 6)), ("std", F.round(F.stddev_samp(f"n_{c}"), 6)))])


def mean_std(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_samp(value), 6).alias("std"))


#: Buckets that a range of values is divided into at once.
BUCKETS = 1024


def order_statistics(rows: DataFrame, wanted: dict[str, set[int]], bounds: dict[str, tuple[float, float]]) -> dict[tuple[str, int], float]:
    """The values at the wanted places (from 0) in the ascending order of numeric columns, exactly; nulls take no place. bounds: a column's
    least and greatest value.

    Selection by counting: the range that holds a place is divided into BUCKETS, a job counts the rows of all ranges of all columns by
    bucket, with each bucket's own least and greatest value, and the bucket of the place is the next range, until it holds one
    value. Ranges are divided by magnitude first, so outliers cost no passes, and evenly then: two or three passes as a rule.
    Nothing is sorted; what a job returns is bounded by ranges and buckets.
    """
    open_ = {(c, k): (*bounds[c], k) for c, places in wanted.items() for k in places}
    out: dict[tuple[str, int], float] = {}
    first = True
    while True:
        out |= {key: lo for key, (lo, hi, _) in open_.items() if lo == hi}
        open_ = {key: x for key, x in open_.items() if x[0] != x[1]}
        if not open_:
            return out
        ranges = sorted({(c, lo, hi) for (c, _), (lo, hi, _) in open_.items()})
        cells = []
        for i, (c, lo, hi) in enumerate(ranges):
            x = F.col(f"`{c}`").cast("double")
            size = lambda v: F.signum(v) * F.log1p(F.abs(v))
            y, a, b = (size(x), size(F.lit(lo)), size(F.lit(hi))) if first else (x / 2, F.lit(lo / 2), F.lit(hi / 2))
            part = F.least(F.lit(BUCKETS - 1), F.greatest(F.lit(0), F.floor((y - a) / (b - a) * BUCKETS)))
            cells.append(F.when(x.between(lo, hi), F.struct(F.lit(i).alias("range"), F.coalesce(part, F.lit(0)).cast("int").alias("bucket"), x.alias("x"))))
        each = rows.select(F.explode(F.filter(F.array(*cells), lambda v: v.isNotNull())).alias("v")).select("v.*")
        found: dict[int, list] = {}
        for r in each.groupBy("range", "bucket").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("range", "bucket").collect():
            found.setdefault(r["range"], []).append(r)
        place = {x: i for i, x in enumerate(ranges)}
        later = {}
        for (c, k), (lo, hi, at) in open_.items():
            for r in found[place[c, lo, hi]]:
                if at < r["n"]:
                    later[c, k] = (r["lo"], r["hi"], at)
                    break
                at -= r["n"]
        open_, first = later, False


def quantiles(rows: DataFrame, columns: list[str], points: tuple[float, ...], known: dict[str, tuple[int, float | None, float | None]] | None = None) -> dict[str, list[float | None]]:
    """Exact quantiles of numeric columns, interpolated between neighbours; None for a column without values. known: each column's count,
    least and greatest value."""
    if known is None:
        x = [F.col(f"`{c}`").cast("double") for c in columns]
        one = rows.agg(*[f(v).alias(f"{i}_{n}") for i, v in enumerate(x) for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
        known = {c: (one[f"{i}_n"], one[f"{i}_lo"], one[f"{i}_hi"]) for i, c in enumerate(columns)}
    at = {c: [p * (known[c][0] - 1) for p in points] for c in columns if known[c][0]}
    found = order_statistics(rows, {c: {f(x) for x in places for f in (math.floor, math.ceil)} for c, places in at.items()}, {c: known[c][1:] for c in at})
    value = lambda c, x: found[c, math.floor(x)] * (1 - x % 1) + found[c, math.ceil(x)] * (x % 1)
    return {c: [value(c, x) for x in at[c]] if c in at else [None] * len(points) for c in columns}


def describe(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n, n_nulls, mean, std, min, q25, q50, q75, max), quartiles exact and interpolated. NaN counts as null."""
    name = lambda c: F.col(f"`{c}`")
    kinds = dict(rows.dtypes)
    rows = rows.select(*[(F.when(~F.isnan(name(c)), name(c)) if kinds[c] in ("double", "float") else name(c)).alias(c) for c in columns])
    parts = (("n", F.count), ("nulls", lambda c: F.count_if(c.isNull())), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))
    one = rows.agg(*[(f(name(c)) if k in ("n", "nulls") else f(name(c)).cast("double")).alias(f"{i}_{k}") for i, c in enumerate(columns) for k, f in parts]).first()
    get = [{k: one[f"{i}_{k}"] for k, _ in parts} for i in range(len(columns))]
    found = quantiles(rows, columns, (0.25, 0.5, 0.75), {c: (g["n"], g["min"], g["max"]) for c, g in zip(columns, get)})
    values = [(c, g["n"], g["nulls"], g["mean"], g["std"], g["min"], *found[c], g["max"]) for c, g in zip(columns, get)]
    out = rows.sparkSession.createDataFrame(values, "column_name string, n long, n_nulls long, mean double, std double, min double, q25 double, q50 double, q75 double, max double")
    return out.select(*[c if i < 3 else F.round(c, 6).alias(c) for i, c in enumerate(out.columns)])


def t_test(mean: float, std: float, n: int, null: float = 0.0) -> tuple[float, float]:
    """One-sample t statistic and two-tailed p-value, on the driver."""
    t = (mean - null) / (std / math.sqrt(n))
    return t, _beta_tail((n - 1) / 2, 0.5, (n - 1) / (n - 1 + t * t))


def _beta_tail(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    c, d = 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1))
    out = d
    for m in range(1, 500):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + k * d)
            c = 1 + k / c
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


def error_classes(records: DataFrame, message: str = "message") -> DataFrame:
    from ..functions.text import error_class

    return records.where(F.startswith(F.col(message), F.lit("ERROR")) | F.startswith(F.col(message), F.lit("FAILURE"))).groupBy(error_class(F.col(message)).alias("error_class")).agg(F.count("*").alias("n"))
