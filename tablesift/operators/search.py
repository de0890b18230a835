"""Joinable-column search: all columns against all, by their distinct values in common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Search
from ..sources.exchange import discard, materialize, small
from . import tiles

KEYS = ["table_id", "column_id"]
PAIR = ["r_table_id", "r_column_id", "s_table_id", "s_column_id"]
#: Columns with one value that a task pairs with others at once.
BLOCK = 512
#: Rows of a value of more columns than these are dealt into parts.
HOT = 8192
BROADCAST_ROWS = 100_000
#: Columns (two numbers each) that a filter on the index may be sent for.
BROADCAST_COLUMNS = 1_000_000


def columns_of(cells: DataFrame) -> DataFrame:
    """(table_id, column_id, value), distinct: what every search below works on."""
    return cells.select(*KEYS, "value").distinct()


def sizes(columns: DataFrame) -> DataFrame:
    return columns.groupBy(*KEYS).agg(F.count("*").alias("n"))


def side(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(c if c == "value" else f"{prefix}_{c}") for c in df.columns])


def pairs_by_value(rows: DataFrame, df: str) -> DataFrame:
    """(value, r_*, s_*): pairs of rows (KEYS, value, df, more) of one value and different tables, r before s. df: how many rows have the value.

    The rows of a value are dealt into blocks of about BLOCK, and pairs of blocks are the join's key, so a value that a third of all
    columns have makes many tasks.
    """
    blocks = F.ceil(F.col(df) / BLOCK).cast("int")
    dealt = rows.withColumn("_n", blocks).withColumn("_own", F.pmod(F.xxhash64(*KEYS), F.col("_n")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    both = {}
    for x, names in (("r", ["_own", "_other"]), ("s", ["_other", "_own"])):
        own = [F.col(c).alias(c if c == "value" else f"{x}_{c}") for c in rows.columns if c != df]
        both[x] = dealt.select(*rows.columns, "_own", every.alias("_other")).select(*own, F.col(names[0]).alias("_b"), F.col(names[1]).alias("_c"))
    return both["r"].join(both["s"], ["value", "_b", "_c"]).where("r_table_id < s_table_id").drop("_b", "_c")


def overlaps(columns: DataFrame) -> DataFrame:
    """(r_*, s_*, k): pairs of columns of different tables, r before s, with the number of values in common. Values of one
    column only can't match and go before the join; the pairs of a value are counted as they are made."""
    shared = columns.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    return pairs_by_value(columns.join(shared, "value"), "df").groupBy(*PAIR).agg(F.count("*").alias("k"))


def meet(own: DataFrame, columns: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """(value, r_*, s_*): rows of own (value, r_*) with the rows of columns (value, s_*) that have their value, of other tables.

    Where columns is a table bucketed by value, or own is derived from it too, neither side is moved. hot (value, n): values of many
    columns, apart from the others: their rows are dealt into n parts, and own's rows go to each part.
    """
    other = F.col("r_table_id") != F.col("s_table_id")
    if hot is None:
        return own.join(columns, "value").where(other)
    rest = own.join(hot, "value", "left_anti").join(columns, "value")
    left = own.join(hot, "value").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")
    right = columns.join(hot, "value").withColumn("_part", F.pmod(F.xxhash64("s_table_id", "s_column_id"), "n").cast("int")).drop("n")
    return rest.unionByName(left.join(right, ["value", "_part"]).drop("_part")).where(other)


def hot_values(columns: DataFrame, most: int = HOT) -> DataFrame | None:
    """(value, n): values that more than `most` columns have, and into how many parts their rows are dealt; None if there are none."""
    found = columns.groupBy("value").agg(F.count("*").alias("df")).where(F.col("df") > most)
    found = materialize(found.select("value", F.ceil(F.col("df") / most).cast("int").alias("n")))
    n = found.limit(BROADCAST_ROWS + 1).count()
    return None if not n else F.broadcast(found) if n <= BROADCAST_ROWS else found


def probe_overlaps(columns: DataFrame, probes: DataFrame, hot: int = HOT) -> DataFrame:
    """(r_*, s_*, k): each probe column (KEYS) with every column of another table, and how many values they have in common. Only rows of
    values that a probe has are paired, with the probes' rows alone. On the persisted index nothing of the index is shuffled but the
    counts of pairs (and the rows of values of more than `hot` columns)."""
    own = columns.join(small(probes.select(*KEYS).distinct(), BROADCAST_ROWS), KEYS, "left_semi")
    return meet(side(own, "r"), side(columns, "s"), hot_values(columns, hot)).groupBy(*PAIR).agg(F.count("*").alias("k"))


def both_ways(pairs: DataFrame) -> DataFrame:
    flip = [F.col(c).alias(("s" if c[0] == "r" else "r") + c[1:] if c[:2] in ("r_", "s_") else c) for c in pairs.columns]
    return pairs.unionByName(pairs.select(*flip))


def best(pairs: DataFrame, k: int) -> DataFrame:
    """For each column r the k others with most values in common; ties by table and column."""
    order = Window.partitionBy("r_table_id", "r_column_id").orderBy(F.desc("k"), "s_table_id", "s_column_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(pairs: DataFrame, k: int) -> DataFrame:
    """`best` of pairs that are there once."""
    return best(both_ways(pairs), k)


def measured(pairs: DataFrame, n: DataFrame) -> DataFrame:
    """Pairs with sizes, union, jaccard and overlap, both to three places."""
    out = pairs.join(side(n, "r").withColumnRenamed("r_n", "size_r_col"), ["r_table_id", "r_column_id"]).join(side(n, "s").withColumnRenamed("s_n", "size_s_col"), ["s_table_id", "s_column_id"])
    return _rates(out)


def _rates(out: DataFrame) -> DataFrame:
    union = F.col("size_r_col") + F.col("size_s_col") - F.col("k")
    return out.withColumns({
        "size_union": union, "jaccard": F.round(F.col("k") / union, 3), "overlap": F.round(F.col("k") / F.least("size_r_col", "size_s_col"), 3),
    }).withColumnRenamed("k", "size_intersection")


def candidates(cells: DataFrame, profile: DataFrame, settings: Search = Search(), packages: DataFrame | None = None, indexed: bool = False) -> DataFrame:
    """Column pairs worth evaluating. indexed: cells are the persisted index table (see `files.write_index`), which then stays where it
    is: filters by column are broadcast, and values meet bucket by bucket. Otherwise the columns' values are written out once.

    profile: table_id, column_id, column_name, n_rows, null_ratio, and headers (the table's sorted cleaned headers) where schemas are
    compared. packages: table_id, package_id; tables without one, and pairs of one package, are left out.
    """
    fit = profile.where((F.col("n_rows") >= settings.min_height) & (F.col("null_ratio") < settings.max_null_ratio))
    if packages is not None:
        fit = fit.join(packages, "table_id")
    fit = materialize(fit)
    budget = fit.select("table_id").distinct().orderBy("table_id").limit(settings.budget) if settings.budget else fit.select("table_id").distinct()
    bad = "|".join(settings.bad_header_tokens)
    probes = materialize(fit.join(budget, "table_id", "left_semi").where(~F.lower("column_name").rlike(bad) if bad else F.lit(True)).select(*KEYS))
    columns = columns_of(cells)
    columns = columns if indexed else materialize(columns)
    n = materialize(sizes(columns).where(F.col("n") >= settings.min_distinct).join(fit.select(*KEYS), KEYS, "left_semi"))
    columns = columns.join(small(n.select(*KEYS), BROADCAST_COLUMNS), KEYS, "left_semi")
    found = best(probe_overlaps(columns, probes), settings.k).drop("rank")
    out = measured(found, n).where((F.col("jaccard") >= settings.min_jaccard) & (F.col("overlap") >= settings.min_overlap))
    extra = [c for c in fit.columns if c not in ("n_rows", "null_ratio")]
    out = out.join(side(fit.select(*extra), "r"), ["r_table_id", "r_column_id"]).join(side(fit.select(*extra), "s"), ["s_table_id", "s_column_id"])
    if packages is not None:
        out = out.where(F.col("r_package_id") != F.col("s_package_id"))
    if not settings.accept_same_schema and "headers" in fit.columns:
        out = out.where(F.col("r_headers") != F.col("s_headers"))
    if settings.dedup:
        r, s = (F.struct(F.col(f"{x}_table_id").alias("t"), F.col(f"{x}_column_id").alias("c")) for x in "rs")
        pair = Window.partitionBy(F.least(r, s), F.greatest(r, s)).orderBy("r_table_id", "r_column_id")
        out = out.withColumn("_first", F.row_number().over(pair)).where("_first = 1").drop("_first")
    return out.drop("r_headers", "s_headers")


def similar_columns(columns: DataFrame, jaccard: float) -> DataFrame:
    """All pairs of columns of different tables with a (rounded) jaccard of at least so much."""
    return similar_sets(tiles.value_sets(columns), jaccard)


def similar_sets(sets: DataFrame, jaccard: float) -> DataFrame:
    """`similar_columns` of sets of values' ids (KEYS, ids): all against all, tile by tile, but for sizes that differ too much. At low
    thresholds nearly every pair shares some frequent value, so pairs are counted in matrices instead of being joined as rows."""
    return _rates(tiles.pairs_within(sets, jaccard - 0.0005)).where(F.col("jaccard") >= jaccard)  # the rounded value is compared


def top_k_sets(sets: DataFrame, probes: Column, k: int) -> DataFrame:
    """`best` for the sets of values' ids (KEYS, ids) that `probes` holds for, among all others, tile by tile: for probes whose k-th best
    shares few values, which no early stop can tell from the rest."""
    return best(tiles.best_within(sets, probes, k), k)


def top_k_early(columns: DataFrame, probes: DataFrame, k: int, first: int = 1 << 16, growth: int = 4) -> tuple[DataFrame, dict[str, int]]:
    """`best` for the probe columns (KEYS), exactly, without reading the posting lists of most frequent values; and what it cost.

    A probe's values are taken in order of frequency, by powers of two, rarest first. When those up to some frequency are done, a column
    met c times can reach c + rest, one not met yet only rest, where rest is the number of values left. As soon as rest is below the
    probe's k-th best count, its candidates are complete, and those that still reach that count are completed by looking their
    remaining values up. A round takes posting lists until their cost (rows read by all probes) has grown `growth`-fold, starting from
    `first`, so there are few rounds; a row for each power of two is all that reaches the driver.

    The cost: `pairs` made from posting lists, `looked_up` values of candidates, `all_pairs` that whole lists would have made.
    """
    r, s = PAIR[:2], PAIR[2:]
    level = F.floor(F.log2("df")).cast("int").alias("level")
    freq = columns.groupBy("value").agg(F.count("*").alias("df"))
    lists = materialize(columns.join(freq, "value").select("value", *KEYS, level, "df"))
    own = side(lists.join(small(probes.select(*KEYS).distinct(), BROADCAST_ROWS), KEYS, "left_semi").select("value", *KEYS), "r").join(lists.select("value", "level", "df").distinct(), "value")
    own = materialize(own)
    each = materialize(own.groupBy(*r, "level").agg(F.count("*").alias("n"), F.sum("df").alias("cost")))
    cost = {x["level"]: x["cost"] for x in each.groupBy("level").agg(F.sum("cost").alias("cost")).collect()}
    spent = {"pairs": 0, "looked_up": 0, "all_pairs": sum(cost.values())}
    open_ = materialize(own.select(*r).distinct())
    met, done, at, budget = None, [], -1, first
    while at < max(cost, default=-1):
        begin, at, total = at, at + 1, cost.get(at + 1, 0)
        while at < max(cost) and total + cost.get(at + 1, 0) <= budget:
            at += 1
            total += cost.get(at, 0)
        budget *= growth
        now = F.col("level").between(begin + 1, at)
        asked = own.where(now).join(open_, r, "left_semi").select("value", *r)
        new = meet(asked, side(lists.where(now).select("value", *KEYS), "s")).groupBy(*r, *s).agg(F.count("*").alias("c"))
        if met is not None:
            new = met.join(open_, r, "left_semi").unionByName(new).groupBy(*r, *s).agg(F.sum("c").alias("c"))
        counts = materialize(new)
        spent["pairs"] += asked.join(lists.where(now).select("value", "df").distinct(), "value").agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
        rest = open_.join(each.where(F.col("level") > at).groupBy(*r).agg(F.sum("n").alias("rest")), r, "left").select(*r, F.coalesce("rest", F.lit(0)).alias("rest"))
        order = Window.partitionBy(*r).orderBy(F.desc("c"))
        kth = counts.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= k).groupBy(*r).agg(F.when(F.count("*") == k, F.min("c")).otherwise(0).alias("kth"))
        state = materialize(rest.join(kth, r, "left").select(*r, "rest", F.coalesce("kth", F.lit(0)).alias("kth")))
        left = counts.join(state, r).where("c + rest >= kth")
        ended = (F.col("rest") == 0) | (F.col("rest") < F.col("kth"))
        done.append(materialize(left.where(ended).select(*r, *s, "c", F.lit(at).alias("level"), "rest")))
        met, before = materialize(left.where(~ended).select(*r, *s, "c")), met
        discard(*[x for x in (before, counts) if x is not None])
        open_ = materialize(state.where(~ended).select(*r))
        if not open_.limit(1).count():
            break
    if not done:
        return best(own.select(*r, *[F.col(f"r_{c[2:]}").alias(c) for c in s], F.lit(0).cast("long").alias("k")).limit(0), k), spent
    found = done[0]
    for x in done[1:]:
        found = found.unionByName(x)
    asked = materialize(found.where("rest > 0").withColumnRenamed("level", "upto").join(own.select("value", "level", *r), r).where("level > upto").select("value", *r, *s))
    spent["looked_up"] = asked.count()
    more = asked.join(side(lists.select("value", *KEYS), "s"), ["value", *s]).groupBy(*r, *s).agg(F.count("*").alias("more"))
    whole = found.join(more, [*r, *s], "left").select(*r, *s, (F.col("c") + F.coalesce("more", F.lit(0))).alias("k"))
    return best(whole, k), spent
