"""Connected components of a link table, with the links spread over the cluster throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star contraction; edges have u > v. The minima are written first, so that both sides of
    the join are plain exchanges, whose large partitions Spark can split."""
    seen = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = materialize(seen.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "star")
    both = seen.join(least, "u")
    if large:
        out = both.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = both.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    done = materialize(out.where("u <> v").distinct(), "links")
    discard(least)
    return done


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Columns u, v (long) of links; gives (node, comp): each linked node with its component's
    smallest node, a row for every node but that smallest one. Alternates large-star and small-star
    contractions until nothing changes; the number of rounds grows with the logarithm of the longest path."""
    now = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    state = _state(now)
    for _ in range(rounds if state[0] else 0):
        large = _star(now, True)
        discard(now)
        now = _star(large, False)
        discard(large)
        before, state = state, _state(now)
        if before == state:
            break
    else:
        if state[0]:
            raise RuntimeError(f"components not settled after {rounds} rounds")
    out = now.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    out._tablesift_path = now._tablesift_path
    return out
