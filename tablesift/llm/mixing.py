"""Mixing sources to target weights by Sainte-Laguë apportionment.

The mix is cut into equal-token blocks of one word. Blocks go to sources by the highest quotients target/(2i+1),
then, the same way, from each source to its shards by size: integer quotas, so a source is off by about one word whatever
the size of the mix. Within a shard the documents stand in a seeded order, end to end; the quota takes whole laps of that
line and then its first words. Only sums per source and per shard reach the driver (one row per source, and about `SHARDS`
in all, or fewer); no task sorts more than one shard.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, small, table

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: A shard has about so many documents; in a corpus of more than SHARDS times as many, as many more as make about SHARDS shards in all.
DOCS_PER_SHARD = 250
SHARDS = 100_000
SEED = 20240607


def targets(sizes: list[int], weights: list[float], most: float = MAX_REPEATS) -> list[float]:
    """Shares of sum(sizes) by weight, stopped at `most` times the own size; the excess goes to the
    others by weight, again and again until none is above. Zero for all if there is nothing."""
    out, open_ = [0.0] * len(sizes), list(range(len(sizes)))
    left = float(sum(sizes))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        for i in over or open_:
            out[i] = most * float(sizes[i]) if over else unit * weights[i]
        if not over:
            break
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def sainte_lague(votes: list[float], seats: int) -> list[int]:
    """Seats by highest quotients votes/(2i+1); ties go to the earlier entry. No votes, no seats.

    All quotients above a divisor that leaves seats over are dealt at once; about one seat per entry is left to the heap.
    """
    out, total = [0] * len(votes), sum(votes)
    if total <= 0:
        return out
    if seats > len(votes):
        divisor = total / (seats - len(votes) / 2) * (1 + 1e-12)
        out = [max(0, math.ceil(v / divisor - 0.5)) for v in votes]
    heap = [(-v / (2 * n + 1), i) for i, (v, n) in enumerate(zip(votes, out)) if v > 0]
    heapq.heapify(heap)
    for _ in range(seats - sum(out)):
        _, i = heap[0]
        out[i] += 1
        heapq.heapreplace(heap, (-votes[i] / (2 * out[i] + 1), i))
    return out


def within(seats: list[int], most: list[int]) -> list[int]:
    """The seats, none above its limit; what is over goes to the entries with room, in order."""
    out = [min(n, m) for n, m in zip(seats, most)]
    over = sum(seats) - sum(out)
    for i, m in enumerate(most):
        if over <= 0:
            break
        more = min(over, m - out[i])
        out[i], over = out[i] + more, over - more
    return out


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """docs: doc_id, text, source, more columns or none. A row for each of its rows: doc_id, source, size
    (words between white space), source_size, target (both of its source), taken (words, repeats counted).

    Null text has size 0 and takes nothing; a null source is a source of its own, the last; rows with equal or
    null doc_id are separate documents (dealt to shards by id and text); an empty table gives an empty result. Texts of any length
    count whole. Other columns are not read. The outcome depends on the rows alone, not on their order or partitions.
    """
    spark = docs.sparkSession
    sized = materialize(docs.select("doc_id", "source", F.xxhash64("doc_id", "text").alias("hash"), F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size")), "sizes")
    sums = sorted(sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect(), key=lambda r: (r["source"] is None, r["source"] or ""))
    goal = targets([r["size"] for r in sums], [weights[i % len(weights)] for i in range(len(sums))])
    seats = within(sainte_lague(goal, sum(r["size"] for r in sums)), [MAX_REPEATS * r["size"] for r in sums])
    per_shard = max(DOCS_PER_SHARD, -(-sum(r["n"] for r in sums) // SHARDS))
    plan = [(r["source"], r["size"], t, -(-r["n"] // per_shard)) for r, t in zip(sums, goal)]
    sources = spark.createDataFrame(plan, "s string, source_size long, target double, shards int")
    at = sized.join(small(sources, 100_000), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    at = at.withColumn("shard", F.pmod(F.xxhash64("hash", F.lit(seed)), "shards").cast("int"))
    by_shard: dict[str | None, list[tuple[int, int]]] = {}
    for r in sorted(at.groupBy("source", "shard").agg(F.sum("size").alias("size")).collect(), key=lambda r: r["shard"]):
        by_shard.setdefault(r["source"], []).append((r["shard"], r["size"]))
    quotas = []
    for r, n in zip(sums, seats):
        own = by_shard[r["source"]]
        share = within(sainte_lague([s for _, s in own], n), [MAX_REPEATS * s for _, s in own])
        quotas += [(r["source"], shard, size, k) for (shard, size), k in zip(own, share)]
    quota = spark.createDataFrame(quotas, "s string, sh int, shard_size long, quota long")
    at = at.join(small(quota, 2 * SHARDS), F.col("source").eqNullSafe(F.col("s")) & (F.col("shard") == F.col("sh")))
    line = Window.partitionBy("source", "shard").orderBy(F.xxhash64("hash", F.lit(seed + 1)), "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    at = at.withColumn("start", F.sum("size").over(line) - F.col("size"))
    laps = F.when(F.col("shard_size") > 0, F.expr("quota div shard_size")).otherwise(F.lit(0))
    part = F.when(F.col("shard_size") > 0, F.greatest(F.lit(0), F.least(F.col("size"), F.expr("quota % shard_size") - F.col("start")))).otherwise(F.lit(0))
    return at.select("doc_id", "size", "source_size", "target", (laps * F.col("size") + part).cast("long").alias("taken"), "source", "shard")


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


QUERIES = {"op6_sainte_lague_mix": op6_mix}
ORACLE: dict[str, str] = {}
