"""SimHash near-duplicates: a binary-trie self-join over the distinct fingerprints.

Two fingerprints within `BUDGET` bits agree on one of four 16-bit blocks, and, of the 48 bits left,
on one of four 12-bit blocks. Each of the 16 choices rotates those 28 bits to the front of the
fingerprint, so that every wanted pair meets below one trie node of depth 28 in one choice at least. That is how the join is
dealt out; a node with more than `BUCKET` fingerprints is dealt out further, as pairs of its descendants whose
further bits differ by no more than the budget. Below these nodes, node pairs are traversed together, a level at a time; each pair carries the bits
in which its two prefixes differ, and is pruned beyond the budget. Pairs of subtrees that are
already one component are pruned too, so a ball of many fingerprints gives a spanning set of links,
not all its pairs. Exact copies share a fingerprint and count as one leaf.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_LOWER, byte_texts, discard, map_rows, materialize, slices, table
from .graph import connected_components

SHINGLE = 3
BUDGET = 3
SEED = 42
#: (first bit, length) of the blocks of the first and, within the 48 bits left, of the second choice.
BLOCKS, SUB = [(0, 16), (16, 16), (32, 16), (48, 16)], [(0, 12), (12, 12), (24, 12), (36, 12)]
TAIL = 36
#: A node with more fingerprints is split, by DEEPEST further bits at most.
BUCKET, DEEPEST = 1 << 16, 12
#: Node pairs held at once by a task.
FRONTIER = 1 << 20


def simhash(text: bytes, n: int = SHINGLE) -> int:
    """Fingerprint of a UTF-8 text, as an unsigned 64-bit number; zero if it has no words."""
    words = text.translate(ASCII_LOWER).split()
    if not words:
        return 0
    digest, total, ones = xxhash.xxh64_intdigest, 0, np.zeros(64, dtype=np.int64)
    if len(words) <= n:
        hashes = iter([digest(b" ".join(words), SEED)])
    else:
        hashes = (digest(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(n))))
    left = max(1, len(words) - n + 1)
    while left:
        h = np.fromiter(hashes, dtype="<u8", count=min(left, 1 << 15)) if left > 1 << 15 else np.fromiter(hashes, dtype="<u8")
        ones += bit_counts(h)
        total, left = total + len(h), left - len(h)
    return majority(ones, total)


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits."""
    return np.unpackbits(h.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(ones: np.ndarray, total: int) -> int:
    """The fingerprint: bits set in over half the hashes."""
    return int.from_bytes(np.packbits(ones * 2 > total, bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1, 8 << 20):
        prints = np.array([simhash(t) for t in byte_texts(batch.column(1))], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=["doc_id", "fp"])


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of a[i] and b[i]; parent holds the smallest member of each set, settled."""
    while len(a):
        a, b = parent[a], parent[b]
        differ = a != b
        a, b = np.maximum(a, b)[differ], np.minimum(a, b)[differ]
        np.minimum.at(parent, a, b)
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up


def _mixed(parent: np.ndarray, lo: np.ndarray, hi: np.ndarray, lo2: np.ndarray, hi2: np.ndarray) -> np.ndarray:
    """Whether the leaves of a pair of subtrees still lie in more than one set."""
    change = np.concatenate([[0], np.cumsum(parent[1:] != parent[:-1])])
    return (change[lo] != change[hi - 1]) | (change[lo2] != change[hi2 - 1]) | (parent[lo] != parent[lo2])


def trie_links(bucket: np.ndarray, value: np.ndarray, bits: int = TAIL, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of links that connect, within each bucket, whatever lies within the budget.
    The input is sorted by bucket, then value (distinct, of so many bits)."""
    n = len(value)
    parent = np.arange(n)
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if n else np.zeros(0, dtype=np.int64)
    ends = np.append(starts[1:], n)
    starts, ends = starts[ends - starts > 1], ends[ends - starts > 1]
    stack = [(bits - 1, starts, ends, starts, ends, np.zeros(len(starts), dtype=np.int8))]
    ones: dict[int, np.ndarray] = {}
    while stack:
        bit, alo, ahi, blo, bhi, err = stack.pop()
        if len(alo) > FRONTIER:  # the halves one after the other, so memory stays bounded
            half = len(alo) // 2
            stack += [(bit, *(x[half:] for x in (alo, ahi, blo, bhi, err))), (bit, *(x[:half] for x in (alo, ahi, blo, bhi, err)))]
            continue
        keep = (ahi > alo) & (bhi > blo) & (err <= budget) & ~((alo == blo) & (ahi - alo == 1))
        if len(alo) > 4096:
            keep[keep] = _mixed(parent, alo[keep], ahi[keep], blo[keep], bhi[keep])
        alo, ahi, blo, bhi, err = (x[keep] for x in (alo, ahi, blo, bhi, err))
        if not len(alo):
            continue
        leaf = (ahi - alo == 1) & (bhi - blo == 1)
        if leaf.any():
            i, j = alo[leaf], blo[leaf]
            near = np.bitwise_count(value[i] ^ value[j]) <= budget
            _union(parent, i[near], j[near])
            alo, ahi, blo, bhi, err = (x[~leaf] for x in (alo, ahi, blo, bhi, err))
            if not len(alo):
                continue
        if bit not in ones:
            ones[bit] = np.concatenate([[0], np.cumsum((value >> np.uint64(bit)) & np.uint64(1))]).astype(np.int64)
        count = ones[bit]
        amid, bmid = ahi - (count[ahi] - count[alo]), bhi - (count[bhi] - count[blo])
        other = ~((alo == blo) & (ahi == bhi))
        cat = np.concatenate
        stack.append((
            bit - 1,
            cat([alo, amid, alo, amid[other]]), cat([amid, ahi, amid, ahi[other]]),
            cat([blo, bmid, bmid, blo[other]]), cat([bmid, bhi, bhi, bmid[other]]),
            cat([err, err, err + 1, err[other] + 1]),
        ))
    i = np.flatnonzero(parent != np.arange(n))
    return i, parent[i]


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, tail, fp) sorted by key and tail; what a batch holds of its last bucket waits for the next one."""
    wait: list[list[np.ndarray]] = []

    def links() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in _linked(*(np.concatenate(x) for x in zip(*wait)))], names=["u", "v"])

    for batch in batches:
        now = [np.asarray(c) for c in batch.columns]
        if not len(now[0]):
            continue
        last = now[0][-1]
        cut = np.searchsorted(now[0], last)
        if wait and wait[-1][0][-1] != last:
            wait.append([x[:cut] for x in now])
            yield links()
            wait = []
        elif cut:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _linked(*(x[:cut] for x in now))], names=["u", "v"])
        wait.append([x[cut:] for x in now])
    if wait:
        yield links()


def _linked(key: np.ndarray, tail: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    i, j = trie_links(key, tail.view(np.uint64))
    return fp[i], fp[j]


def _choices(fp: F.Column) -> list[F.Column]:
    """(key, tail) of each choice of blocks: key has the choice and 28 bits, tail the other 36."""

    def cut(x: F.Column, width: int, at: int, length: int) -> tuple[F.Column, F.Column]:
        block = F.shiftrightunsigned(x, at).bitwiseAND(F.lit((1 << length) - 1))
        low = x.bitwiseAND(F.lit((1 << at) - 1)) if at else F.lit(0).cast("long")
        high = F.shiftrightunsigned(x, at + length) if at + length < width else F.lit(0).cast("long")
        return block, F.shiftleft(high, at).bitwiseOR(low)

    out = []
    for i, (at, length) in enumerate(BLOCKS):
        first, rest = cut(fp, 64, at, length)
        for j, (at2, length2) in enumerate(SUB):
            second, tail = cut(rest, 48, at2, length2)
            out.append(F.struct((F.lit((4 * i + j) << 28).cast("long") + F.shiftleft(first, 12) + second).alias("key"), tail.alias("tail")))
    return out


def _split(spread: DataFrame) -> DataFrame:
    """Rows (key, tail, fp) with those of nodes beyond BUCKET dealt out by b further bits: to each pair of descendants that the row's
    own is part of and that differ in no more than BUDGET of these bits. key grows by 2 DEEPEST bits for the pair."""
    large = materialize(spread.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET), "large")
    wide = spread.withColumn("key", F.shiftleft("key", 2 * DEEPEST))
    if not large.limit(1).count():
        return wide
    bits = large.select("key", F.least(F.lit(DEEPEST), F.ceil(F.log2(F.col("n") / BUCKET)) + 1).cast("int").alias("b"))
    small_ = spread.join(bits, "key", "left_anti").withColumn("key", F.shiftleft("key", 2 * DEEPEST)).select("key", "tail", "fp")
    near = F.array(*[F.lit(m) for m in range(1 << DEEPEST) if m.bit_count() <= BUDGET])
    rows = spread.join(bits, "key").withColumn("own", F.expr(f"shiftrightunsigned(tail, {TAIL} - b)").cast("int"))
    rows = rows.withColumn("other", F.explode(F.transform(F.filter(near, lambda m: m < F.expr("shiftleft(1, b)")), lambda m: m.bitwiseXOR(F.col("own")))))
    pair = F.shiftleft(F.least("own", "other"), DEEPEST) + F.greatest("own", "other")
    return small_.union(rows.select((F.shiftleft("key", 2 * DEEPEST) + pair).alias("key"), "tail", "fp"))


def trie_join(distinct: DataFrame) -> DataFrame:
    """distinct: fp (long, distinct). Links (u, v) that connect whatever lies within BUDGET bits."""
    spread = distinct.select("fp", F.explode(F.array(*_choices(F.col("fp")))).alias("c")).select("c.key", "c.tail", "fp")
    return _split(spread).repartition("key").sortWithinPartitions("key", "tail").transform(map_rows, _bucket_links, "u long, v long")


def simhash_components(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text, more columns or none. Gives a row for each of its rows: doc_id, fp (long), component_id.

    A null or wordless text has fingerprint zero and links like any other; repeated rows give repeated rows; a
    null doc_id never is a component's id unless its component has no other (then that is null); an empty table
    gives an empty result; a text of any length is one fingerprint.
    """
    prints = materialize(docs.select("doc_id", "text").transform(map_rows, _fingerprints, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long"), "prints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    comps = connected_components(trie_join(distinct))
    named = distinct.join(comps.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("comp", "fp").alias("comp"), "first")
    named = materialize(named, "named")
    least = named.groupBy("comp").agg(F.min("first").alias("component_id"))
    final = materialize(named.join(least, "comp").select("fp", "component_id"), "component")
    discard(distinct, named, comps)
    return prints.join(final, "fp").select("doc_id", "fp", "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op10_simhash_trie_join": op10_simhash}
ORACLE: dict[str, str] = {}
