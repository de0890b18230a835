"""Near copies by word shingles: documents whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

Candidates come from two sides. The SimHash operator's trie join links the fingerprints of the five-word shingles within its error
budget, which finds most copies cheaply. Such a budget is far too tight for all pairs of 0.8 (they differ in about 10 of 64 bits,
and a budget that wide prunes nothing), so `BANDS` bands of `ROWS` MinHash values propose the others: a pair at the threshold
shares no band with a chance of (1 - 0.8^4)^40, about 7e-10. Each candidate is verified on the full sets. Equal sets are one
node. In each bucket all members are first compared with its smallest and its largest node; what these links and the
trie's make one component needs no more comparison. Nodes of buckets that still hold several components are gathered into clusters
(whatever such buckets connect). A node of n shingles of which m are met in another component of its cluster can only be similar to one of at
most 9m/4 - n shingles, which says the same of it: nodes without such a partner go, by counts alone. So a cluster of texts
made from one template, each with too much of its own, costs a pass over its shingles. What is left of a cluster is
compared in pairs of blocks of about `BLOCK`: a task counts the common shingles of two blocks through their
postings and emits only links that join components; no pairs are written out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, KEY, byte_texts, discard, map_rows, materialize, one_per_group, row_key, slices
from .graph import connected_components
from .simhash import bit_counts, majority, trie_join

WORDS = 5
BANDS, ROWS = 40, 4
BLOCK = 256
SEED = 42
_MULTIPLY, _ADD = (np.random.default_rng(SEED + i).integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) for i in range(2))
_MULTIPLY |= np.uint64(1)


def shingles(text: bytes, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of a UTF-8 text; of all its words if they are fewer."""
    words = text.translate(ASCII_LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= n:
        return np.array([digest(b" ".join(words), SEED)], dtype=np.uint64)
    hashes = (digest(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(n))))
    return np.unique(np.fromiter(hashes, dtype=np.uint64, count=len(words) - n + 1))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sets of hashes is at least 0.8, in whole numbers."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * common >= 4 * (len(a) + len(b) - common)


def bands(h: np.ndarray) -> np.ndarray:
    """A hash of each band of MinHash values; none for an empty set."""
    if not len(h):
        return np.zeros(0, dtype=np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(h), 2048):
        np.minimum(least, (h[i : i + 2048, None] * _MULTIPLY + _ADD).min(axis=0), out=least)
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(least.reshape(BANDS, ROWS))], dtype=np.uint64).view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 2, 8 << 20):
        node, size, prints, keys = [], [], [], []
        for text in byte_texts(batch.column(2)):
            h = shingles(text)
            node.append(xxhash.xxh64_intdigest(h.tobytes(), SEED))
            size.append(len(h))
            prints.append(majority(bit_counts(h), len(h)))
            keys.append(bands(h))
        ends = np.cumsum([0, *map(len, keys)])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys)))
        ids, fps = (pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (node, prints))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ids, pa.array(size, pa.int64()), fps, lists], names=["doc_id", "key", "node", "size", "fp", "bands"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (u, v, text, text2), the pairs (u, v) that are similar."""
    for batch in slices(batches, 2, 8 << 20):
        keep, last, own = [], None, None
        for u, a, b in zip(batch.column(0).to_pylist(), byte_texts(batch.column(2)), byte_texts(batch.column(3))):
            if u != last:
                last, own = u, shingles(a)
            keep.append(similar(own, shingles(b)))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["u", "v"])


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The similar ones of pairs (u, v) of nodes; texts has node and text."""
    sides = pairs.join(texts.select(F.col("node").alias("u"), "text"), "u").join(texts.select(F.col("node").alias("v"), F.col("text").alias("text2")), "v")
    return materialize(sides.select("u", "v", "text", "text2").transform(map_rows, _verified, "u long, v long"), "similar")


def _trie_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (u, v) of nodes: those that share a fingerprint with its smallest node, and the smallest ones of linked fingerprints."""
    least = materialize(nodes.groupBy("fp").agg(F.min("node").alias("least")), "least")
    same = nodes.join(least, "fp").where("node <> least").select(F.col("least").alias("u"), F.col("node").alias("v"))
    links = trie_join(least.select("fp"))
    for side in "uv":
        links = links.join(least.select(F.col("fp").alias(side), F.col("least").alias(f"{side}2")), side).drop(side).withColumnRenamed(f"{side}2", side)
    return same.union(links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")))


def block_links(node: list[int], comp: list[int], block: list[int], sets: list[np.ndarray], i: int, j: int) -> list[tuple[int, int]]:
    """Links (u, v) between sets of block i and of block j that are similar and not yet in one component; each joins two."""
    left, right = ([k for k, x in enumerate(block) if x == y] for y in (i, j))
    parent = {c: c for c in comp}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    if not left or not right:
        return []
    size = np.array([len(sets[k]) for k in right])
    values = np.concatenate([sets[k] for k in right])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], np.repeat(np.arange(len(right)), size)[order]
    out = []
    for k in left:
        lo, hi = np.searchsorted(values, sets[k], "left"), np.searchsorted(values, sets[k], "right")
        hits = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(hits)[:-1]]), hits) + np.arange(hits.sum())
        common = np.bincount(owner[at], minlength=len(right))
        for m in np.flatnonzero(5 * common >= 4 * (len(sets[k]) + size - common)):
            a, b = root(comp[k]), root(comp[right[m]])
            if a != b:
                parent[a] = b
                out.append((node[k], node[right[m]]))
    return out


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cluster, i, j, block, node, comp, text), those of one (cluster, i, j) together, to links."""
    now, group = None, []

    def links() -> pa.RecordBatch:
        found = block_links([g[1] for g in group], [g[2] for g in group], [g[0] for g in group], [g[3] for g in group], *now[1:]) if group else []
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

    for batch in slices(batches, 6, 8 << 20):
        keys = zip(*(batch.column(k).to_pylist() for k in (0, 1, 2)))
        for key, block, node, comp, text in zip(keys, *(batch.column(k).to_pylist() for k in (3, 4, 5)), byte_texts(batch.column(6))):
            if key != now:
                yield links()
                now, group = key, []
            group.append((block, node, comp, shingles(text)))
    yield links()


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cluster, comp, node, text) to (cluster, comp, node, shingle)."""
    for batch in slices(batches, 3, 2 << 20):
        sets = [shingles(t) for t in byte_texts(batch.column(3))]
        at = pa.array(np.repeat(np.arange(len(sets)), [len(h) for h in sets]))
        flat = np.concatenate([*sets, np.zeros(0, dtype=np.uint64)]).view(np.int64)
        yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(3)), pa.array(flat)], names=["cluster", "comp", "node", "shingle"])


def with_partners(own: DataFrame, texts: DataFrame) -> DataFrame:
    """own (node, comp, cluster; materialized) without nodes that can't be similar to any node of another component of their cluster.

    With o common shingles, 5 o >= 4 (n + n' - o), so 9 o >= 4 (n + n'), and o is at most m, how many of a node's shingles are met in another
    component: n' <= 9 m / 4 - n. Both must hold, for some pair of sizes in the cluster. Each shingle is moved twice, whatever
    the cluster's size; of a cluster only one row for each size is gathered.
    """
    spread = own.join(texts, "node").select("cluster", "comp", "node", "text").transform(map_rows, _shingled, "cluster long, comp long, node long, shingle long")
    spread = materialize(spread, "shingles")
    shared = spread.groupBy("cluster", "shingle").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("cluster", "shingle")
    met = spread.join(shared, ["cluster", "shingle"]).groupBy("cluster", "node").agg(F.count("*").alias("m"))
    sizes = spread.groupBy("cluster", "node").agg(F.count("*").alias("n"))
    each = sizes.join(met, ["cluster", "node"]).withColumn("most", F.floor(F.col("m") * 9 / 4 - F.col("n"))).where("most > 0")
    each = materialize(each, "matched")
    known = each.groupBy("cluster", "n").agg(F.max("most").alias("most")).groupBy("cluster").agg(F.collect_list(F.struct("n", "most")).alias("sizes"))
    fit = each.join(known, "cluster").where(F.exists("sizes", lambda x: (x["n"] <= F.col("most")) & (x["most"] >= F.col("n")))).select("node")
    out = materialize(own.join(fit, "node", "left_semi"), "partners")
    discard(spread, each)
    return out


def _components(docs: DataFrame) -> DataFrame:
    """(doc_id, key, comp) of each row; comp is the smallest node of its component."""
    keyed = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("key"), "text")
    prints = materialize(keyed.transform(map_rows, _signatures, f"doc_id {dict(docs.dtypes)['doc_id']}, key {KEY}, node long, size long, fp long, bands array<long>"), "signatures")
    nodes = prints.where("size > 0").groupBy("node").agg(F.min("key").alias("key"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    nodes = materialize(nodes, "nodes")
    spread = nodes.select("node", "key", "size", F.explode("bands").alias("band"))
    ends = materialize(spread.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high"), "buckets")
    members = materialize(spread.join(ends, "band"), "members")
    trie = materialize(_trie_pairs(nodes), "trie")
    wanted = members.select("node").union(trie.select("u")).union(trie.select("v")).distinct()
    texts = keyed.join(nodes.join(wanted, "node").select("node", "key"), "key").groupBy("node").agg(F.first("text").alias("text"))
    texts = materialize(texts, "texts")
    star = members.select("node", F.explode(F.array("low", "high")).alias("other")).where("node <> other")
    star = star.select(F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v")).union(trie)
    star = materialize(star.distinct(), "pairs")
    first = _links(star, texts)
    comps = materialize(connected_components(first), "first")
    at = members.join(comps, "node", "left").select("band", "node", "size", F.coalesce("comp", "node").alias("comp"))
    mixed = at.groupBy("band").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("band")
    at = materialize(at.join(mixed, "band"), "mixed")
    hubs = at.groupBy("band").agg(F.min("node").alias("hub"))
    clusters = materialize(connected_components(at.join(hubs, "band").select(F.col("node").alias("u"), F.col("hub").alias("v"))), "clusters")
    own = at.select("node", "comp").distinct().join(clusters.withColumnRenamed("comp", "cluster"), "node", "left").withColumn("cluster", F.coalesce("cluster", "node"))
    own = materialize(own, "own")
    whole, own = own, with_partners(own, texts)
    sizes = own.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = own.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "comp")
    dealt = dealt.join(texts, "node").select("cluster", "i", "j", "block", "node", "comp", "text")
    second = dealt.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").transform(map_rows, _block_links, "u long, v long")
    second = materialize(second, "second")
    comps = materialize(connected_components(first.union(second)), "comps")
    discard(nodes, ends, members, trie, texts, star, at, clusters, whole, own, first, second)
    return prints.select("doc_id", "key", "node").join(comps, "node", "left").select("doc_id", "key", F.coalesce("comp", "node").alias("comp"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without all but one row of each component: the one with its smallest doc_id (a null one only if there is no other).
    Texts without words, null ones too, are one component; repeated rows are dropped too; an empty table stays
    empty; all columns, whatever their names, stay as they are."""
    rows = materialize(_components(docs).select("doc_id", "key", F.col("comp").alias("group")), "rows")
    return one_per_group(docs, rows)
