"""Sets of values against sets of values, in tiles: the counts of values in common of up to TILE times TILE pairs at once.

A set is one row with its values' ids (64-bit hashes). Sets are gathered into blocks, a row each, written once; the two sides' blocks meet in a
product, of which nothing is shuffled, and a task counts one tile after the other in a matrix: values that many sets of a tile have by a
matrix product, the others by their pairs. Pairs of sets never are rows but where they are part of the result, so disk and memory grow
with the input; the seconds grow with the number of pairs.

Where pairs need a share of values in common (`pairs_within`), most of a tile is ruled out first, by one matrix product over less columns
than there are values: an upper bound of what each two sets can have in common. Only what it leaves is counted (`near`).
"""

from __future__ import annotations

import contextlib
import copy
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.exchange import materialize

KEYS = ["table_id", "column_id"]
#: The most sets, and about the most values, of a block.
TILE, VALUES = 1024, 1 << 19
#: Values that more than this share of a tile's pairs have in common are counted by a matrix product, so many at once; the others so many pairs at once.
DENSE, AT_ONCE, PAIRS = 0.007, 512, 1 << 20
#: `near` takes blocks of so many times TILE sets; a block of NARROW sets ends where sets of another kind or twice its least size begin.
WIDE, NARROW = 4, 512
#: Kinds of sets (as languages are), found by the most frequent values of some sets: sets of one kind lie in the same blocks, and two kinds have few values in common.
GROUPS, DRAWN, FREQUENT, EVERY = 8, 4096, 512, 64
#: The bound's columns: so many values may have one each; the others share columns, so many that what shares adds is this part of what pairs lack on average.
COLUMNS, LOOSE = (32, 64, 128, 256, 384, 512, 768, 1024, 1536, 2048, 3072, 4096), 0.5
#: Two columns go as digits of one; rows of the product at once; rows counted at once. All is counted beyond so many columns or cells of them, and where more than this share of pairs is left.
DIGIT, ROWS, COUNTED, MOST, CELLS, LEFT = 256, 256, 16, 8192, 1 << 25, 0.03
#: Batches of bulky rows hold so few of them.
_RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextlib.contextmanager
def _batches(spark: SparkSession, rows: int) -> Iterator[None]:
    before = spark.conf.get(_RECORDS)
    spark.conf.set(_RECORDS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_RECORDS, before)


def value_sets(columns: DataFrame) -> DataFrame:
    """(KEYS, ids) of rows (KEYS, value)."""
    return columns.where("value is not null").groupBy(*KEYS).agg(F.collect_set(F.xxhash64("value")).alias("ids"))


def text_sets(df: DataFrame, key: Column, words: Column) -> DataFrame:
    """(KEYS, ids) of rows with arrays of words; empty words don't count, and rows of one key make one set."""
    ids = F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))
    each = df.select(key.alias("table_id"), F.lit(0).alias("column_id"), F.array_distinct(ids).alias("ids"))
    # sizes are looked at last, so that a filter on the keys comes before any text is cut
    return each.groupBy(*KEYS).agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids")).where(F.size("ids") > 0)


def _drawn(sets: DataFrame, share: int) -> DataFrame:
    """One in so many of the sets, by a hash of their keys: to plan with, never to find results with."""
    return sets.where(F.pmod(F.xxhash64(*KEYS), F.lit(share)) == 0)


def _kinds_of_sets(sets: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, weights): frequent values in order, and a row for each with its weight for each kind of sets. This decides which sets share
    a block, so how long the work takes, and nothing else."""
    drawn = _drawn(sets, max(1, n // DRAWN)).select(F.slice("ids", 1, FREQUENT).alias("ids")).toArrow()["ids"].combine_chunks()
    ids = drawn.flatten().to_numpy()
    values, counts = np.unique(ids, return_counts=True)
    values = np.sort(values[np.argsort(-counts, kind="stable")[:FREQUENT]])
    if not len(values):
        return values, np.zeros((0, 1))
    rows = np.repeat(np.arange(len(drawn)), pc.list_value_length(drawn).to_numpy())
    at = np.minimum(np.searchsorted(values, ids), len(values) - 1)
    has = np.zeros((len(drawn), len(values)))
    has[rows[values[at] == ids], at[values[at] == ids]] = 1
    has = has[has.any(1)]
    has /= np.sqrt(has.sum(1, keepdims=True))
    center = has.mean(0, keepdims=True)
    while len(center) < min(GROUPS, len(has)):  # the next begins where sets are farthest from all
        center = np.vstack([center, has[(has @ (center / np.linalg.norm(center, axis=1, keepdims=True)).T).max(1).argmin()]])
    for _ in range(10):
        center /= np.maximum(np.linalg.norm(center, axis=1, keepdims=True), 1e-9)
        kind = (has @ center.T).argmax(1)
        center = np.stack([has[kind == g].sum(0) for g in range(len(center))])
    return values, (center / np.maximum(np.linalg.norm(center, axis=1, keepdims=True), 1e-9)).T


def blocks(sets: DataFrame, wide: bool = False) -> DataFrame:
    """Sets of similar sizes in blocks: their keys and sizes, and all their values in order, each with how many of the sets have it and their
    places. wide: larger blocks, of sets of one kind."""
    kinds = [sets.schema[k].dataType.simpleString() for k in KEYS]
    schema = f"block long, least int, most int, tables array<{kinds[0]}>, columns array<{kinds[1]}>, sizes binary, ids binary, counts binary, owners binary"
    sets = sets.where("table_id is not null and column_id is not null").select(*KEYS, "ids", F.size("ids").alias("n"), F.lit(0).alias("kind"))
    n = EVERY * _drawn(sets, EVERY).count() if wide else sets.count()  # about how many there are is enough, and needs no second cutting of all texts
    most = WIDE * TILE if wide else TILE
    if wide:
        values, weights = _kinds_of_sets(sets, n)

        def kind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, found = batch.column("ids").flatten().to_numpy(), np.zeros(batch.num_rows, np.int32)
                if len(values):
                    at = np.minimum(np.searchsorted(values, ids), len(values) - 1)
                    hit = np.flatnonzero(values[at] == ids)
                    row = np.repeat(np.arange(batch.num_rows), batch.column("n").to_numpy())[hit]
                    found = np.stack([np.bincount(row, w[at[hit]], batch.num_rows) for w in weights.T]).argmax(0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found)], names=batch.schema.names)

        sets = sets.mapInArrow(kind, sets.schema)
    dealt = sets.repartitionByRange(max(1, n // (2 * most)), "kind", "n", *KEYS).sortWithinPartitions("kind", "n")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            sizes, ids, kinds_ = batch.column("n").to_numpy(), batch.column("ids").flatten().to_numpy(), batch.column("kind").to_numpy()
            ends, begin = np.cumsum(sizes, dtype=np.int64), 0
            while begin < len(sizes):
                before = ends[begin] - sizes[begin]
                end = min(begin + most, max(begin + 1, int(np.searchsorted(ends, before + VALUES, "right"))), len(sizes))
                if wide and begin + NARROW < end:
                    other = np.flatnonzero((kinds_[begin + NARROW : end] != kinds_[begin]) | (sizes[begin + NARROW : end] > 2 * sizes[begin]))
                    end = begin + NARROW + int(other[0]) if len(other) else end
                n, part = sizes[begin:end], ids[before : ends[end - 1]]
                order = np.argsort(part, kind="stable")
                owners, part = np.repeat(np.arange(end - begin, dtype=np.uint16), n)[order], part[order]
                starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
                counts = np.diff(np.r_[starts, len(part)]).astype(np.uint16)
                lists = [pa.array([batch.column(k).slice(begin, end - begin).to_pylist()], pa.list_(batch.column(k).type)) for k in KEYS]
                raw = [pa.array([x.tobytes()], pa.binary()) for x in (n.astype(np.int32), part[starts], counts, owners)]
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([n.min()], pa.int32()), pa.array([n.max()], pa.int32()), *lists, *raw], names=["block", "least", "most", "tables", "columns", "sizes", "ids", "counts", "owners"])
                number, begin = number + 1, end

    with _batches(sets.sparkSession, most):
        return materialize(dealt.mapInArrow(cut, schema))


class _Block:
    def __init__(self, batch: pa.RecordBatch, at: int, side: str):
        raw = lambda name, kind: np.frombuffer(batch.column(f"{side}_{name}")[at].as_py(), kind)
        self.block = batch.column(f"{side}_block")[at].as_py()
        self.keys = [batch.column(f"{side}_{x}")[at].values for x in ("tables", "columns")]
        self.sizes, self.ids, self.owners = raw("sizes", np.int32), raw("ids", np.int64), raw("owners", np.uint16)
        self.counts = raw("counts", np.uint16).astype(np.int64)
        self.starts = np.cumsum(self.counts) - self.counts

    def part(self, first: int, end: int) -> _Block:
        """The sets from first to end."""
        out = copy.copy(self)
        at = np.flatnonzero((self.owners >= first) & (self.owners < end))
        out.sizes, out.owners, which = self.sizes[first:end], (self.owners[at] - first).astype(np.uint16), np.repeat(np.arange(len(self.ids)), self.counts)[at]
        counts = np.bincount(which, minlength=len(self.ids))
        out.ids, out.counts = self.ids[counts > 0], counts[counts > 0]
        out.starts = np.cumsum(out.counts) - out.counts
        return out


def _spread(counts: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, place): for each entry of `counts` so many places on from its start."""
    before = np.cumsum(counts) - counts
    return np.repeat(np.arange(len(counts)), counts), np.arange(counts.sum()) + np.repeat(starts - before, counts)


def _shared(a: _Block, b: _Block) -> tuple[np.ndarray, np.ndarray]:
    """Places in either block's ids of the values that both have."""
    at = np.searchsorted(a.ids, b.ids)
    hit = np.flatnonzero(at < len(a.ids))
    hit = hit[a.ids[at[hit]] == b.ids[hit]]
    return at[hit], hit


def common(a: _Block, b: _Block) -> np.ndarray:
    """How many values each set of a has in common with each of b."""
    n, m = len(a.sizes), len(b.sizes)
    out = np.zeros((n, m), np.int32)
    x, y = _shared(a, b)
    dense = a.counts[x] * b.counts[y] > DENSE * n * m
    for i in range(0, int(dense.sum()), AT_ONCE):
        sides = []
        for side, which, rows in ((a, x[dense][i : i + AT_ONCE], n), (b, y[dense][i : i + AT_ONCE], m)):
            one = np.zeros((rows, len(which)), np.float32)
            column, place = _spread(side.counts[which], side.starts[which])
            one[side.owners[place], column] = 1
            sides.append(one)
        out += (sides[0] @ sides[1].T).astype(np.int32)
    x, y = x[~dense], y[~dense]
    value, place = _spread(a.counts[x], a.starts[x])
    order = np.argsort(a.owners[place], kind="stable")  # row by row, so that what is counted at once lies together
    row, value = a.owners[place][order].astype(np.int64), value[order]
    partners, start = b.counts[y][value], b.starts[y][value]
    ends, begin = np.cumsum(partners), 0
    while begin < len(row):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PAIRS, "right")))
        which, place = _spread(partners[begin:end], start[begin:end])
        first, last = row[begin], row[end - 1] + 1
        cells = ((row[begin:end] - first) * m)[which]
        cells += b.owners[place]
        out[first:last] += np.bincount(cells, minlength=(last - first) * m).reshape(-1, m)
        begin = end
    return out


def _bound(one: list[np.ndarray], least: list[np.ndarray]) -> np.ndarray | None:
    """Cells (row of the first times rows of the second plus row of it) where the rows have ones in common in at least the sum of their
    `least` columns. Two columns are digits of one, turned round on one side, so that the middle digit of a product counts both: all digits
    stay below DIGIT and the product exact in 24 bits, as columns are parted until one side's rows have less ones than that. None if these
    are more than LEFT of all cells."""
    parts = 1 + min(int(x.sum(1, dtype=np.int64).max()) for x in one) // DIGIT
    while any(min(int(x[:, p::parts].sum(1, dtype=np.int64).max()) for x in one) >= DIGIT - 1 for p in range(parts)):
        parts += 1
    pairs = []
    for p in range(parts):
        a, b = (x[:, p::parts] for x in one)
        half = (a.shape[1] + 1) // 2
        low, high = a[:, :half].astype(np.float32), b[:, :half].astype(np.float32)
        high *= DIGIT
        low[:, : a.shape[1] - half] += a[:, half:] * np.float32(DIGIT)
        high[:, : a.shape[1] - half] += b[:, half:]
        pairs.append((low, high.T))
    need = [np.floor(DIGIT * x - 0.01).astype(np.int32) for x in least]
    found = []
    for i in range(0, len(need[0]), ROWS):
        total = -need[1][None, :]
        for low, high in pairs:
            product = (low[i : i + ROWS] @ high).astype(np.int32)
            product &= DIGIT * DIGIT - 1  # the lowest digit stays: less than one more
            total = np.add(product, total, out=product)
        found.append(np.flatnonzero((total >= need[0][i : i + ROWS, None]).ravel()) + i * len(need[1]))
        if sum(map(len, found)) > LEFT * len(need[0]) * len(need[1]):
            return None
    return np.concatenate(found)


def near(a: _Block, b: _Block, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, k): sets of a and b with a share of at least `least` of all their values in common, and how many these are.

    Sets with common values k of sizes n and m need k >= share * (n + m). Values of few sets share columns: two sets have no more in common
    than they have columns, and half of what either lost by columns shared.
    """
    share, none = least / (1 + least), (np.zeros(0, np.int64),) * 3
    x, y = _shared(a, b)
    order = np.argsort(-a.counts[x] * b.counts[y], kind="stable")
    values, sides = len(order), []
    for one, other, which in ((a, b, x[order]), (b, a, y[order])):
        code = np.full(len(one.ids), -1, np.int32)
        code[which] = np.arange(values, dtype=np.int32)
        value = np.repeat(code, one.counts)
        at = np.flatnonzero(value >= 0)
        value, row = value[at], one.owners[at]
        kept = np.bincount(row, minlength=len(one.sizes)) >= np.maximum(share * (one.sizes + int(other.sizes.min())) - 1e-6, 1)
        at, rows = kept[row], np.flatnonzero(kept)
        if not len(rows):
            return none
        sides.append((value[at], (np.cumsum(kept) - 1).astype(np.uint16)[row[at]], rows, one.sizes[rows].astype(np.int64)))
    rate = [np.bincount(v, minlength=values) / len(n) for v, _, _, n in sides]
    lack = share * sum(n.mean() for *_, n in sides) - (rate[0] * rate[1]).sum()
    s, t = (np.maximum(r.sum() - np.cumsum(r), 0) for r in rate)
    own, more = min(((min(c, values), 1 + int((s[c - 1] * t[c - 1] + (s[c - 1] ** 2 + t[c - 1] ** 2) / 4) / (LOOSE * max(lack, 1))) if c < values else 0) for c in COLUMNS), key=sum)
    own, more = (values, 0) if own + more >= values else (own, more)
    if own + more > MOST or (own + more) * sum(len(n) for *_, n in sides) > CELLS:
        return _counted(a, b, least)
    ones, need = [], []
    for value, row, _, n in sides:
        one = np.zeros((len(n), own + more), np.uint8)
        one[row, np.where(value < own, value, own + (value - own) % max(more, 1))] = 1
        ones.append(one)
        need.append(share * n - (np.bincount(row, minlength=len(n)) - one.sum(1, dtype=np.int64)) / 2)
    cells = _bound(ones, need)
    if cells is None:
        del sides, ones, one, value, row, at, code
        return _counted(a, b, least)
    (va, ra, rows_a, na), (vb, rb, rows_b, nb) = sides
    i, j, k = cells // len(nb), cells % len(nb), np.zeros(len(cells), np.int64)
    if len(cells):
        (va, la), (vb, lb) = ((v[np.argsort(r, kind="stable")], np.bincount(r, minlength=len(n))) for v, r, n in ((va, ra, na), (vb, rb, nb)))
        ends, starts = np.cumsum(la), np.cumsum(lb) - lb
        mark = np.zeros(COUNTED * values, bool)
        edges = np.searchsorted(i, np.arange(0, len(na) + COUNTED, COUNTED))
        for g in np.flatnonzero(np.diff(edges)):
            first, last = g * COUNTED, min((g + 1) * COUNTED, len(na))
            own_values = va[ends[first] - la[first] : ends[last - 1]] + np.repeat(np.arange(last - first) * values, la[first:last])
            mark[own_values] = True
            begin = edges[g]
            while begin < edges[g + 1]:  # so many at once
                c = np.cumsum(lb[j[begin : edges[g + 1]]])
                end = begin + max(1, int(np.searchsorted(c, PAIRS, "right")))
                end = min(end, edges[g + 1])
                c = lb[j[begin:end]]
                _, place = _spread(c, starts[j[begin:end]])
                hit = mark[vb[place] + np.repeat((i[begin:end] - first) * values, c)]
                k[begin:end] = np.add.reduceat(hit, np.cumsum(c) - c, dtype=np.int64)
                begin = end
            mark[own_values] = False
    fine = (k > 0) & (k >= share * (na[i] + nb[j]) - 1e-6)
    return rows_a[i[fine]], rows_b[j[fine]], k[fine]


def _counted(a: _Block, b: _Block, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`near` by counting what all pairs have in common, of a quarter block or so at once."""
    found = []
    for first in range(0, len(a.sizes), TILE):
        k = common(a.part(first, first + TILE), b)
        fine = [(k[i : i + ROWS] > 0) & (k[i : i + ROWS] * (1 + least) >= least * (a.sizes[first + i : min(first + i + ROWS, first + TILE), None] + b.sizes[None, :].astype(np.float64)) - 1e-6) for i in range(0, len(k), ROWS)]
        cells = np.flatnonzero(np.concatenate(fine).ravel())
        found.append((cells // len(b.sizes) + first, cells % len(b.sizes), k.ravel()[cells].astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*found))


def _tiles(left: DataFrame, right: DataFrame, where: Column | None, pick: Callable[[_Block, _Block, dict], tuple], kinds: list[str]) -> DataFrame:
    """The rows that `pick` makes of the tiles of left and right blocks: places in either block, and the count. Its third argument lasts for a task."""
    sides = [df.select(*[F.col(c).alias(f"{x}_{c}") for c in df.columns]) for x, df in (("r", left), ("s", right))]
    both = sides[0].crossJoin(sides[1])
    names = [f"{x}_{k}" for x in "rs" for k in KEYS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep: dict = {}
        for batch in batches:
            for at in range(batch.num_rows):
                a, b = (_Block(batch, at, x) for x in "rs")
                i, j, k = pick(a, b, keep)
                keys = [x.take(pa.array(p)) for side, p in ((a, i), (b, j)) for x in side.keys]
                numbers = [pa.array(x.astype(np.int64)) for x in (k, a.sizes[i], b.sizes[j])]
                yield pa.RecordBatch.from_arrays([*keys, *numbers], names=[*names, "k", "size_r_col", "size_s_col"])

    schema = ", ".join(f"{n} {t}" for n, t in zip(names, kinds * 2)) + ", k long, size_r_col long, size_s_col long"
    with _batches(left.sparkSession, 1):
        return materialize((both.where(where) if where is not None else both).mapInArrow(run, schema))


def _kinds(sets: DataFrame) -> list[str]:
    return [sets.schema[k].dataType.simpleString() for k in KEYS]


def pairs_within(sets: DataFrame, least: float) -> DataFrame:
    """(r_*, s_*, k, size_r_col, size_s_col): each two sets of different tables, r before s, with a share of common values in all of at least so much."""
    dealt = blocks(sets, wide=True)
    # sizes that differ too much can't reach it
    close = (F.col("r_most") >= F.col("s_least") * least) & (F.col("s_most") >= F.col("r_least") * least)
    # of two blocks' two tiles one is taken, by a draw, so that all tasks have about as many
    r, s = F.col("r_block"), F.col("s_block")
    once = (r == s) | ((r < s) == (F.xxhash64(F.least(r, s), F.greatest(r, s)) % 2 == 0))

    def pick(a: _Block, b: _Block, _: dict) -> tuple:
        i, j, k = near(a, b, least)
        if a.block == b.block:
            i, j, k = (x[i < j] for x in (i, j, k))
        return i, j, k

    found = _tiles(dealt, dealt, once & close, pick, _kinds(sets)).where("r_table_id <> s_table_id")
    turned = F.col("r_table_id") > F.col("s_table_id")
    swap = lambda c: ("s" if c[0] == "r" else "r") + c[1:] if c[:2] in ("r_", "s_") else {"size_r_col": "size_s_col", "size_s_col": "size_r_col"}.get(c, c)
    return found.select(*[F.when(turned, F.col(swap(c))).otherwise(F.col(c)).alias(c) for c in found.columns])


def best_within(sets: DataFrame, probes: Column, k: int) -> DataFrame:
    """(r_*, s_*, k): for each set that `probes` holds for, of all others, sets of other tables with most values in common: the k best (ties by
    table and column) and some more; at least one value in common."""
    sets = materialize(sets)

    def pick(a: _Block, b: _Block, keep: dict) -> tuple:
        count = common(a, b)
        tables = pa.concat_arrays([a.keys[0], b.keys[0]]).dictionary_encode().indices.to_numpy()
        count[tables[: len(a.sizes), None] == tables[None, len(a.sizes) :]] = 0
        rank = np.empty(len(b.sizes), np.int64)
        rank[pc.sort_indices(pa.table(dict(zip("tc", b.keys))), [("t", "ascending"), ("c", "ascending")]).to_numpy()] = np.arange(len(b.sizes))
        key = count.astype(np.int64) * len(b.sizes) + (len(b.sizes) - 1 - rank)
        first = np.argpartition(-key, k - 1, axis=1)[:, :k] if k < len(b.sizes) else np.broadcast_to(np.arange(len(b.sizes)), key.shape)
        top = np.take_along_axis(count, first, 1)
        held = keep.get(a.block, np.zeros((len(a.sizes), k), np.int32))
        i, at = np.nonzero((top > 0) & (top >= held[:, :1]))
        keep[a.block] = np.sort(np.hstack([held, top]), axis=1)[:, -k:]  # the least of the k best counts so far comes first
        return i, first[i, at], top[i, at]

    return _tiles(blocks(sets.where(probes)), blocks(sets), None, pick, _kinds(sets)).drop("size_r_col", "size_s_col")
