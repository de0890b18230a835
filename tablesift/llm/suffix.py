"""Exact substring dedup by a depth-limited radix sort of suffixes.

Suffixes are sorted by their first DEPTH bytes only, in most-significant-digit passes: a pass orders the suffixes of each
group by their next digit, which splits the group, and a group of one is dropped. What is equal after the last pass
are exactly the repeated windows of DEPTH bytes. Not every suffix travels as a row of its own:

* Neighbouring suffixes are one row, a run: those whose windows have the same least-hashed GRAM-byte string at the same
  place (about DEPTH - GRAM of them). Equal windows lie in runs with equal strings, so a run whose string no
  other run has holds no repeated window and is dropped before the sort.
* Equal runs are one kind, sorted once. All windows of a kind that occurs twice are repeated.
* The suffixes of the kinds that share a string are sorted: up to GROUP kinds within a task, by digits of eight bytes
  (`sort_equal`); larger groups over the cluster: cut into pieces of BLOCK suffixes, of which equal ones are again one, and then
  suffix by suffix, by digits of a quarter of DEPTH (`_passes`).

Documents are dealt out once, into buckets by row id; all joins with texts read those.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucketed, byte_texts, discard, map_rows, materialize, slices, table

DEPTH = 200
GRAM = 64
#: Bytes that a task works on at once; longer texts are cut, with DEPTH - 1 bytes shared.
PIECE = 1 << 20
#: Kinds of runs with one string that are sorted within a task.
GROUP = 64
#: Bytes of kinds that are sorted at once there.
AT_ONCE = 1 << 20
#: Windows of a piece, and digits of the passes over the cluster.
BLOCK, DIGITS = 16, 4

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(0, 1 << 32, 256, dtype=np.uint32)
_STEP = [int(x) | 1 for x in _rng.integers(0, 1 << 32, 16, dtype=np.uint32)]


def _pieces(texts: list[bytes], depth: int, most: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Groups of (row, offset, bytes) of about `most` bytes; texts under depth have no window and are left out."""
    group, size = [], 0
    for row, text in enumerate(texts):
        for at in range(0, max(0, len(text) - depth + 1), most):
            part = text[at : at + most + depth - 1] if len(text) > most else text
            group.append((row, at, part))
            size += len(part)
            if size >= most:
                yield group
                group, size = [], 0
    if group:
        yield group


def runs_of(data: bytes, lengths: list[int], depth: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window start of each run, and where its string lies, for texts of the given lengths laid end to end.
    gram is a power of two."""
    g = _BYTE[np.frombuffer(data, dtype=np.uint8)]
    width = 1
    while width < gram:
        g = g[:-width] * np.uint32(_STEP[width.bit_length()]) + g[width:]
        g ^= g >> np.uint32(15)
        width *= 2
    wide = depth - gram + 1
    least, width = g, 1
    while width * 2 <= wide:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < wide:
        least = np.minimum(least[: len(least) - (wide - width)], least[wide - width :])
    valid = np.ones(len(least) + 1, dtype=bool)
    valid[-1] = False
    end = 0
    for n in lengths:
        end += n
        valid[max(0, end - depth + 1) : end] = False
    start = valid[:-1].copy()
    start[1:] &= ~valid[:-2] | (g[: len(least) - 1] == least[:-1]) | (least[1:] < least[:-1])
    lo = np.flatnonzero(start)
    last = valid[:-1] & (~valid[1:] | np.append(start[1:], True))
    anchor = np.empty(len(lo), dtype=np.int64)
    view = np.lib.stride_tricks.sliding_window_view(g, wide)
    for a in range(0, len(lo), 4096):
        anchor[a : a + 4096] = view[lo[a : a + 4096]].argmin(1)
    return lo, np.flatnonzero(last), lo + anchor


def _longs(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def _runs(depth: int, gram: int, whole: bool):
    """Rows (id, text) to rows of runs; with `whole` false only the hash of the string."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 4 << 20):
            ids = np.asarray(batch.column(0))
            for group in _pieces(byte_texts(batch.column(1)), depth, PIECE):
                data = b"".join(p for _, _, p in group)
                lengths = [len(p) for _, _, p in group]
                lo, hi, at = runs_of(data, lengths, depth, gram)
                h = np.fromiter((xxhash.xxh3_64_intdigest(data[p : p + gram]) for p in at.tolist()), dtype=np.uint64, count=len(at)).view(np.int64)
                if not whole:
                    yield pa.RecordBatch.from_arrays([pa.array(h)], names=["h"])
                    continue
                c1, c2 = _longs([xxhash.xxh3_128_digest(data[a : b + depth]) for a, b in zip(lo.tolist(), hi.tolist())])
                starts = np.cumsum([0, *lengths[:-1]])
                piece = np.searchsorted(starts, lo, side="right") - 1
                row, base = (np.array([x[i] for x in group]) for i in (0, 1))
                place = (lo - starts[piece] + base[piece]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids[row[piece]]), pa.array(place), pa.array((hi - lo).astype(np.int32)), pa.array(h), pa.array(c1), pa.array(c2)], names=["id", "lo", "n", "h", "c1", "c2"])

    return emit


KIND = "h long, c1 long, c2 long, lone boolean, hot boolean, data binary"


def _kinds(depth: int):
    """Rows (id, text, runs) to a row KIND for each kind of run asked for, with all bytes that its windows cover."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 4 << 20):
            out = []
            for text, runs in zip(byte_texts(batch.column(1)), batch.column(2).to_pylist()):
                for r in {(r["c1"], r["c2"]): r for r in runs}.values():
                    out.append((r["h"], r["c1"], r["c2"], r["lone"], r["hot"], text[r["lo"] : r["lo"] + r["n"] + depth]))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=["h", "c1", "c2", "lone", "hot", "data"])

    return emit


def sort_equal(data: bytes, at: np.ndarray, group: np.ndarray, depth: int) -> np.ndarray:
    """Which of the suffixes that start `at` share their first `depth` bytes with another of their group (ascending), as indices.

    A pass for each eight bytes: where a group's suffixes differ in them they are ordered by them, and groups of one go.
    """
    padded = np.frombuffer(data + bytes(8), dtype=np.uint8)
    word = np.ndarray(len(data) + 1, dtype=">u8", buffer=padded, strides=(1,))
    which = np.arange(len(at))
    head = np.diff(group, prepend=-1) != 0

    def alone_out(*arrays: np.ndarray) -> list[np.ndarray]:
        size = np.diff(np.append(np.flatnonzero(head), len(head)))
        keep = np.repeat(size > 1, size)
        return [x[keep] for x in arrays]

    at, which, head = alone_out(at, which, head)
    for done in range(0, depth, 8):
        if not len(at):
            break
        digit = word[at + done].astype(np.uint64) >> np.uint64(8 * max(0, 8 - (depth - done)))
        first = np.flatnonzero(head)
        size = np.diff(np.append(first, len(head)))
        unlike = np.logical_or.reduceat(digit != np.repeat(digit[first], size), first)
        if not unlike.any():
            continue
        sub = np.flatnonzero(np.repeat(unlike, size))
        order = sub[np.lexsort((digit[sub], np.repeat(np.arange(len(first)), size)[sub]))]
        at[sub], which[sub], digit[sub] = at[order], which[order], digit[order]
        head[1:] |= digit[1:] != digit[:-1]
        at, which, head = alone_out(at, which, head)
    return np.sort(which)


def _sorted_here(depth: int):
    """Rows KIND, those of one h together, to (c1, c2, a, b): the windows a to b of a lone kind also occur in another."""

    def equal(kinds: list[tuple]) -> pa.RecordBatch:
        h, c1, c2, lone, data = ([k[i] for k in kinds] for i in (0, 1, 2, 3, 5))
        length = np.array([len(x) for x in data])
        windows = length - depth + 1
        kind = np.repeat(np.arange(len(kinds)), windows)
        first = np.cumsum(windows) - windows
        offset = np.arange(len(kind)) - first[kind]
        group = np.cumsum(np.array(h[1:] + h[-1:]) != np.array(h)) if len(h) > 1 else np.zeros(1, dtype=np.int64)
        group = np.concatenate([[0], group[:-1]])
        met = np.zeros(len(kind), dtype=bool)
        met[sort_equal(b"".join(data), (np.cumsum(length) - length)[kind] + offset, group[kind], depth)] = True
        met &= np.array(lone)[kind]
        same = np.concatenate([[False], kind[1:] == kind[:-1]])
        start = np.flatnonzero(met & ~(same & np.concatenate([[False], met[:-1]])))
        end = np.flatnonzero(met & ~np.append(same[1:] & met[1:], False))
        own = kind[start]
        return pa.RecordBatch.from_arrays([pa.array(np.array(c1)[own]), pa.array(np.array(c2)[own]), pa.array(offset[start]), pa.array(offset[end])], names=["c1", "c2", "a", "b"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait: list[tuple] = []
        size = 0
        for batch in slices(batches, 5, AT_ONCE):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= AT_ONCE and row[0] != wait[-1][0]:
                    yield equal(wait)
                    wait, size = [], 0
                wait.append(row)
                size += len(row[5])
        if wait:
            yield equal(wait)

    return emit


def _suffixes(depth: int):
    """Rows KIND to a row for each suffix, with its digits."""
    width = -(-depth // DIGITS)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 5, 1 << 18):
            out = []
            for h, c1, c2, lone, data in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 3, 5))):
                for j in range(len(data) - depth + 1):
                    out.append((h, c1, c2, lone, j, *(xxhash.xxh3_64_intdigest(data[j + d : j + min(depth, d + width)]) for d in range(0, DIGITS * width, width))))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32()]
            columns = list(zip(*out))
            digits = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in columns[5:]]
            yield pa.RecordBatch.from_arrays([*(pa.array(x, k) for x, k in zip(columns, kinds)), *digits], names=["h", "c1", "c2", "lone", "j", *(f"d{i}" for i in range(DIGITS))])

    return emit


PIECES = "h long, block int, core long, p1 long, p2 long, c1 long, c2 long, lone boolean, j int, n int, data binary"


def _blocks(depth: int, gram: int):
    """Rows KIND to pieces: the windows whose string starts within the same BLOCK bytes of them (so equal windows are in the same block), the
    hash of what all such windows cover, the digest of what the piece's own cover, and the kind's number of its first window."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PIECES.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary()]
        for batch in slices(batches, 5, 1 << 18):
            out = []
            for h, c1, c2, lone, data in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 3, 5))):
                at, last = int(runs_of(data, [len(data)], depth, gram)[2][0]), len(data) - depth
                for block in range((at - last) // BLOCK, at // BLOCK + 1):
                    first, end = max(0, at - BLOCK * block - BLOCK + 1), min(last, at - BLOCK * block)
                    piece = data[first : end + depth]
                    latest = at - BLOCK * block
                    core = xxhash.xxh3_64_intdigest(data[latest : max(latest, latest - BLOCK + 1 + depth)])
                    p1, p2 = np.frombuffer(xxhash.xxh3_128_digest(piece), dtype="<i8").tolist()
                    out.append((h, block, core - (1 << 64) if core >> 63 else core, p1, p2, c1, c2, lone, first, end - first, piece))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=names)

    return emit


def _passes(kinds: DataFrame, depth: int, gram: int) -> DataFrame:
    """What `_sorted_here` gives, for groups of any size. Kinds are cut into pieces of BLOCK windows; those of which all windows' common bytes
    occur once are dropped, equal ones are one. What is left in groups of several is sorted suffix by suffix: a pass joins each
    with the groups of several that its next digit makes."""
    pieces = materialize(kinds.transform(map_rows, _blocks(depth, gram), PIECES), "pieces")
    group, piece = ["h", "block", "core"], ["p1", "p2"]
    whole = pieces.groupBy(*group, *piece).agg(F.count("*").alias("c"), F.min(F.struct("c1", "c2", "j")).alias("one"))
    whole = materialize(whole, "whole")
    mixed = whole.groupBy(*group).agg(F.count("*").alias("kinds")).where("kinds > 1").drop("kinds")
    open_ = whole.join(mixed, group, "left_semi").select("h", "one.*", (F.col("c") == 1).alias("alone"))
    digits = [f"d{i}" for i in range(DIGITS)]
    rows = pieces.join(open_, ["h", "c1", "c2", "j"]).select("h", F.col("p1").alias("c1"), F.col("p2").alias("c2"), F.col("alone").alias("lone"), F.lit(True).alias("hot"), "data")
    left = materialize(rows.transform(map_rows, _suffixes(depth), f"h long, c1 long, c2 long, lone boolean, j int, {', '.join(f'{d} long' for d in digits)}"), "suffixes")
    for n in range(1, DIGITS + 1):
        key = ["h", *digits[:n]]
        several = materialize(left.groupBy(*key).agg(F.count("*").alias("c")).where("c > 1").select(*key), "several")
        now = materialize(left.join(several, key, "left_semi"), "suffixes")
        discard(left, several)
        left = now
    js = left.where("lone").groupBy("c1", "c2").agg(F.collect_set("j").alias("js"))
    stretch = F.transform(F.filter("js", lambda j: ~F.array_contains("js", j - 1)), lambda a: F.struct(a.alias("a"), F.array_min(F.filter("js", lambda j: (j >= a) & ~F.array_contains("js", j + 1))).alias("b")))
    some = js.select(F.col("c1").alias("p1"), F.col("c2").alias("p2"), F.inline(stretch))
    lone = pieces.where("lone").select(*piece, "c1", "c2", "j", "n")
    every = lone.join(whole.where("c > 1").select(*piece), piece, "left_semi").select("c1", "c2", F.col("j").cast("long").alias("a"), (F.col("j") + F.col("n")).cast("long").alias("b"))
    out = materialize(every.union(lone.join(some, piece).select("c1", "c2", (F.col("j") + F.col("a")).cast("long"), (F.col("j") + F.col("b")).cast("long"))), "parts")
    discard(pieces, whole, left)
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of [a, b) intervals; those that touch are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, spans) to results."""
    for batch in slices(batches, 1, 8 << 20):
        rows: dict[str, list] = {"doc_id": batch.column(0), "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
        for text, spans in zip(byte_texts(batch.column(1)), batch.column(2).to_pylist()):
            found = merged([(s["a"], s["b"]) for s in spans or ()])
            kept = b"".join(text[a:b] for a, b in zip([0, *(b for _, b in found)], [*(a for a, _ in found), len(text)]))
            for name, value in (("n_bytes", len(text)), ("n_removed", len(text) - len(kept)), ("n_spans", len(found)), ("kept_sha256", hashlib.sha256(kept).hexdigest()), ("kept", kept)):
                rows[name].append(value)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([rows["doc_id"], *(pa.array(rows[c], k) for c, k in zip(list(rows)[1:], kinds))], names=list(rows))


def repeated_spans(texts: DataFrame, depth: int = DEPTH, gram: int = GRAM) -> DataFrame:
    """texts: id (unique), text; a table in buckets by id. Gives (id, spans): the byte intervals [a, b) covered by repeated
    windows, not yet united, for rows that have any."""
    first = texts.select("id", "text").transform(map_rows, _runs(depth, gram, False), "h long").groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
    shared = materialize(first, "strings")
    runs = texts.select("id", "text").transform(map_rows, _runs(depth, gram, True), "id long, lo long, n int, h long, c1 long, c2 long")
    runs = materialize(runs.join(shared, "h"), "runs")
    whole = materialize(runs.groupBy("h", "c1", "c2").agg(F.count("*").alias("c"), F.min(F.struct("id", "lo")).alias("one")), "whole")
    mixed = materialize(whole.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1"), "mixed")
    open_ = whole.join(mixed, "h").select("h", "one.id", "one.lo", "c1", "c2", (F.col("c") == 1).alias("lone"), (F.col("kinds") > GROUP).alias("hot"))
    # the first run of each kind, cut anew from the texts
    asked = runs.select("id", "lo", "n").join(open_, ["id", "lo"]).groupBy("id").agg(F.collect_list(F.struct("h", "lo", "n", "c1", "c2", "lone", "hot")).alias("runs"))
    asked = materialize(asked, "asked")
    kinds = materialize(texts.join(asked, "id").select("id", "text", "runs").transform(map_rows, _kinds(depth), KIND), "kinds")
    parts = kinds.where("not hot").repartition("h").sortWithinPartitions("h").transform(map_rows, _sorted_here(depth), "c1 long, c2 long, a long, b long")
    parts = [materialize(parts, "parts")]
    if kinds.where("hot").limit(1).count():
        parts.append(_passes(kinds.where("hot"), depth, gram))
    repeated = runs.join(whole.where("c > 1").select("c1", "c2"), ["c1", "c2"]).select("id", "lo", F.lit(0).cast("long").alias("a"), F.col("n").cast("long").alias("b"))
    spans = repeated
    for p in parts:
        spans = spans.union(runs.join(p, ["c1", "c2"]).select("id", "lo", "a", "b"))
    spans = spans.groupBy("id").agg(F.collect_set(F.struct((F.col("lo") + F.col("a")).alias("a"), (F.col("lo") + F.col("b") + depth).alias("b"))).alias("spans"))
    out = materialize(spans, "spans")
    discard(shared, runs, whole, mixed, asked, kinds, *parts)
    return out


def dedup_substrings(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM) -> DataFrame:
    """docs: doc_id, text, more columns or none. For each of its rows: doc_id, n_bytes, n_removed, n_spans, kept_sha256,
    kept (binary: what remains may not be UTF-8).

    A null text is empty; a text under `depth` bytes stays whole; a very long one is worked on in pieces. Repeated rows are
    documents of their own, so each is a copy of the other. An empty table gives an empty result.
    """
    texts = bucketed(docs.select(F.monotonically_increasing_id().alias("id"), "doc_id", "text"), "id", "texts")
    spans = repeated_spans(texts, depth, gram)
    return texts.join(spans, "id", "left").select("doc_id", "text", "spans").transform(map_rows, _cut, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents")).drop("kept")


QUERIES = {"op4_suffix_radix": op4_suffixes}
ORACLE: dict[str, str] = {}
