"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to three bytes, with frozen counts. In a context seen
n times with d different next bytes, a byte seen c times there has probability c/(n+d); the others share the
escape probability d/(n+d) in proportion to what the next shorter context gives them (so bytes already ruled out
are excluded and every context's distribution sums to one); below the empty context all bytes are equal.
A context that a language has not seen escapes for free. The language whose tree codes the whole text
in the fewest bits wins.

The trees are learned on a sample of at most `SAMPLE_BYTES` of text per language, `TOTAL_BYTES` in all (in expectation; on all text if
there is less), drawn in pieces, so a language with a few long texts is learned as well. They hold the contexts of two and of three bytes
that were seen `LEAST_SEEN` times, the most frequent `MAX_CONTEXTS` of either length (less for more than 40 languages, see
`_most`); other contexts escape for free, and the code lengths are exact for these trees, over all 256 bytes. That bounds the model, which is
broadcast: an index of contexts x 256 numbers, and a float per language for each byte seen in a context and for each context's escape.
Code lengths are worked out once for all these, so scoring takes table lookups alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import joined, map_rows, slices, small, table

SAMPLE_BYTES = 6 << 20
TOTAL_BYTES = 64 << 20
#: Characters of the pieces that the sample is drawn in.
PIECE = 4096
MAX_CONTEXTS = 12288
#: A context of two or three bytes is kept if seen so often.
LEAST_SEEN = 4
ORDER = 3
UNKNOWN = "und"
SEED = 5


@dataclass
class Level:
    """The contexts of one length: index[node, byte] is the entry of a byte seen there (-1: of none), bits[entry, language] its code
    length, escape[node, language] what other bytes pay there on top of the shorter context's."""

    index: np.ndarray
    bits: np.ndarray
    escape: np.ndarray


@dataclass
class Model:
    """base[byte before, byte, language]: code lengths after one byte; node of a two-byte and of a three-byte context (0: none)."""

    languages: list[str]
    base: np.ndarray
    pair: np.ndarray
    triple: np.ndarray
    pairs: Level
    triples: Level


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


#: Bytes that are worked on at once.
CHUNK = 1 << 18


def _contexts(data: np.ndarray, offsets: np.ndarray, pad: int) -> Iterator[tuple]:
    """(from, to, a, b, c, d) for stretches of the rows' values, laid end to end: each value d and the three before it in its row,
    `pad` where there are none."""
    heads = offsets[:-1][np.diff(offsets) > 0]
    for s in range(0, len(data), CHUNK):
        e = min(len(data), s + CHUNK)
        ext = np.full(e - s + ORDER, pad, dtype=np.int64)
        ext[ORDER - min(s, ORDER) :] = data[max(0, s - ORDER) : e]
        before = [ext[ORDER - k : len(ext) - k].copy() for k in range(1, ORDER + 1)]
        near = heads[(heads > s - ORDER) & (heads < e)] - s
        for k, values in enumerate(before, 1):
            for i in range(k):
                at = near + i
                values[at[(at >= 0) & (at < e - s)]] = pad
        yield s, e, before[2], before[1], before[0], ext[ORDER:]


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Four-byte strings of each language's texts (three bytes of context, one coded), counted."""
    for batch in slices(batches, 1, 1 << 20):
        names, codes = np.unique(np.array(batch.column(0).to_pylist(), dtype=object), return_inverse=True)
        for i, name in enumerate(names):
            data, offsets = joined(batch.column(1).filter(pa.array(codes == i)))
            for _, _, a, b, c, d in _contexts(data, offsets, 0):
                gram, n = np.unique(a << 24 | b << 16 | c << 8 | d, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(gram), pa.string()), pa.array(gram), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])


def _blend(counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Probabilities of a batch of contexts (rows) from their counts and the next shorter contexts' probabilities."""
    n, d = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
    rest = np.where(counts > 0, 0, shorter)
    mass = rest.sum(1, keepdims=True)
    closed = mass <= 0  # every symbol was seen: nothing to escape to
    escape = np.where(closed, 0, d / np.maximum(n + d, 1)) / np.where(closed, 1, mass)
    return np.where(n == 0, shorter, np.where(counts > 0, counts / np.maximum(np.where(closed, n, n + d), 1), rest * escape))


def _most(languages: int) -> int:
    """Contexts of either length: with more languages fewer, so that contexts x languages stay bounded."""
    return max(512, min(MAX_CONTEXTS, 40 * MAX_CONTEXTS // languages))


def _level(node: np.ndarray, nodes: int, byte: np.ndarray, which: np.ndarray, n: np.ndarray, languages: int, shorter) -> Level:
    """shorter(nodes, bytes): probabilities in the next shorter contexts, a column for each language."""
    key = node * 256 + byte
    kept = np.unique(key[node > 0])
    index = np.full((nodes + 1) * 256, -1, dtype=np.int32)
    index[kept] = np.arange(len(kept))
    owner = kept // 256
    before = shorter(owner, kept % 256)
    bits, escape = np.empty((len(kept), languages), dtype=np.float32), np.zeros((nodes + 1, languages), dtype=np.float32)
    for i in range(languages):
        mine = (which == i) & (node > 0)
        count = np.bincount(index[key[mine]], n[mine], len(kept))
        total, kinds = np.bincount(owner, count, nodes + 1), np.bincount(owner, count > 0, nodes + 1)
        mass = 1 - np.bincount(owner, np.where(count > 0, before[:, i], 0), nodes + 1)
        closed = (kinds == 256) | (mass <= 1e-12)  # every byte was seen: nothing to escape to
        factor = np.where(total == 0, 1, np.where(closed, 1e-300, kinds / np.maximum(total + kinds, 1) / np.where(closed, 1, mass)))
        p = np.where(count > 0, count / np.maximum(total + np.where(closed, 0, kinds), 1)[owner], before[:, i] * factor[owner])
        bits[:, i] = -np.log2(np.maximum(p, 1e-300))
        escape[:, i] = -np.log2(factor)
    return Level(index.reshape(-1, 256), bits, escape)


def fit(lang: np.ndarray, gram: np.ndarray, n: np.ndarray) -> Model | None:
    """The model from counted four-byte strings, one entry for each language and string."""
    languages = sorted(set(lang))
    if not languages:
        return None
    which = np.searchsorted(np.array(languages, dtype=object), lang)
    a, b, c, d = ((gram >> s & 255).astype(np.int64) for s in (24, 16, 8, 0))

    def nodes(context: np.ndarray, space: int, times: np.ndarray) -> np.ndarray:
        """Numbers from 1 for the contexts seen most; 0 for the others."""
        seen = np.bincount(context, times, space)
        keep = np.argsort(-seen, kind="stable")[: _most(len(languages))]
        keep = np.sort(keep[seen[keep] >= LEAST_SEEN])
        out = np.zeros(space, dtype=np.int32)
        out[keep] = np.arange(1, len(keep) + 1)
        return out

    pair = nodes(b * 256 + c, 1 << 16, n)
    pairs = int(pair.max())
    front = pair[a * 256 + b].astype(np.int64)
    triple = nodes(front * 256 + c, (pairs + 1) * 256, np.where(front > 0, n, 0))
    base = np.empty((256, 256, len(languages)))
    for i in range(len(languages)):
        m = which == i
        empty = _blend(np.bincount(d[m], n[m], 256)[None, :], np.full((1, 256), 1 / 256))
        base[:, :, i] = _blend(np.bincount(c[m] * 256 + d[m], n[m], 1 << 16).reshape(256, 256), np.repeat(empty, 256, 0))
    of_pair = np.concatenate([[0], np.flatnonzero(pair) & 255])  # a node's last byte
    two = _level(pair[b * 256 + c].astype(np.int64), pairs, d, which, n, len(languages), lambda x, y: base[of_pair[x], y])
    back = np.flatnonzero(triple)
    middle = np.flatnonzero(pair)[back // 256 - 1] & 255
    of_triple, last = np.concatenate([[0], pair[middle * 256 + (back & 255)]]), np.concatenate([[0], back & 255])

    def after_pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        node = of_triple[x]
        entry = two.index[node, y]
        spelled = base[last[x], y] * np.exp2(-two.escape[node].astype(np.float64))
        return np.where((entry >= 0)[:, None], np.exp2(-two.bits[entry].astype(np.float64)) if len(two.bits) else 0, spelled)

    deep = triple[front * 256 + c].astype(np.int64)
    three = _level(deep, len(back), d, which, n, len(languages), after_pair)
    return Model(languages, -np.log2(base).astype(np.float32), pair, triple, two, three)


def code_lengths(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of each row in each language; the rows' bytes stand end to end."""
    out = np.zeros((len(offsets) - 1, len(model.languages)))
    filled = np.flatnonzero(np.diff(offsets))
    for s, e, a, b, c, d in _contexts(data, offsets, 0):  # before a text stand zero bytes
        deep = model.triple[model.pair[a * 256 + b].astype(np.int64) * 256 + c]
        entry = model.triples.index[deep, d]
        bits = np.empty((e - s, len(model.languages)), dtype=np.float32)
        known = entry >= 0
        bits[known] = model.triples.bits[entry[known]]
        rest = np.flatnonzero(~known)
        two = model.pair[b[rest] * 256 + c[rest]]
        entry = model.pairs.index[two, d[rest]]
        known = entry >= 0
        bits[rest[known]] = model.pairs.bits[entry[known]] + model.triples.escape[deep[rest[known]]]
        last = rest[~known]
        bits[last] = model.base[c[last], d[last]] + model.pairs.escape[two[~known]] + model.triples.escape[deep[last]]
        rows = filled[(offsets[filled] < e) & (offsets[filled + 1] > s)]
        out[rows] += np.add.reduceat(bits, np.maximum(offsets[rows], s) - s, axis=0, dtype=np.float64)
    return out


def train(docs: DataFrame, seed: int = SEED) -> Model | None:
    """The model from docs (doc_id, text, lang): rows with text and lang, outside the held-out third."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    sums = rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes")).collect()
    most = min(SAMPLE_BYTES, TOTAL_BYTES // max(1, len(sums)))
    rate = docs.sparkSession.createDataFrame([(r["lang"], most / max(1, r["bytes"])) for r in sums], "lang string, share double")
    hashed = F.xxhash64("text", "doc_id", F.lit(seed)).alias("hash")
    pieces = rows.join(small(rate, 100_000), "lang").select("lang", "share", "text", hashed, F.explode(F.sequence(F.lit(0), F.length("text"), F.lit(PIECE))).alias("at"))
    part = F.pmod(F.xxhash64("hash", "at"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = pieces.where(part < F.col("share")).select("lang", F.expr(f"substring(text, at + 1, {PIECE})").alias("text"))
    counted = sample.transform(map_rows, _grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    return fit(np.array(counted["lang"].to_pylist(), dtype=object), np.asarray(counted["gram"]), np.asarray(counted["n"]))


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs: doc_id, text, lang (for learning only), more columns or none. A row for each of its rows: doc_id,
    held_out, lang_pred, score (the winner's posterior probability under equal priors), bits (its code length).

    A null text and one without a letter are `und` with score 0, and so is everything if nothing could be learned.
    Equal code lengths go to the language first in code point order. A null doc_id isn't held out, nor
    learned from. Repeated rows give repeated rows; an empty table gives an empty result; texts of any length are scored whole.
    """
    model = model or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, 2, 1 << 20):
            known = np.asarray(batch.column(3)).astype(bool) & (model is not None)
            best, score, bits = np.zeros(len(known), dtype=int), np.zeros(len(known)), np.zeros(len(known))
            if model is not None:
                found = code_lengths(model, *joined(batch.column(2)))
                best, bits = found.argmin(1), np.where(known, found.min(1), 0)
                score = np.where(known, 1 / np.exp2(np.maximum(found.min(1, keepdims=True) - found, -1000)).sum(1), 0)
            names = [model.languages[i] if k else UNKNOWN for i, k in zip(best, known)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(score), pa.array(bits)], names=["doc_id", "held_out", "lang_pred", "score", "bits"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    return rows.transform(map_rows, run, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double, bits double")


def with_known_language(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs without those that `identify` calls `und`, each with the predicted language as its lang; all other columns, whatever their
    names, stay as they are. Rows pass through one by one: repeated ones stay repeated, null texts go, an empty table stays empty,
    and if nothing could be learned nothing is left."""
    model = model or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text, lang = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, text, 1 << 20):
            best = code_lengths(model, *joined(batch.column(text))).argmin(1)
            names = pa.array([model.languages[i] for i in best], pa.string())
            yield pa.RecordBatch.from_arrays([names if i == lang else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    lettered = docs.where(F.col("text").rlike(r"\p{L}") & F.lit(model is not None)).toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return lettered.transform(map_rows, run, lettered.schema).toDF(*docs.columns)


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


QUERIES = {"op5_ppm_langid": op5_langid}
ORACLE: dict[str, str] = {}
