"""SentencePiece encoding and decoding over a table of distinct chunks.

A chunk is a run of whitespace markers and what stands up to the next one. Where no piece has a marker after another character,
no merge reaches over a chunk's beginning, so chunks are segmented apart, and each distinct one of the corpus once:

* `chunk_table` counts the chunks (combined within tasks first), takes the most frequent, at most FREQUENT and of at most CHUNK_BYTES,
  segments each of them once and sends them to all tasks, a size bounded by the two;
* the tail is segmented where it occurs, each distinct chunk once in a task, which keeps up to HELD of them at a time;
* the ids of a document are those of its chunks, joined by position.

A join of the tail with a table of the whole corpus gives the same ids, but in word-rich texts it moves several times the corpus
(README.md has the figures); segmenting a rare chunk again in another task costs less than sending it there and back.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, materialize, slices, table, unused

MARK = "▁"
FREQUENT = 100_000
CHUNK_BYTES = 256
#: A task's counts are handed on, and its own table begins anew, when it has met so many distinct chunks.
HELD = 200_000
#: Texts are cut, ids decoded, in stretches of so many chunks.
STRETCH = 1 << 16
#: A chunk without its first marker, which the library puts there itself.
_CHUNK = re.compile(f"{MARK}({MARK}*[^{MARK}]*)")


def default_model() -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        return file.read()


@lru_cache(maxsize=2)
def processor(model: bytes):
    """The library's processor, if chunks of this model can be segmented apart."""
    import sentencepiece

    out = sentencepiece.SentencePieceProcessor(model_proto=model)
    if any(MARK in out.id_to_piece(i).lstrip(MARK) for i in range(out.get_piece_size())):
        raise ValueError("the model has pieces that reach over a whitespace marker")
    probe = "  é éﬁ "
    if out.decode(out.encode(probe)) != probe:
        raise ValueError("the model normalizes texts")
    return out


def chunks(text: str | None) -> Iterator[list[str]]:
    """A text's chunks, each without its first marker, in lists of at most STRETCH."""
    if text:
        held = []
        for found in _CHUNK.finditer(MARK + text.replace(" ", MARK)) if len(text) > STRETCH else (None,):
            if found is None:
                yield _CHUNK.findall(MARK + text.replace(" ", MARK))
                return
            held.append(found[1])
            if len(held) == STRETCH:
                yield held
                held = []
        if held:
            yield held


def segment(library, chunk: str) -> list[int]:
    """Ids of one chunk. A lone marker is its own piece: as a text it would be empty."""
    return library.encode(chunk.replace(MARK, " ")) if chunk else [library.piece_to_id(MARK)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[str] = Counter()
    for batch in batches:
        for text in batch.column(0):
            for part in chunks(text.as_py()):
                seen.update(part)
                if len(seen) > HELD:
                    yield from _counts(seen)
                    seen.clear()
    yield from _counts(seen)


def _counts(seen: Counter[str]) -> Iterator[pa.RecordBatch]:
    rows = list(seen.items())
    for i in range(0, len(rows), 10_000):
        part = rows[i : i + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())], names=["chunk", "n"])


def segments(library, chunk: list[str]) -> list[bytes]:
    """`segment` for many, as 32-bit little-endian ids."""
    found = library.encode([c.replace(MARK, " ") for c in chunk], num_threads=1)
    return [np.array(ids if c else segment(library, c), dtype="<i4").tobytes() for c, ids in zip(chunk, found)]


def chunk_table(docs: DataFrame, model: bytes, frequent: int = FREQUENT) -> DataFrame:
    """The most frequent chunks of docs.text, at most `frequent`: chunk, n (how often), ids (32-bit little-endian)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = processor(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(segments(library, batch.column(0).to_pylist()), pa.binary())], names=["chunk", "n", "ids"])

    counted = docs.select("text").transform(map_rows, _counted, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))
    counted = materialize(counted, "chunks")
    # how many chunks there are by eighths of powers of two of n says from which n on at most `frequent` are left; none are sorted
    level = F.floor(F.log2("n") * 8)
    least, left = None, frequent
    for r in counted.where(F.octet_length("chunk") <= CHUNK_BYTES).groupBy(level.alias("level")).agg(F.count("*").alias("c"), F.min("n").alias("n")).orderBy(F.desc("level")).collect():
        left -= r["c"]
        if left < 0:
            break
        least = r["n"]
    most = counted.where((F.octet_length("chunk") <= CHUNK_BYTES) & (F.lit(False) if least is None else F.col("n") >= least))
    return most.transform(map_rows, run, "chunk string, n long, ids binary")


def encode(docs: DataFrame, model: bytes | None = None, frequent: int = FREQUENT, held: int = HELD) -> DataFrame:
    """docs: doc_id, text, more columns or none. A row for each of its rows: doc_id, ids (array of int), exactly those of the library's
    encode() without begin or end ids. frequent, held: entries of the corpus's and of a task's table; they don't change the result.

    A null text is empty and has no ids. Repeated rows are encoded alike; null ids are allowed; an empty table gives an empty
    result; texts of any length are encoded whole, in stretches. Other columns are not read. A chunk is segmented by one
    call of the library, as a whole text is without this module, so a text without white space needs what it needs there.
    """
    model = model or default_model()
    processor(model)  # faults of the model show here
    top = chunk_table(docs, model, frequent).toArrow()
    shared = docs.sparkSession.sparkContext.broadcast((model, dict(zip(top["chunk"].to_pylist(), top["ids"].to_pylist()))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        proto, table = shared.value
        library, known = processor(proto), dict(table)
        for batch in slices(batches, 1, 2 << 20):
            flat, ends = [], [0]
            for text in batch.column(1):
                ids = []
                for part in chunks(text.as_py()):
                    new = list(set(part).difference(known))
                    if len(known) + len(new) > len(table) + held:
                        known = dict(table)
                        new = list(set(part).difference(known))
                    if new:
                        known.update(zip(new, segments(library, new)))
                    ids.append(b"".join(map(known.__getitem__, part)))
                flat += ids
                ends.append(ends[-1] + sum(map(len, ids)) // 4)
            ids = pa.ListArray.from_arrays(pa.array(np.array(ends), pa.int32()), pa.array(np.frombuffer(b"".join(flat), dtype="<i4"), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").transform(map_rows, run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>")


def decode(encoded: DataFrame, model: bytes | None = None) -> DataFrame:
    """encoded: ids, more columns or none. It, with the library's decode(ids) as another column, text (or text_, ...). Null ids are
    null; long lists go to the library in stretches that begin with a marker."""
    shared = encoded.sparkSession.sparkContext.broadcast(model or default_model())
    (name,) = unused(encoded, "text")
    at = encoded.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = processor(shared.value)
        marked = np.array([library.id_to_piece(i).startswith(MARK) for i in range(library.get_piece_size())])
        for batch in batches:
            texts = [None if not ids.is_valid else _decoded(library, marked, ids.values.to_numpy()) for ids in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, name])

    plain = encoded.toDF(*[f"c{i}" for i in range(len(encoded.columns))])
    schema = ", ".join(f"{c} {t}" for c, t in plain.dtypes)
    return plain.transform(map_rows, run, f"{schema}, out string").toDF(*encoded.columns, name)


def _decoded(library, marked: np.ndarray, ids: np.ndarray) -> str:
    out, at = [], 0
    while at < len(ids):
        end = at + STRETCH
        later = np.flatnonzero(marked[ids[end:]]) if end < len(ids) else ()
        end = end + int(later[0]) if len(later) else len(ids)
        out.append((" " if at else "") + library.decode(ids[at:end].tolist()))  # a text's first marker is dropped, no other
        at = end
    return "".join(out)


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode(table(spark, sf_dir, "documents"))
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256")
    return decode(encoded).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest, F.sha2("text", 256).alias("decoded_sha256"))


QUERIES = {"op12_distinct_chunks": op12_pieces}
ORACLE: dict[str, str] = {}
