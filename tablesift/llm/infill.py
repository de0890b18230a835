"""Fill-in-the-middle transformation by a table-driven byte DFA.

One automaton over UTF-8 bytes knows the continuation bytes of a code point, the ends of units (lines with their line feed) and the
sentinels. Its table also says what a transition is worth: a code point, a unit, a sentinel. Texts are cut into rows of ROW bytes
and all rows of a slice are run in step, one byte of each at a time, so the scan is a few numpy operations for each offset. The
automaton is definite: after `warm` bytes its state no longer depends on where it began, so a row starts that many bytes early.
The counts of the rows say in which row a cut lies; a second pass runs these rows alone up to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_texts, map_rows, slices, table

SENTINELS = ("<P>", "<S>", "<M>")  # before prefix, suffix and middle
SEED = 7
#: Of 100 documents so many are transformed, and of these so many have the suffix first.
RATE, SPM = 100, 50
ROW = 512
#: What a transition is worth, packed into one sum: a row has fewer than 2**20 of each.
POINT, UNIT, SENTINEL = 1, 1 << 20, 1 << 40
#: Stands before each text; no byte of UTF-8.
PAD = 0xFF


@dataclass(frozen=True)
class Automaton:
    """next and worth by state * 256 + byte; state 0 is the start of a unit."""

    next: np.ndarray
    worth: np.ndarray
    warm: int


def automaton(sentinels: tuple[str, ...] = SENTINELS) -> Automaton:
    """States: a unit's start, within a unit, one for each beginning of a sentinel, one for 1 to 3 continuation bytes due."""
    marks = [s.encode("ascii") for s in sentinels]
    begun = sorted({m[:i] for m in marks for i in range(1, len(m))})
    start, inside, due = 0, 1, 2 + len(begun)
    at = {b"": inside, **{b: 2 + i for i, b in enumerate(begun)}}
    seen = {start: b"", **{i: b for b, i in at.items()}}
    step, worth = np.full((due + 3, 256), inside, dtype=np.int64), np.zeros((due + 3, 256), dtype=np.int64)
    step[:, PAD] = start
    for state, before in seen.items():
        for byte in range(0x80):
            now = before + bytes([byte])
            whole = any(now.endswith(m) for m in marks)
            step[state, byte] = inside if whole else next(at[now[i:]] for i in range(len(now) + 1) if now[i:] in at)
            worth[state, byte] = POINT + SENTINEL * whole
        step[state, 10], worth[state, 10] = start, POINT + UNIT
        for lead, last, more in ((0xC2, 0xDF, 0), (0xE0, 0xEF, 1), (0xF0, 0xF4, 2)):
            step[state, lead : last + 1] = due + more
    step[due, 0x80:0xC0], worth[due, 0x80:0xC0] = inside, POINT
    step[due + 1, 0x80:0xC0], step[due + 2, 0x80:0xC0] = due, due + 1
    return Automaton(step.ravel(), worth.ravel(), max(3, *(len(m) - 1 for m in marks)))


def _run(dfa: Automaton, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, state: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Rows in step, longest first. For each offset: it, how many rows are that long, the transition each of them makes."""
    live = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # rows longer than the offset
    for j in range(-dfa.warm, int(lengths[0])):
        n = live[max(j, 0)]
        move = state[:n] * 256 + data[starts[:n] + j]
        state[:n] = dfa.next[move]
        if j >= 0:
            yield j, n, move


def cuts(dfa: Automaton, texts: list[bytes], wanted) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each text: its units, whether it has a sentinel, and the place (bytes; code points) of the end of its k-th unit for each k of
    wanted(units), an array of len(texts) x w; 0 for k = 0."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    pad = bytes([PAD]) * dfa.warm
    data = np.frombuffer(b"".join(x for t in texts for x in (pad, t)), dtype=np.uint8)
    begin = np.cumsum(size + dfa.warm) - size
    rows = -(-size // ROW)
    text = np.repeat(np.arange(len(texts)), rows)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(rows) - rows, rows)
    starts, lengths = begin[text] + nth * ROW, np.minimum(ROW, size[text] - nth * ROW)
    order = np.argsort(-lengths, kind="stable")
    worth, state = np.zeros(len(text), dtype=np.int64), np.zeros(len(text), dtype=np.int64)
    if len(text):
        for _, n, move in _run(dfa, data, starts[order], lengths[order], state):
            worth[:n] += dfa.worth[move]
    found, last = np.zeros_like(worth), np.zeros_like(state)
    found[order], last[order] = worth, state
    points, units, marks = found & (UNIT - 1), found >> 20 & (UNIT - 1), found >> 40
    # sums before each row, over all rows of the slice
    ends = np.cumsum(rows)
    before = {k: np.concatenate([[0], np.cumsum(v)]) for k, v in (("points", points), ("units", units), ("marks", marks))}
    total = {k: v[ends] - v[ends - rows] for k, v in before.items()}
    tail = np.zeros(len(texts), dtype=np.int64)
    tail[rows > 0] = last[ends[rows > 0] - 1] != 0  # the last unit has no line feed
    n_units = total["units"] + tail
    k = wanted(n_units)
    at_byte, at_point = np.zeros(k.shape, dtype=np.int64), np.zeros(k.shape, dtype=np.int64)
    whole = (k > total["units"][:, None]) & (k > 0)
    at_byte[whole], at_point[whole] = np.broadcast_to(size[:, None], k.shape)[whole], np.broadcast_to(total["points"][:, None], k.shape)[whole]
    which, column = np.nonzero((k > 0) & ~whole)
    if len(which):  # second pass: the rows that hold a cut
        goal = before["units"][ends[which] - rows[which]] + k[which, column]
        row = np.searchsorted(before["units"], goal, side="left") - 1
        by = np.argsort(-lengths[row], kind="stable")
        which, column, goal, row = which[by], column[by], goal[by] - before["units"][row[by]], row[by]
        got, state = np.zeros(len(row), dtype=np.int64), np.zeros(len(row), dtype=np.int64)
        for j, n, move in _run(dfa, data, starts[row], lengths[row], state):
            value = dfa.worth[move]
            got[:n] += value
            here = np.flatnonzero((got[:n] >> 20 & (UNIT - 1) == goal[:n]) & (value >> 20 & 1 == 1))
            at_byte[which[here], column[here]] = nth[row[here]] * ROW + j + 1
            at_point[which[here], column[here]] = before["points"][row[here]] - before["points"][ends[which[here]] - rows[which[here]]] + (got[here] & (UNIT - 1))
    return n_units, total["marks"] > 0, at_byte, at_point


def draws(seed: int, ids: list[str]) -> np.ndarray:
    """Four unsigned numbers of 32 bits for each id."""
    return np.frombuffer(b"".join(hashlib.sha256(f"{seed}:{i}".encode()).digest()[:16] for i in ids), dtype=">u4").reshape(-1, 4).astype(np.int64)


def fill_in_middle(docs: DataFrame, rate: int = RATE, spm: int = SPM, seed: int = SEED) -> DataFrame:
    """docs: doc_id, text, more columns or none. A row for each of its rows: doc_id, n (units), form (plain, psm, spm), prefix_chars,
    middle_chars (code points; null if plain), output.

    A null text is empty; an empty text and one with a sentinel stay plain. A null doc_id draws as an empty one; repeated rows
    are treated alike. Texts of any length are read whole, an empty table gives an empty result, other columns are not read.
    """
    dfa = automaton()
    prefix, suffix, middle = (s.encode() for s in SENTINELS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, 4 << 20):
            texts = byte_texts(batch.column(2))
            h = draws(seed, batch.column(1).to_pylist())
            n, marked, at, point = cuts(dfa, texts, lambda n: np.sort(h[:, :2] % (n[:, None] + 1), axis=1))
            plain = marked | (n == 0) | (h[:, 2] % 100 >= rate)
            first = h[:, 3] % 100 < spm
            out = []
            for t, p, s, (a, b) in zip(texts, plain, first, at):
                x, y, z = t[:a], t[a:b], t[b:]
                out.append(t if p else b"".join((suffix, z, prefix, x, middle, y) if s else (prefix, x, suffix, z, middle, y)))
            form = np.where(plain, "plain", np.where(first, "spm", "psm"))
            chars = [pa.array(c, pa.int64(), mask=plain) for c in (point[:, 0], point[:, 1] - point[:, 0])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(form.tolist(), pa.string()), *chars, pa.array(out, pa.binary()).cast(pa.string())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text")
    return rows.transform(map_rows, run, f"doc_id {dict(docs.dtypes)['doc_id']}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text before the transformation: a text with sentinels of its own stayed plain, so there are exactly three."""
    part = F.split(output, "|".join(SENTINELS), -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(part[1], part[3], part[2])).otherwise(F.concat(part[2], part[3], part[1]))


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = (F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digest)


QUERIES = {"op13_infill_dfa": op13_infill}
_MARKED = " or ".join(f"contains(t, '{s}')" for s in SENTINELS)
_P, _S, _M = SENTINELS
ORACLE = {
    "op13_infill_dfa": rf"""
with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as u, sha256('{SEED}:' || coalesce(doc_id::varchar, '')) as h from documents),
r as (select *, len(u) as n, list_transform([0, 1, 2, 3], lambda i: ('0x' || substr(h, i * 8 + 1, 8))::ubigint::bigint) as k from d),
c as (select *, least(k[1] % (n + 1), k[2] % (n + 1)) as a, greatest(k[1] % (n + 1), k[2] % (n + 1)) as b from r),
p as (select *, coalesce(array_to_string(u[1:a], ''), '') as x, coalesce(array_to_string(u[a + 1:b], ''), '') as y, coalesce(array_to_string(u[b + 1:n], ''), '') as z,
  case when t = '' or {_MARKED} or k[3] % 100 >= {RATE} then 'plain' when k[4] % 100 < {SPM} then 'spm' else 'psm' end as form from c)
select doc_id, n, form, case when form <> 'plain' then length(x) end as prefix_chars, case when form <> 'plain' then length(y) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then concat('{_P}', x, '{_S}', z, '{_M}', y) else concat('{_S}', z, '{_P}', x, '{_M}', y) end) as output_sha256,
  sha256(t) as restored_sha256
from p
"""
}
