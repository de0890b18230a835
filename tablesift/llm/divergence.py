"""How the sources of a language differ in the words they use, by triangular discrimination, in exact integers.

Count columns are deduplicated: terms of a language with the same sparse vector of counts by source are one column with a
multiplicity. Each pair of sources is evaluated once for each distinct column and the value multiplied; the ranked terms are the
original ones again, of which a column needs only the first TOP.

Counting happens within tasks first. Sources come in blocks of BLOCK: a column is cut down to each pair of blocks (and
deduplicated again where there are several), so what a task holds has BLOCK**2 sums, whatever the number of sources.
"""

from __future__ import annotations

from collections import Counter, OrderedDict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, map_rows, materialize, small, table

MIN_DOCS = 10
TOP = 10
SCALE = 1_000_000_000
BLOCK = 256
#: A task hands its counts on when it has so many entries.
HELD = 200_000
STRETCH = 4 << 20
BROADCAST_ROWS = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A-Z to lower case; ASCII bytes that are no letters become spaces; all other bytes belong to terms.
_TERM_BYTES = bytes(b if b > 0x7F or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def _stretches(data: bytes) -> Iterator[bytes]:
    """data in pieces of about STRETCH bytes that end at spaces."""
    at = 0
    while len(data) - at > STRETCH:
        end = data.find(b" ", at + STRETCH)
        if end < 0:
            break
        yield data[at:end]
        at = end
    yield data[at:]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents by (lang, source, term); each group comes with a null term too, so that none is lost."""
    found: dict[tuple[str, str], tuple[Counter[bytes], Counter[bytes]]] = {}
    size = 0
    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
            n, docs = found.setdefault((lang, source), (Counter(), Counter()))
            own: set[bytes] = set()
            size -= len(n)
            for part in _stretches((text.as_py() or b"").translate(_TERM_BYTES)):
                words = part.split()
                n.update(words)
                own.update(words)
            docs.update(own)
            size += len(n) + 1
            if size > HELD:
                yield from _groups(found)
                found, size = {}, 0
    yield from _groups(found)


def _groups(found: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), (n, docs) in found.items():
        terms = [None, *n]
        for i in range(0, len(terms), 10_000):
            part = terms[i : i + 10_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()).cast(pa.string()), pa.array([n.get(t, 0) for t in part], pa.int64()), pa.array([docs.get(t, 0) for t in part], pa.int64())],
                names=["lang", "source", "term", "n", "docs"],
            )


def shares(count: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kept)), by long division in steps of a thousand: no overflow below 9e15 words."""
    rest, below = count + 2, np.maximum(total + 2 * kept, 1)
    out = np.zeros_like(rest)
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // below, rest % below
    return out + 1


def share(count: str, total: str, kept: str) -> Column:
    """The same for columns, given as expressions of longs."""
    below = f"({total} + 2 * {kept})"
    first = f"(({count} + 2) * 1000)"
    second = f"({first} % {below} * 1000)"
    third = f"({second} % {below} * 1000)"
    return F.expr(f"1 + ({first} div {below}) * 1000000 + ({second} div {below}) * 1000 + ({third} div {below})")


def _evaluated(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """size: sources in a block. Rows: lang, i, j (blocks), kept, left and right (words of the sources of either block), part (the column's counts in them), m.
    Sums of m * f for each pair of sources, a before b."""
    sums: OrderedDict[tuple, tuple[np.ndarray, int, int]] = OrderedDict()
    for batch in batches:
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
        for key in dict.fromkeys(keys):
            rows = batch.take(pa.array([k for k, x in enumerate(keys) if x == key])) if len(set(keys)) > 1 else batch
            _, i, j = key
            left, right = (np.array(rows.column(c)[0].values, dtype=np.int64) for c in (4, 5))
            part, m, kept = rows.column(6), np.asarray(rows.column(7)), rows.column(3)[0].as_py()
            owner, flat = np.repeat(np.arange(len(rows)), np.diff(np.asarray(part.offsets))), part.flatten()
            s, n = np.asarray(flat.field(0)), np.asarray(flat.field(1))
            p, q = np.zeros((len(rows), len(left)), dtype=np.int64), np.zeros((len(rows), len(right)), dtype=np.int64)
            for block, into in ((i, p), (j, q)):
                own = s // size == block
                into[owner[own], s[own] % size] = n[own]
            p, q = shares(p, left, kept), shares(q, right, kept)
            out = sums.setdefault(key, (np.zeros((len(left), len(right)), dtype=np.int64), i, j))[0]
            for a in range(len(left)):
                after = slice(a + 1 if i == j else 0, None)
                x, y = p[:, a : a + 1], q[:, after]
                out[a, after] += ((x - y) ** 2 // (x + y) * m[:, None]).sum(0)
            while len(sums) > 32:
                yield _summed(size, *sums.popitem(last=False))
    for item in sums.items():
        yield _summed(size, *item)


def _summed(size: int, key: tuple, item: tuple[np.ndarray, int, int]) -> pa.RecordBatch:
    out, i, j = item
    a, b = np.nonzero(np.triu(np.ones(out.shape, dtype=bool), 1) if i == j else np.ones(out.shape, dtype=bool))
    return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(a), pa.string()), pa.array(a + i * size, pa.int32()), pa.array(b + j * size, pa.int32()), pa.array(out[a, b])], names=["lang", "a", "b", "value"])


def columns_of(kept: DataFrame, top: int = TOP) -> DataFrame:
    """kept: lang, term, column. The distinct ones: lang, column, m (its terms), terms (their first `top`)."""
    line = Window.partitionBy("lang", "column").orderBy("term")
    first = kept.withColumn("nth", F.row_number().over(line)).where(F.col("nth") <= top).groupBy("lang", "column").agg(F.collect_list("term").alias("terms"))
    return kept.groupBy("lang", "column").agg(F.count("*").alias("m")).join(first, ["lang", "column"])


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, size: int = BLOCK) -> DataFrame:
    """docs: text, lang, source, more columns or none. Rows lang, source, part, item, value, rank:
    part `pair`: each other source of the language by its divergence; part `term`: the first `top` terms that the source uses
    more than the language does. size: sources in a block.

    Null text, lang and source are empty ones. Each row is a document of its own, repeated ones too; groups without terms keep their
    pairs; a language without kept terms has pairs of value 0; one with one source has none. Equal values rank by item. An empty
    table gives an empty result. Texts of any length are read whole, in stretches. Other columns are not read.
    The result has a row for each two sources of a language; nothing but that grows with their square.
    """
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    counted = docs.select(*text, "text").transform(map_rows, _counted, "lang string, source string, term string, n long, docs long")
    counts = materialize(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    numbered = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = materialize(counts.where("term is null").select("lang", "source", numbered.alias("s")), "groups")
    by_term = counts.where("term is not null").join(small(groups, BROADCAST_ROWS), ["lang", "source"]).groupBy("lang", "term")
    kept = by_term.agg(F.sort_array(F.collect_list(F.struct("s", "n"))).alias("column"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    kept = materialize(kept.select("lang", "term", "column"), "kept")
    words = kept.select("lang", F.explode("column").alias("x")).groupBy("lang", F.col("x.s").alias("s")).agg(F.sum("x.n").alias("words"))
    terms = kept.groupBy("lang").agg(F.count("*").alias("kept"))
    sources = groups.join(words, ["lang", "s"], "left").join(terms, "lang", "left").select("lang", "s", "source", F.coalesce("words", F.lit(0)).alias("words"), F.coalesce("kept", F.lit(0)).alias("kept"))
    sources = materialize(sources, "sources")
    distinct = materialize(columns_of(kept, top), "columns")

    # pairs
    block = sources.groupBy("lang", F.expr(f"s div {size}").cast("int").alias("i"), "kept").agg(F.sort_array(F.collect_list(F.struct("s", "words")))["words"].alias("left"))
    two = block.join(block.select("lang", F.col("i").alias("j"), F.col("left").alias("right")), "lang").where("i <= j")
    two = materialize(two, "blocks")
    sides = small(two, 2000)  # at most 4 KB each
    part = F.expr(f"filter(column, x -> x.s div {size} = i or x.s div {size} = j)")
    cut = distinct.join(sides.select("lang", "i", "j"), "lang").groupBy("lang", "i", "j", part.alias("part")).agg(F.sum("m").alias("m"))
    nothing = two.select("lang", "i", "j", F.lit(None).cast(cut.schema["part"].dataType).alias("part"), F.lit(0).cast("long").alias("m"))  # pairs without terms
    rows = cut.union(nothing).join(sides, ["lang", "i", "j"])
    rows = rows.select("lang", "i", "j", "kept", "left", "right", F.coalesce("part", F.array().cast(cut.schema["part"].dataType)).alias("part"), "m")
    value = rows.transform(map_rows, partial(_evaluated, size), "lang string, a int, b int, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = value.select("lang", "value", F.explode(F.array(F.struct(F.col("a").alias("s"), F.col("b").alias("other")), F.struct(F.col("b").alias("s"), F.col("a").alias("other")))).alias("x"))
    name = small(sources.select("lang", "s", "source"), BROADCAST_ROWS)
    pairs = both.select("lang", "value", "x.*").join(name, ["lang", "s"]).join(name.select("lang", F.col("s").alias("other"), F.col("source").alias("item")), ["lang", "other"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    # terms
    whole = sources.groupBy("lang").agg(F.sum("words").alias("all_words"))
    used = distinct.select("lang", "terms", F.expr("aggregate(column, 0L, (t, x) -> t + x.n)").alias("all"), F.explode("column").alias("x")).select("lang", "terms", "all", "x.*")
    used = used.join(small(sources.join(whole, "lang"), BROADCAST_ROWS), ["lang", "s"])
    used = used.select("lang", "source", "terms", share("n", "words", "kept").alias("p"), share("all", "all_words", "kept").alias("q")).where("p > q")
    ranked = used.select("lang", "source", F.lit("term").alias("part"), F.explode("terms").alias("item"), F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    nth = F.row_number().over(order)
    best = ranked.withColumn("rank", nth).where(F.col("rank") <= top)
    discard(counts, groups, kept)
    return pairs.withColumn("rank", nth).union(best)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


QUERIES = {"op11_source_divergence": op11_divergence}
_SHARE = "1 + ({scale}::hugeint * ({n} + 2)) // ({total} + 2 * kept)"
_P, _Q = _SHARE.format(scale=SCALE, n="coalesce(c.n, 0)", total="words"), _SHARE.format(scale=SCALE, n="n", total="words")
ORACLE = {
    "op11_source_divergence": rf"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
  regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
t as (select r, lang, source, unnest(w) as term from d),
k as (select lang, term from t group by lang, term having count(distinct r) >= {MIN_DOCS}),
v as (select lang, (select count(*) from k where k.lang = g.lang) as kept from (select distinct lang from d) g),
c as (select lang, source, term, count(*) as n from t semi join k using (lang, term) group by lang, source, term),
s as (select g.lang, g.source, coalesce(sum(c.n), 0) as words from (select distinct lang, source from d) g left join c using (lang, source) group by g.lang, g.source),
p as (select s.lang, s.source, k.term, coalesce(c.n, 0) as n, {_P} as p from s join v using (lang) join k using (lang) left join c on c.lang = s.lang and c.source = s.source and c.term = k.term),
lt as (select lang, term, sum(n) as n from c group by lang, term),
lw as (select lang, sum(n) as words from lt group by lang),
q as (select lang, term, {_Q} as q from lt join lw using (lang) join v using (lang)),
f as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by a.lang, a.source, b.source),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f.value, 0) as value from s a join s b on a.lang = b.lang and a.source <> b.source
  left join f on f.lang = a.lang and f.source = a.source and f.item = b.source),
terms as (select lang, source, 'term' as part, term as item, (p - q) * (p - q) // (p + q) as value from p join q using (lang, term) where n > 0 and p > q),
r as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from pairs union all select * from terms))
select lang, source, part, item, value::bigint as value, rank::int as rank from r where part = 'pair' or rank <= {TOP}
"""
}
