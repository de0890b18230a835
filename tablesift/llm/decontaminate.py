"""Benchmark decontamination by winnowing, with DataFrame functions only.

A text is the sequence of its word hashes. Of every WINDOW consecutive GRAM-word hashes the least is
kept; GRAM + WINDOW - 1 = SPAN words, so any shared span of SPAN words leaves a fingerprint on both
sides. Training fingerprints are joined with those of the test items. Where a fingerprint is met, the hit is extended: the spans
of SPAN words around it are held against those of the items, and what matches, united, are all words covered. An item shorter
than a span is one window of its own length; its fingerprint is its only hash of that many words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, row_key, small, table, without_rows

GRAM, WINDOW = 5, 6
SPAN = GRAM + WINDOW - 1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words: every ASCII character but letters and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Tables of at most so many rows, of fixed width, are broadcast.
BROADCAST_ROWS = 300_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def word_hashes(text: Column) -> Column:
    """Hashes of the words; only A-Z is lower-cased (lower() does just that to texts and words of ASCII alone)."""
    plain = F.octet_length(text) == F.length(text)
    word = lambda w: F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(F.translate(w, UPPER, LOWER))
    return F.when(plain, F.transform(words_of(F.lower(text)), lambda w: F.xxhash64(w))).otherwise(F.transform(words_of(text), lambda w: F.xxhash64(word(w))))


def _pairs(a: str, b: str, by: int, f: Callable[[Column, Column], Column]) -> Column:
    """f of a[i] and b[i + by], for each i where b has it."""
    n = F.greatest(F.size(b) - by, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(by + 1), n), f)


def _mix(x: Column, y: Column) -> Column:
    return F.xxhash64(x, y)


def grams(df: DataFrame) -> DataFrame:
    """Adds `grams`, the hashes of each GRAM words of `w`. A column of its own for each step keeps Spark from working out
    the same arrays again; lengths double, then get their rest."""
    df = df.withColumn("_2", _pairs("w", "w", 1, _mix)).withColumn("_4", _pairs("_2", "_2", 2, _mix))
    return df.withColumn("grams", _pairs("_4", "w", 4, _mix)).drop("_2", "_4")


def winnow(df: DataFrame) -> DataFrame:
    """Adds `prints` (distinct fingerprints) to a frame with `w`, the word hashes."""
    least = lambda x, y: F.least(x, y)
    df = grams(df).withColumn("_m2", _pairs("grams", "grams", 1, least)).withColumn("_m4", _pairs("_m2", "_m2", 2, least))
    return df.withColumn("prints", F.array_distinct(_pairs("_m4", "_m2", 4, least))).drop("grams", "_m2", "_m4")


def _short_grams(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Adds `s<n>` for each length: the hashes of each n words, from those of n - 1."""
    last = "w"
    for n in range(1, max(lengths, default=0) + 1):
        df = df.withColumn(f"s{n}", F.transform("w", lambda x: _mix(x, F.lit(0))) if n == 1 else _pairs(last, "w", n - 1, _mix))
        last = f"s{n}"
    return df.drop(*[f"s{n}" for n in range(1, max(lengths, default=0)) if n not in lengths])


def _window(w: Column, at: Column, n: Column) -> Column:
    """Two independent hashes of the n words from `at` (counted from 0)."""
    return F.struct(at.alias("pos"), n.alias("n"), F.xxhash64(F.slice(w, at + 1, n)).alias("a"), F.xxhash64(F.lit(1), F.slice(w, at + 1, n)).alias("b"))


def _rows(df: DataFrame, keys: list[str], array: Column, name: str) -> DataFrame:
    """A row for each entry. explode() would have Spark filter by the array's size first, and work the array out for that."""
    return df.select(*keys, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def _places(df: DataFrame, array: str) -> DataFrame:
    """(key, pos, print) of each entry."""
    return df.select("key", F.posexplode_outer(array).alias("pos", "print")).where(F.col("print").isNotNull())


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs: doc_id, text; benchmark: item_id, text; more columns or none. For each row of docs: doc_id, n_words, n_hit,
    n_items, items_sha256, contaminated, and its row_key as key.

    Null and wordless texts have no words and no windows; a null item_id counts as an item and reads `null` in the
    list; rows of one item_id are one item; repeated documents are treated alike. With either table empty nothing is hit. Texts of
    any length are read whole.
    """
    words = lambda df: df.withColumn("w", word_hashes(F.col("text")))
    items = words(benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text")).select("item", "w").where(F.size("w") > 0)
    items = materialize(items.withColumn("n", F.least(F.size("w"), F.lit(SPAN))), "items")
    short = sorted(r[0] for r in items.where(F.col("n") < SPAN).select("n").distinct().collect())  # fewer than SPAN of them
    at = F.sequence(F.lit(0), F.size("w") - F.col("n"))
    windows = _rows(items, ["item"], F.transform(at, lambda i: _window(F.col("w"), i, F.col("n"))), "x").select("item", "x.n", "x.a", "x.b")
    # windows that the same items share have one list of them
    listed = windows.groupBy("n", "a", "b").agg(F.sort_array(F.collect_set("item")).alias("items"))
    listed = materialize(listed.withColumn("list", F.struct(F.xxhash64("items").alias("a"), F.xxhash64(F.lit(1), "items").alias("b"))), "windows")
    lists = materialize(listed.groupBy("list").agg(F.first("items").alias("items")), "lists")
    windows = materialize(listed.select("n", "a", "b", "list"), "spans")
    prints = materialize(_rows(winnow(items.where(F.col("n") == SPAN)), [], F.col("prints"), "print").distinct(), "prints")
    own = _short_grams(items.where(F.col("n") < SPAN), short)
    shorts = {n: materialize(own.where(F.col("n") == n).select(F.col(f"s{n}")[0].alias("print")).distinct(), "short") for n in short}

    keyed = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("key"), "text")
    hashed = words(keyed).drop("text")
    met = _rows(winnow(hashed), ["key"], F.col("prints"), "print").join(small(prints, BROADCAST_ROWS), "print", "left_semi").select("key")
    brief = _short_grams(hashed, short)
    for n in short:
        met = met.union(_rows(brief, ["key"], F.array_distinct(f"s{n}"), "print").join(small(shorts[n], BROADCAST_ROWS), "print", "left_semi").select("key"))
    met = materialize(met.distinct(), "met")
    near = materialize(words(keyed.join(small(met, BROADCAST_ROWS), "key", "left_semi")).select("key", "w").dropDuplicates(["key"]), "near")

    # a hit, extended: the windows around it
    found = _places(grams(near), "grams").join(small(prints, BROADCAST_ROWS), "print", "left_semi")
    found = found.select("key", F.lit(SPAN).alias("n"), F.explode(F.sequence(F.greatest(F.lit(0), F.col("pos") - (SPAN - GRAM)), "pos")).alias("pos"))
    brief = _short_grams(near, short)
    for n in short:
        found = found.union(_places(brief, f"s{n}").join(small(shorts[n], BROADCAST_ROWS), "print", "left_semi").select("key", F.lit(n), "pos"))
    tried = found.groupBy("key").agg(F.collect_set(F.struct("n", "pos")).alias("tried")).join(near, "key")
    tried = tried.withColumn("tried", F.filter("tried", lambda x: x["pos"] + x["n"] <= F.size("w")))
    spans = _rows(tried, ["key"], F.transform("tried", lambda x: _window(F.col("w"), x["pos"], x["n"])), "x").select("key", "x.*")
    hits = materialize(spans.join(small(windows, BROADCAST_ROWS), ["n", "a", "b"]).select("key", "pos", "n", "list"), "hits")
    # the words covered: the union of the intervals, taken in order
    ends = F.sort_array(F.collect_list(F.struct("pos", (F.col("pos") + F.col("n")).alias("end"))))
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("end"))
    covered = F.aggregate("spans", start, lambda s, x: F.struct((s["sum"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["pos"], s["end"]))).alias("sum"), F.greatest(s["end"], x["end"]).alias("end")))
    n_hit = hits.groupBy("key").agg(ends.alias("spans")).select("key", covered["sum"].cast("long").alias("n_hit"))
    joined = hits.select("key", "list").distinct().join(lists, "list").groupBy("key").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = joined.select("key", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    result = materialize(n_hit.join(joined, "key"), "found")
    counted = keyed.select("doc_id", "key", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    out = counted.join(small(result, BROADCAST_ROWS), "key", "left")
    out = out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), "key",
    )
    discard(items, listed, lists, windows, prints, *shorts.values(), met, near, hits)
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated ones, all columns as they are, whatever their names. Nulls, repeated rows and empty tables as
    in `contamination`: a document without words is never contaminated, repeated rows stay or go together."""
    bad = materialize(contamination(docs, benchmark).where("contaminated").select("key").distinct(), "bad")
    return without_rows(docs, bad, BROADCAST_ROWS)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")


QUERIES = {"op9_winnowing": op9_decontaminate}
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = {
    "op9_winnowing": rf"""
with d as (select doc_id, {_WORDS} as w from documents),
i as (select item_id, {_WORDS} as w from benchmark),
v as (select item_id, w, least(len(w), {SPAN}) as n from i where len(w) > 0),
iw as (select distinct item_id, n, array_to_string(w[p:p + n - 1], ' ') as span from (select item_id, w, n, unnest(range(1, len(w) - n + 2)) as p from v)),
dw as (select doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') as span
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as p from d, (select distinct n from iw) where len(w) >= n)),
h as (select distinct doc_id, p, n, item_id from dw join iw using (n, span)),
c as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + n)) as q from h) group by doc_id),
g as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, cast(item_id as varchar) as item from h) group by doc_id)
select d.doc_id, len(d.w) as n_words, coalesce(c.n_hit, 0) as n_hit, coalesce(g.n_items, 0) as n_items,
  sha256(coalesce(g.items, '')) as items_sha256, coalesce(c.n_hit, 0) > 0 as contaminated
from d left join c using (doc_id) left join g using (doc_id)
"""
}
