"""Line dedup: boilerplate that spreads over many sites is cut out of all documents but one.

For each line hash, HyperLogLog sketches of the sites are merged by aggregation. Lines whose
estimate is clear of the threshold are decided by it; those near it get an exact distinct count.
A line found on enough sites stays only in its home, the document with the smallest doc_id that has it, so a
text that was copied as a whole survives once. Every line counts that has a character besides ASCII white space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, discard, materialize, row_key, small, table, unused

SITES = 10
LG_K = 12
#: Estimates within this share (and one site) of the threshold are counted exactly: six standard errors of the sketch.
MARGIN = 0.1
#: Stands for a null source.
NO_SITE = "\x01"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _distinct_lines(docs: DataFrame, *keys: Column | str) -> DataFrame:
    """(keys, h, g): two hashes of each of a document's distinct lines that count. explode() would have Spark filter by the
    array's size first, and split the text once more for that."""
    each = F.array_distinct(F.transform(F.filter(lines_of(F.col("text")), _counted), F.trim))
    lines = docs.select(*keys, F.explode_outer(each).alias("line")).where(F.col("line").isNotNull())
    return lines.withColumns({"h": F.xxhash64("line"), "g": F.hash("line")}).drop("line")


def _counted(line: Column) -> Column:
    return line.rlike(r"[^\x09-\x0D\x20]")


def boilerplate(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """(h, g, home, spread) of each line on at least so many sites: two hashes of the trimmed line, its home and its
    number of sites, estimated unless `exact`."""
    lines = _distinct_lines(docs, "doc_id", F.coalesce("source", F.lit(NO_SITE)).alias("site"))
    seen = lines.groupBy("h", "g").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.min("doc_id").alias("home"))
    low, high = sites * (1 - MARGIN) - 1, sites * (1 + MARGIN) + 1
    spread = materialize(seen.select("h", "g", "home", F.hll_sketch_estimate("sketch").alias("spread")).where(F.col("spread") >= low), "spread")
    near = spread.where(F.col("spread") <= high).select("h", "g")
    exact = lines.join(small(near, 500_000), ["h", "g"], "left_semi").select("h", "g", "site").distinct().groupBy("h", "g").agg(F.count("*").alias("sites"))
    both = spread.join(exact, ["h", "g"], "left").select("h", "g", "home", F.coalesce("sites", "spread").alias("spread"), F.col("sites").isNotNull().alias("exact"))
    out = materialize(both.where(F.col("spread") >= sites), "boilerplate")
    discard(spread)
    return out


def dedup_lines(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """docs: doc_id, text, source, more columns or none. Its rows with these changes: `text` without the lines cut,
    and new columns n_lines and n_removed, which take the place of columns so named.

    A null text counts as one empty line and stays null; null sources are one more site; a null doc_id is no home as
    long as another document has the line, and never keeps one (unless all have null). Repeated rows are
    treated alike. An empty table gives an empty result.
    """
    cut = boilerplate(docs, sites)
    key, for_key, cuts, kept = unused(docs, "key", "for_key", "cuts", "kept")
    keyed = docs.select(*columns(docs), row_key(F.col("doc_id"), F.col("text")).alias(key))
    here = _distinct_lines(keyed.select("doc_id", "text", F.col(key).alias("key")), "doc_id", "key")
    hits = here.join(small(cut.select("h", "g", "home"), 500_000), ["h", "g"]).where(~F.col("doc_id").eqNullSafe(F.col("home")))
    by_doc = materialize(hits.groupBy("key").agg(F.collect_set(F.struct("h", "g")).alias("cuts")), "cut")
    weight = by_doc.agg(F.sum(F.size("cuts"))).first()[0] or 0
    by_doc = by_doc.withColumnsRenamed({"key": for_key, "cuts": cuts})
    marked = keyed.join(F.broadcast(by_doc) if weight <= 1_000_000 else by_doc, F.col(key) == F.col(for_key), "left").drop(for_key)
    lines = lines_of(F.col("text"))
    out = F.filter(lines, lambda x: ~(_counted(x) & F.array_contains(F.col(cuts), F.struct(F.xxhash64(F.trim(x)).alias("h"), F.hash(F.trim(x)).alias("g")))))
    marked = marked.withColumn(kept, F.when(F.col(cuts).isNotNull(), out))
    n_removed = F.when(F.col(cuts).isNotNull(), F.size(lines) - F.size(kept)).otherwise(F.lit(0)).cast("long").alias("n_removed")
    text = F.when(F.col(kept).isNotNull(), F.array_join(kept, "\n")).otherwise(F.col("text")).alias("text")
    given = [text if c == "text" else x for c, x in zip(docs.columns, columns(docs)) if c not in ("n_lines", "n_removed")]
    return marked.select(*given, F.size(lines).cast("long").alias("n_lines"), n_removed)


def without_boilerplate(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """docs with the lines cut and n_chars set anew; documents that had nothing else are gone.
    Nulls, repeated rows and empty tables as in `dedup_lines`; all other columns, whatever their names, stay as they are."""
    n_lines, n_removed = unused(docs, "n_lines", "n_removed")
    given = docs.withColumnsRenamed({"n_lines": n_lines, "n_removed": n_removed})
    out = dedup_lines(given, sites).where((F.col("n_removed") == 0) | (F.trim(F.regexp_replace("text", r"\s", "")) != ""))
    length = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return out.select(*[(length if c == "n_chars" else x).alias(name) for name, c, x in zip(docs.columns, given.columns, columns(given))])


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


QUERIES = {"op3_line_spread": op3_lines}
ORACLE = {
    "op3_line_spread": rf"""
with d as (select doc_id, coalesce(source, chr(1)) as site, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (select doc_id, site, unnest(lines) as line, generate_subscripts(lines, 1) as pos from d),
c as (select *, regexp_matches(line, '[^\x09-\x0D\x20]') as counted, trim(line) as norm from l),
b as (select norm, min(doc_id) as home from c where counted group by norm having count(distinct site) >= {SITES}),
k as (select c.*, not (counted and b.norm is not null and b.home <> c.doc_id) as kept from c left join b on c.norm = b.norm)
select doc_id, count(*) as n_lines, count(*) filter (where not kept) as n_removed,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where kept), '')) as kept_sha256
from k group by doc_id
"""
}
