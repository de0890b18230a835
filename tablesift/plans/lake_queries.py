"""Queries on cells, profiles and joinable columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Search
from ..functions.text import clean, is_num, strip_tags
from ..operators import lake, profile, search, sets, tiles
from ..sources import files
from ..sources.exchange import scratch


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_clean(t: str) -> str:
    """DuckDB's rendering of complex cleaning."""
    return (
        rf"trim(translate(regexp_replace(strip_accents(lower(replace(regexp_replace(regexp_replace({t}, '([A-Z]+)([A-Z][a-z])', '\1_\2', 'g'), '([a-z\d])([A-Z])', '\1_\2', 'g'), '-', '_'))), '[^\x00-\x7F]', '', 'g'),"
        " chr(10) || ' \\\"()[]', '________'), chr(9) || chr(13) || ' ' || chr(11) || chr(12))"
    )


SQL_NUM = r"regexp_matches(translate(translate({t}, ',.', ''), '%', ' '), '(?i)^\s*[+-]?(\d+(_\d+)*(e[+-]?\d+(_\d+)*)?|inf|infinity|nan)\s*$')"


def sql_is_num(t: str) -> str:
    return SQL_NUM.replace("{t}", t)


def clean_cells(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", clean(F.col("text")).alias("cleaned"))


def clean_headers(spark, sf_dir):
    """Headers made of the part types, in several spellings, some of which become the same name."""
    from ..functions.text import clean_names

    kind = F.col("p_type")
    spelled = F.array(kind, F.upper(kind), F.regexp_replace(F.initcap(kind), " ", ""), F.concat(F.lit("Été-"), kind, F.lit(" (%)")), F.concat(F.lit("HTML"), F.initcap(kind), F.lit("\n2")))
    names = sorted(r[0] for r in read(spark, sf_dir, "part").select(F.explode(spelled)).distinct().collect())
    return spark.createDataFrame(list(zip(names, clean_names(names))), "header string, cleaned string")


def is_num_filter(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.array(F.col("o_orderkey").cast("string"), "o_orderpriority", F.date_format("o_orderdate", "yyyy_MM_dd"), F.concat(F.col("o_custkey").cast("string"), F.lit("%")), F.concat(F.lit("_"), F.col("o_custkey").cast("string")))).alias("v"))
    return rows.groupBy(is_num(F.col("v")).alias("numeric")).agg(F.count("*").alias("n"), F.count_distinct("v").alias("n_distinct"))


def type_inference(spark, sf_dir):
    customer = read(spark, sf_dir, "customer")
    kinds = profile.infer_types(customer.select("*", F.when(F.col("c_acctbal") > 0, "true").otherwise("false").alias("in_credit"), F.lit(None).cast("string").alias("nothing")))
    return spark.createDataFrame(sorted(kinds.items()), "column_name string, kind string")


def lake_types(spark, sf_dir):
    """Profile and inferred type of every column of a lake, written as files and read in one scan."""
    folder = scratch(spark)
    for name in ("region", "nation", "supplier", "customer", "part", "orders"):
        df = read(spark, sf_dir, name)
        text = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns], F.when(F.col(df.columns[0]) % 2 == 0, "true").otherwise("no").alias("even"), F.lit(None).cast("string").alias("nothing"))
        text.write.parquet(f"{folder}/{name}")  # by as many tasks as read it
    return profile.profile_cells(files.table_cells(spark, folder, level=-2)).drop("column_id")


def null_profile(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_type", "user_id", F.when(F.col("value") > 50, F.col("value")).alias("value"), F.lit(None).cast("string").alias("nothing"))
    return profile.null_profile(events)


def _dimension_lake(spark, sf_dir):
    return lake.Lake(spark, {n: read(spark, sf_dir, n) for n in ("region", "nation", "supplier", "customer", "part")})


ORDER = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "supplier": ["s_suppkey"], "customer": ["c_custkey"], "part": ["p_partkey"]}


def cell_index(spark, sf_dir):
    return _dimension_lake(spark, sf_dir).cells(order=ORDER)


def distinct_values(spark, sf_dir):
    return lake.distinct_values(_dimension_lake(spark, sf_dir).cells())


def value_frequency(spark, sf_dir):
    return lake.value_frequency(_dimension_lake(spark, sf_dir).cells())


def dictionary_round_trip(spark, sf_dir):
    cells = lake.long_cells(read(spark, sf_dir, "part"), "p_brand", "p_name", "base")
    back = lake.decode(lake.encode(cells), lake.dictionary(cells))
    return back.groupBy("table_id").agg(F.count("*").alias("n_cells"), F.count_distinct("value").alias("n_values"))


def brand_columns(spark, sf_dir):
    return search.columns_of(lake.long_cells(read(spark, sf_dir, "part"), "p_brand", "p_name", "base"))


def topk_joinable_columns(spark, sf_dir):
    found = search.top_k(search.overlaps(brand_columns(spark, sf_dir)), 5)
    return found.select(F.col("r_table_id").alias("r_table"), F.col("s_table_id").alias("s_table"), F.col("k").alias("size_intersection"), "rank")


def overlap_candidates(spark, sf_dir):
    columns = brand_columns(spark, sf_dir)
    n = search.sizes(columns).where("n >= 10")
    out = search.measured(search.overlaps(columns), n).where("jaccard >= 0.5")
    return out.select(F.col("r_table_id").alias("r_table"), F.col("s_table_id").alias("s_table"), "size_r_col", "size_s_col", "size_intersection", "size_union", "jaccard", "overlap")


def candidates_of_brands(spark, sf_dir, cells, indexed):
    part = read(spark, sf_dir, "part")
    stats = part.groupBy(F.col("p_brand").alias("table_id")).agg(F.count("*").alias("n_rows"))
    stats = stats.select("table_id", F.lit(0).alias("column_id"), F.lit("p_name").alias("column_name"), "n_rows", F.lit(0.0).alias("null_ratio"))
    packages = part.groupBy(F.col("p_brand").alias("table_id")).agg(F.min_by("p_type", "p_partkey").alias("package_id"))
    out = search.candidates(cells, stats, Search(budget=10, k=8, min_height=30, min_distinct=10, min_jaccard=0.4, min_overlap=0.4), packages, indexed)
    return out.select("r_table_id", "s_table_id", "r_column_name", "s_column_name", "size_r_col", "size_s_col", "r_package_id", "s_package_id", "size_intersection", "size_union", "jaccard", "overlap")


def full_candidates(spark, sf_dir):
    """The whole search with packages, budget and filters."""
    return candidates_of_brands(spark, sf_dir, lake.long_cells(read(spark, sf_dir, "part"), "p_brand", "p_name", "base"), False)


def doc_token_overlap(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    words = F.split(F.lower("text"), r"[ \t\n\r\f]+")
    out = search.similar_sets(tiles.text_sets(docs, F.col("doc_id"), words), 0.2)
    return out.select(F.col("r_table_id").alias("r_doc"), F.col("s_table_id").alias("s_doc"), "size_intersection", "size_union", "jaccard", "overlap")


def row_intersection(spark, sf_dir):
    a = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").withColumn("k", F.col("l_partkey") % 7)
    b = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").withColumn("k", F.col("o_custkey") % 7)
    return sets.row_intersection(a.select("l_orderkey", "k"), b.select("o_orderkey", "k"), 3)


def common_attributes_union(spark, sf_dir):
    c = read(spark, sf_dir, "customer").selectExpr("c_custkey as key", "c_name as name", "c_nationkey as nation", "c_acctbal as balance", "c_mktsegment")
    s = read(spark, sf_dir, "supplier").selectExpr("s_suppkey as key", "s_name as name", "s_nationkey as nation", "s_acctbal as balance")
    return sets.union_common(c, s)


def schema_routing(spark, sf_dir):
    names = ["region", "nation", "customer", "supplier", "part"]
    tables = {n: read(spark, sf_dir, n) for n in names}
    tables["nation_copy"] = tables["nation"].select("n_regionkey", "n_name", "n_nationkey")
    rows = [(a, b, "union" if sets.same_schema(tables[a], tables[b]) else "join") for a in tables for b in tables if a < b]
    return spark.createDataFrame(rows, "r string, s string, route string")


def dedup_first(spark, sf_dir):
    return sets.first_of(read(spark, sf_dir, "documents"), ["text"], ["doc_id"]).select("doc_id", "lang", "source", "n_chars")


def dedup_subset(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").where(~F.col("text").rlike("dataset|record|table"))
    return docs.dropDuplicates(["lang", "source"]).select("lang", "source")


def strip_tags_truncate(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", strip_tags(F.col("html"), 1000).alias("notes"))


def budget_top(spark, sf_dir):
    return read(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_totalprice")


def seeded_shuffle(spark, sf_dir):
    return sets.shuffled_places(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"], 42)


def schema_text(spark, sf_dir):
    rows = [(n, profile.create_table_sql(read(spark, sf_dir, n), n)) for n in ("region", "customer", "events", "orders")]
    return spark.createDataFrame(rows, "table_name string, ddl string")


QUERIES = {
    f.__name__: f
    for f in (
        clean_cells, clean_headers, is_num_filter, type_inference, lake_types, null_profile, cell_index, distinct_values, value_frequency, dictionary_round_trip, topk_joinable_columns,
        overlap_candidates, full_candidates, doc_token_overlap, row_intersection, common_attributes_union, schema_routing, dedup_first, dedup_subset, strip_tags_truncate,
        budget_top, seeded_shuffle, schema_text,
    )
}

_PARTS = " union all ".join(f"select {t} as table_id, {c} as column_id, row_number() over (order by {key}) - 1 as row_id, {name} as v from {table}" for t, c, key, name, table in (
    (0, 1, "s_suppkey", "s_name", "supplier"), (1, 1, "r_regionkey", "r_name", "region"), (2, 1, "p_partkey", "p_name", "part"), (2, 2, "p_partkey", "p_brand", "part"), (2, 3, "p_partkey", "p_type", "part"),
    (3, 1, "n_nationkey", "n_name", "nation"), (4, 1, "c_custkey", "c_name", "customer"), (4, 4, "c_custkey", "c_mktsegment", "customer"),
))
_LAKE = f"select table_id, column_id, v from ({_PARTS})"
_CELLS = f"cells as (select table_id, column_id, {sql_clean('v')} as value from ({_LAKE}) where v is not null), kept as (select * from cells where not {sql_is_num('value')})"
_BRANDS = f"c as (select distinct p_brand as t, lower(p_name) as v from part where not {sql_is_num('lower(p_name)')}), n as (select t, count(*) as n from c group by t), i as (select a.t as r, b.t as s, count(*) as k from c a join c b on a.v = b.v and a.t < b.t group by a.t, b.t)"
_MEASURE = "x.n as size_r_col, y.n as size_s_col, k as size_intersection, x.n + y.n - k as size_union, round(k / cast(x.n + y.n - k as double), 3) as jaccard, round(k / cast(least(x.n, y.n) as double), 3) as overlap"

_COLUMNS = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey", "supplier": "s_suppkey s_name s_nationkey s_acctbal", "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice", "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
}
_ALL = " union all ".join(f"select '{t}' as t, '{c}' as c, {x} as v from {t}" for t, names in _COLUMNS.items() for c, x in [*((c, f"cast({c} as varchar)") for c in names.split()), ("even", f"case when {names.split()[0]} % 2 = 0 then 'true' else 'no' end"), ("nothing", "null")])

ORACLE = {
    "clean_cells": f"select doc_id, {sql_clean('text')} as cleaned from documents",
    "clean_headers": f"""with k as (select distinct p_type as k, array_to_string(list_transform(string_split(p_type, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') as initcap from part),
h as (select distinct unnest([k, upper(k), replace(initcap, ' ', ''), 'Été-' || k || ' (%)', 'HTML' || initcap || chr(10) || '2']) as header from k), c as (select header, {sql_clean('header')} as c from h),
n as (select header, c, row_number() over (partition by c order by header) - 1 as i from c) select header, case when i = 0 then c else c || '_' || i end as cleaned from n""",
    "is_num_filter": f"""with v as (select cast(o_orderkey as varchar) as v from orders union all select o_orderpriority from orders union all select strftime(o_orderdate, '%Y_%m_%d') from orders
 union all select cast(o_custkey as varchar) || '%' from orders union all select '_' || cast(o_custkey as varchar) from orders)
select {sql_is_num('v')} as numeric, count(*) as n, count(distinct v) as n_distinct from v group by 1""",
    "type_inference": "select * from (values ('c_acctbal', 'float'), ('c_custkey', 'int'), ('c_mktsegment', 'string'), ('c_name', 'string'), ('c_nationkey', 'int'), ('in_credit', 'boolean'), ('nothing', 'void')) t(column_name, kind)",
    "lake_types": f"""with v as ({_ALL}), c as (select t, c, v, count(*) as n from v group by t, c, v),
p as (select t, c, cast(sum(n) as bigint) as n_rows, cast(coalesce(sum(n) filter (where v is null), 0) as bigint) as n_nulls, count(v) as n_distinct,
 bool_and(lower(v) in ('true', 'false', 't', 'f', 'y', 'n', 'yes', 'no', '1', '0')) as b, bool_or(contains(v, ',') or contains(v, '.')) as dot, bool_and(try_cast(v as float) is not null) as f, bool_and(try_cast(v as integer) is not null) as i from c group by t, c)
select t as table_name, c as column_name, n_rows, n_nulls, n_distinct, round(n_nulls / n_rows, 6) as null_ratio,
 case when n_distinct = 0 then 'void' when b and n_distinct = 2 then 'boolean' when dot then case when f then 'float' else 'string' end when i then 'int' else 'string' end as kind from p""",
    "null_profile": """select cast(0 as integer) as column_id, 'event_type' as column_name, count(*) as n_rows, count(*) - count(event_type) as n_nulls, count(distinct event_type) as n_distinct, round((count(*) - count(event_type)) / count(*), 6) as null_ratio from events
union all select 1, 'user_id', count(*), count(*) - count(user_id), count(distinct user_id), round((count(*) - count(user_id)) / count(*), 6) from events
union all select 2, 'value', count(*), count(*) filter (where not coalesce(value > 50, false)), count(distinct value) filter (where value > 50), round(count(*) filter (where not coalesce(value > 50, false)) / count(*), 6) from events
union all select 3, 'nothing', count(*), count(*), 0, 1.0 from events""",
    "cell_index": f"with c as (select table_id, column_id, row_id, {sql_clean('v')} as value from ({_PARTS})) select * from c where not {sql_is_num('value')}",
    "distinct_values": f"with {_CELLS} select distinct value from kept",
    "value_frequency": f"with {_CELLS} select value, count(distinct (table_id, column_id)) as n_columns, count(*) as n_cells from kept group by value",
    "dictionary_round_trip": f"select p_brand as table_id, count(*) as n_cells, count(distinct lower(p_name)) as n_values from part where not {sql_is_num('lower(p_name)')} group by p_brand",
    "topk_joinable_columns": f"""with {_BRANDS}, b as (select r, s, k from i union all select s, r, k from i)
select r as r_table, s as s_table, k as size_intersection, rank from (select *, cast(row_number() over (partition by r order by k desc, s) as integer) as rank from b) where rank <= 5""",
    "overlap_candidates": f"with {_BRANDS} select r as r_table, s as s_table, {_MEASURE} from i join n x on x.t = r join n y on y.t = s where x.n >= 10 and y.n >= 10 and round(k / cast(x.n + y.n - k as double), 3) >= 0.5",
    "full_candidates": f"""with h as (select p_brand as t, count(*) as n_rows, arg_min(p_type, p_partkey) as pkg from part group by p_brand having count(*) >= 30),
{_BRANDS}, m as (select n.t, n.n, h.pkg from n join h using (t) where n.n >= 10), probes as (select t from (select t from h order by t limit 10) join m using (t)),
b as (select r, s, k from i union all select s, r, k from i), w as (select b.*, row_number() over (partition by r order by k desc, s) as place from b join m x on x.t = r join m y on y.t = s),
f as (select r, s, x.pkg as rp, y.pkg as sp, {_MEASURE} from w join m x on x.t = r join m y on y.t = s where place <= 8 and r in (select t from probes)),
g as (select *, row_number() over (partition by least(r, s), greatest(r, s) order by r) as first from f where jaccard >= 0.4 and overlap >= 0.4 and rp <> sp)
select r as r_table_id, s as s_table_id, 'p_name' as r_column_name, 'p_name' as s_column_name, size_r_col, size_s_col, rp as r_package_id, sp as s_package_id, size_intersection, size_union, jaccard, overlap from g where first = 1""",
    "doc_token_overlap": """with c as (select distinct doc_id as t, unnest(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f]+')) as v from documents), d as (select t, v from c where v <> ''),
n as (select t, count(*) as n from d group by t), i as (select a.t as r, b.t as s, count(*) as k from d a join d b on a.v = b.v and a.t < b.t group by a.t, b.t)
select r as r_doc, s as s_doc, k as size_intersection, x.n + y.n - k as size_union, round(k / cast(x.n + y.n - k as double), 3) as jaccard, round(k / cast(least(x.n, y.n) as double), 3) as overlap
from i join n x on x.t = r join n y on y.t = s where round(k / cast(x.n + y.n - k as double), 3) >= 0.2""",
    "row_intersection": "select l_orderkey, l_partkey % 7 as k from lineitem intersect select o_orderkey, o_custkey % 7 from orders",
    "common_attributes_union": "select c_custkey as key, c_name as name, c_nationkey as nation, c_acctbal as balance from customer union all select s_suppkey, s_name, s_nationkey, s_acctbal from supplier",
    "schema_routing": "with t(n) as (values ('region'), ('nation'), ('customer'), ('supplier'), ('part'), ('nation_copy')) select a.n as r, b.n as s, case when a.n = 'nation' and b.n = 'nation_copy' then 'union' else 'join' end as route from t a join t b on a.n < b.n",
    "dedup_first": "select doc_id, lang, source, n_chars from (select *, row_number() over (partition by text order by doc_id) as i from documents) where i = 1",
    "dedup_subset": "select distinct lang, source from documents where not regexp_matches(text, 'dataset|record|table')",
    "strip_tags_truncate": r"select page_id, substring(regexp_replace(coalesce(html, ''), '(<[^>]+>)|\n|\r|\t', ' ', 'g'), 1, 1000) as notes from pages",
    "seeded_shuffle": "select o_orderkey, o_orderstatus, row_number() over (order by md5('42,' || o_orderkey), o_orderkey) - 1 as place from orders",
    "schema_text": """select * from (values
('region', 'CREATE TABLE region (' || chr(10) || '    r_regionkey BIGINT,' || chr(10) || '    r_name VARCHAR(255)' || chr(10) || ');'),
('customer', 'CREATE TABLE customer (' || chr(10) || '    c_custkey BIGINT,' || chr(10) || '    c_name VARCHAR(255),' || chr(10) || '    c_nationkey BIGINT,' || chr(10) || '    c_acctbal FLOAT,' || chr(10) || '    c_mktsegment VARCHAR(255)' || chr(10) || ');'),
('events', 'CREATE TABLE events (' || chr(10) || '    event_id BIGINT,' || chr(10) || '    ts DATETIME,' || chr(10) || '    user_id BIGINT,' || chr(10) || '    event_type VARCHAR(255),' || chr(10) || '    value FLOAT,' || chr(10) || '    props VARCHAR(255)' || chr(10) || ');'),
('orders', 'CREATE TABLE orders (' || chr(10) || '    o_orderkey BIGINT,' || chr(10) || '    o_custkey BIGINT,' || chr(10) || '    o_orderstatus VARCHAR(255),' || chr(10) || '    o_totalprice FLOAT,' || chr(10) || '    o_orderdate DATETIME,' || chr(10) || '    o_orderpriority VARCHAR(255)' || chr(10) || ');')) t(table_name, ddl)""",
    "budget_top": "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 50",
}
