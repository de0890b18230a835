"""Queries that go through files, streams and the stages' exchange tables."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from ..config import Evaluation, Generation, Search
from ..functions.text import resource_id
from ..operators import dictionary, lake, metadata, profile, prompts, search, sets, workflow
from ..sources import files, portal
from ..sources.exchange import materialize, scratch
from ..streaming.index import append_cells
from . import services
from .lake_queries import _BRANDS, read, sql_clean, sql_is_num


def csv_to_parquet(spark, sf_dir):
    """A lenient Latin-1 CSV, read with a sniffed delimiter, and the gzipped Parquet table made of it."""
    folder = scratch(spark)
    read(spark, sf_dir, "supplier").select("s_suppkey", F.concat("s_name", F.lit(" é")).alias("s_name"), "s_nationkey").write.options(header=True, sep=";", encoding="ISO-8859-1").csv(f"{folder}/csv")
    files.write_table(files.read_csv(spark, f"{folder}/csv"), f"{folder}/supplier.parquet")
    return spark.read.parquet(f"{folder}/supplier.parquet")


def stage_append(spark, sf_dir):
    """Two batches appended to a stage's CSV; rows with nulls are dropped when it is read."""
    folder = scratch(spark)
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("priority"))
    for i in (0, 1, 0):  # the first batch is written again
        files.write_stage(orders.where(F.col("o_orderkey") % 2 == i), f"{folder}/stage", f"part {i}")
    orders.limit(3).write.option("header", True).csv(f"{folder}/stage/data/half-way")  # and one died before it was committed
    return files.read_stage(spark, f"{folder}/stage", "o_orderkey long, priority string")


def dictionary_batches(spark, sf_dir):
    """A dictionary that grows by two batches, the second given twice: ids are dense, the first batch's stay, and cells can be read back."""
    folder = f"{scratch(spark)}/words"
    part = read(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("value"))
    first = dictionary.grow(part.where("p_partkey % 2 = 0"), folder, "even").withColumnRenamed("id", "first_id")
    for _ in range(2):
        words = dictionary.grow(part.select("p_partkey", F.explode(F.array("value", F.concat("value", F.lit(" 2")))).alias("value")), folder, "all")
    back = lake.decode(dictionary.encode(part, words), words).join(part.withColumnRenamed("value", "was"), "p_partkey").where("value = was")
    kept = words.join(first, "value").where("id = first_id")
    count = lambda df, name: df.agg(F.count("*").alias(name))
    ids = words.agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_ids"), F.min("id").alias("least"), F.max("id").alias("most"))
    return ids.join(count(first, "n_first")).join(count(kept, "kept")).join(count(back, "read_back"))


def package_lines(spark, sf_dir):
    """Package records appended as JSON lines and read back; the accepted resources of those in English or without a language."""
    folder = scratch(spark)
    nation = read(spark, sf_dir, "nation")
    language = F.when(F.col("n_nationkey") % 3 == 0, F.array(F.lit("fr"))).when(F.col("n_nationkey") % 3 == 1, F.array(F.lit("en"), F.lit("fr")))
    resource = F.struct(F.concat(F.lit("r"), F.col("n_nationkey").cast("string")).alias("id"), F.when(F.col("n_nationkey") % 5 == 4, "PDF").otherwise("CSV").alias("format"), language.alias("language"))
    packages = nation.select(F.concat(F.lit("p"), F.col("n_nationkey").cast("string")).alias("id"), "n_regionkey", F.array(resource).alias("resources"))
    for i in (0, 1):
        files.append_packages(packages.where(F.col("n_regionkey") % 2 == i).drop("n_regionkey"), f"{folder}/packages")
    found = metadata.resources(files.read_packages(spark, f"{folder}/packages"))
    return found.select(F.col("id").alias("package_id"), F.col("resource.id").alias("resource_id"))


def lake_listing(spark, sf_dir):
    """The tables of a folder by name, their columns by footer alone, and their resources."""
    folder = scratch(spark)
    for name in ("region", "nation"):
        files.write_table(read(spark, sf_dir, name), f"{folder}/{name}_3.parquet")
    rows = [(i, name, ",".join(files.schema_names(spark, f"{folder}/{name}"))) for i, name in enumerate(files.table_names(spark, folder))]
    return spark.createDataFrame(rows, "place int, table_name string, columns string").withColumn("resource_id", resource_id(F.col("table_name")))


def resource_ids(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    name = F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("_"), F.col("p_partkey").cast("string"))).otherwise(""), F.lit(".parquet"))
    return part.select("p_partkey", resource_id(name).alias("resource_id"))


def json_file(spark, sf_dir):
    """A JSON document of several lines."""
    folder = scratch(spark)
    one = read(spark, sf_dir, "nation").agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("value"))
    one.select(F.replace("value", F.lit("},"), F.lit("},\n"))).write.text(f"{folder}/names")
    return files.read_json(spark, f"{folder}/names")


def index_lookup(spark, sf_dir):
    """The cell index as a bucketed table, and the cells of three values in it."""
    cells = lake.Lake(spark, {n: read(spark, sf_dir, n) for n in ("region", "nation")}).cells()
    name = f"cells_{uuid.uuid4().hex}"
    path = f"{scratch(spark)}/{name}"
    files.write_index(cells, name, 4, path)
    found = files.lookup(spark, name, ["asia", "nation_3", "nation_7", "nothing"])
    spark.sql(f"drop table {name}")  # the catalog's entry; the files stay
    return found.select("table_id", "column_id", "value")


def streamed_index(spark, sf_dir):
    """Two files that arrive one after the other, each indexed once."""
    folder = scratch(spark)
    part = read(spark, sf_dir, "part").select("p_brand", "p_name", "p_partkey")
    for i in (0, 1):
        part.where(F.col("p_partkey") % 2 == i).drop("p_partkey").write.mode("append").parquet(f"{folder}/in")
        append_cells(spark, f"{folder}/in", "p_brand string, p_name string", "p_brand", "p_name", f"{folder}/out", f"{folder}/progress").awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("table_id").agg(F.count("*").alias("n_cells"), F.count_distinct("value").alias("n_values"))


def _portal(spark, sf_dir):
    """Packages made of suppliers; twenty share a time of change."""
    rows = read(spark, sf_dir, "supplier").orderBy("s_suppkey").select("s_suppkey", "s_name").collect()
    return [{"id": f"p{k:06}", "title": name, "metadata_modified": f"2024-01-01T{i // 20 // 3600:02}:{i // 20 // 60 % 60:02}:{i // 20 % 60:02}"} for i, (k, name) in enumerate(rows)]


def portal_pages(spark, sf_dir):
    """The packages of a range of a portal, fetched page by page within tasks; the range ends at the portal's count."""
    packages = _portal(spark, sf_dir)
    spark.dataSource.register(portal.PortalSource)
    with services.portal_service(spark, packages) as url:
        found = materialize(spark.read.format("portal").options(url=url, **{"from": "5", "to": "1000000", "page": "30"}).load())
    return found.select("id", F.get_json_object("package", "$.title").alias("title"))


def portal_stream(spark, sf_dir):
    """Polls of a portal that grows: half of the packages, then all and one of the first again, then nothing new. How often each came."""
    packages, folder = _portal(spark, sf_dir), scratch(spark)
    spark.dataSource.register(portal.PortalSource)
    grown = packages[: len(packages) // 2 + 7]  # so that some that share a time are still to come
    with services.portal_service(spark, grown) as url:
        for later in (packages[len(grown) :] + [{**packages[0], "metadata_modified": "2024-02-01T00:00:00"}], [], []):
            stream = spark.readStream.format("portal").options(url=url, page="25").load()
            query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start(f"{folder}/packages")
            query.awaitTermination()
            grown[:] = [p for p in grown if p["id"] not in {x["id"] for x in later}] + later
    return spark.read.parquet(f"{folder}/packages").groupBy("id").agg(F.count("*").alias("n"), F.min(F.get_json_object("package", "$.title")).alias("title"))


def pinned_columns(spark, sf_dir):
    """A column first, at most four in all, and none that is null throughout."""
    df = read(spark, sf_dir, "customer").withColumn("nothing", F.lit(None).cast("string"))
    return profile.drop_null_columns(profile.pin_column(df.select("c_custkey", "nothing", "c_name", "c_mktsegment", "c_acctbal"), "c_name", 4))


def preview_rows(spark, sf_dir):
    """A table of five rows as a prompt shows it, a line each."""
    text = profile.preview(read(spark, sf_dir, "region"), 5)
    return spark.createDataFrame([(x,) for x in text.split("\n")], "line string")


def _three_columns(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    cells = lake.long_cells(part, "p_brand", "p_name", "base")
    return part, cells.withColumn("column_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))


def filtered_candidates(spark, sf_dir):
    """Each table has its column three times: under a good header, under one that may not be a probe, and with too many nulls in every other
    table. Tables of one schema are not paired."""
    part, cells = _three_columns(spark, sf_dir)
    odd = F.substring("p_brand", -1, 1).cast("int") % 2
    tables = part.groupBy(F.col("p_brand").alias("table_id"), odd.alias("odd")).agg(F.count("*").alias("n_rows"))
    columns = F.array(*[F.struct(F.lit(i).alias("column_id"), F.lit(n).alias("column_name"), x.alias("null_ratio")) for i, (n, x) in enumerate((("p_name", F.lit(0.0)), ("ship_Date", F.lit(0.0)), ("sparse", F.when(F.col("odd") == 1, 0.2).otherwise(0.19))))])
    stats = tables.select("table_id", "n_rows", F.array(F.when(F.col("odd") == 1, "a").otherwise("b")).alias("headers"), F.explode(columns).alias("c")).select("table_id", "n_rows", "headers", "c.*")
    out = search.candidates(cells, stats, Search(budget=None, k=40, min_height=5, min_distinct=5, min_jaccard=0.4, min_overlap=0.4, accept_same_schema=False))
    return out.select("r_table_id", "r_column_id", "s_table_id", "s_column_id", "size_intersection", "jaccard")


def _scored(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    brand = F.concat(F.substring("p_brand", -2, 2), F.when(F.col("p_partkey") % 11 == 0, "_1").otherwise(""))
    return part.select(
        brand.alias("r_rsc_id"), F.concat(F.lit("s"), F.col("p_size").cast("string")).alias("s_rsc_id"), (F.col("p_partkey") % 3).cast("int").alias("r_col_id"), (F.col("p_partkey") % 7).cast("int").alias("s_col_id"),
        F.lit("a").alias("r_col_name"), F.lit("b").alias("s_col_name"), (F.col("p_partkey") % 11).cast("int").alias("score"),
    )


def pairs_for_generation(spark, sf_dir):
    """Of scored pairs those of the least score on, one for each pair of tables, none of zips of several tables."""
    return workflow.usable(workflow.chosen_pairs(_scored(spark, sf_dir), Generation(min_score=8, budget=10**6))).select("r_rsc_id", "s_rsc_id", "r_col_id", "s_col_id", "score")


def seeded_samples(spark, sf_dir):
    """Draws without and with replacement: which rows, how often."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey")
    parts = []
    for kind, n, replace in (("without", 100, False), ("with", 20000, True)):
        got = sets.drawn(orders, ["o_orderkey"], n, 42, replace)
        parts.append(got.groupBy(F.lit(kind).alias("kind"), "o_orderkey").agg(F.count("*").alias("times")))
    return parts[0].union(parts[1])


def sliced_rows(spark, sf_dir):
    return sets.slice_rows(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 100, 37)


def prompt_text(spark, sf_dir):
    """The prompt that asks for a pair's score, a line each, without the five rows, which come in a seeded order."""
    context = prompts.table_context(read(spark, sf_dir, "region"), "R", "r_name", {"resource_name": "regions", "notes": "n" * 2000, "tags": ["x", "y"]})
    lines = enumerate(prompts.scoring_prompt(context, context, 0, 10).split("\n"))
    return spark.createDataFrame([x for x in lines if not re.match(r"\| [\w ]+ \| \d+ \|", x[1])], "place int, line string")


def _pairs_of_levels(spark, sf_dir):
    tables = {"nations": read(spark, sf_dir, "nation"), "customers": read(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "n_nationkey"), "suppliers": read(spark, sf_dir, "supplier").selectExpr("s_suppkey as key", "s_name as name", "s_acctbal as balance"), "buyers": read(spark, sf_dir, "customer").selectExpr("c_custkey as key", "c_name as name", "c_acctbal as balance")}
    rows = [("nations", "customers", "n_nationkey", "n_nationkey", "Nations", "Customers"), ("suppliers", "buyers", "name", "name", None, None)]
    return tables, spark.createDataFrame(rows, "r_rsc_id string, s_rsc_id string, r_col_name string, s_col_name string, r_rsc_name string, s_rsc_name string")


def generated_records(spark, sf_dir):
    """Queries and questions for two pairs, from templates; the reviewer of questions sends each first one back."""
    tables, pairs = _pairs_of_levels(spark, sf_dir)
    asked = {}

    def judge(nl, sql):
        asked[sql] = asked.get(sql, 0) + 1
        return asked[sql] > 1, "again" if asked[sql] == 1 else "approve", 1, 2

    rows = list(workflow.generate_records(pairs, tables, judge=judge))
    out = spark.createDataFrame(rows, workflow.RECORD)
    return out.select("type", "difficulty", "success", "r_rsc_id", "s_rsc_id", "r_rsc_name", "s_rsc_name", "nl_n_rev", "nl_review", "nl_intok", "nl_outok", "sql_n_rev")


def leaky_questions(spark, sf_dir):
    """Questions that quote a resource's name or use a column's never pass."""
    tables, pairs = _pairs_of_levels(spark, sf_dir)
    rows, loaded = [], {}
    for case, words in enumerate(("all of them", "what 'Nations' has", "each n_name", "the customers")):
        for r in workflow.generate_records(pairs.limit(1), tables, Generation(levels=("simple",), max_reviews=1), ask=lambda sql, review, w=words: (w, 0, 0), loaded=loaded):
            rows.append((case, r[1], r[3], r[21]))
    return spark.createDataFrame(rows, "case int, type string, success boolean, revisions int")


def evaluated_pairs(spark, sf_dir):
    """Pairs scored by a debate with a stand-in model, within the budget."""
    pairs = _scored(spark, sf_dir).drop("score").distinct()
    out = workflow.evaluate(pairs, F.concat("r_rsc_id", "s_rsc_id"), lambda prompt, solver, number, others: f"Answer: {len(prompt)}", Evaluation(budget=50))
    return out.select("r_rsc_id", "s_rsc_id", "r_col_id", "s_col_id", "score")


QUERIES = {
    f.__name__: f
    for f in (
        csv_to_parquet, stage_append, dictionary_batches, package_lines, lake_listing, resource_ids, json_file, index_lookup, streamed_index, portal_pages, portal_stream, pinned_columns, preview_rows, filtered_candidates,
        pairs_for_generation, seeded_samples, sliced_rows, prompt_text, generated_records, leaky_questions, evaluated_pairs,
    )
}

_SCORED = "p as (select right(p_brand, 2) || case when p_partkey % 11 = 0 then '_1' else '' end as r_rsc_id, 's' || cast(p_size as varchar) as s_rsc_id, cast(p_partkey % 3 as integer) as r_col_id, cast(p_partkey % 7 as integer) as s_col_id, cast(p_partkey % 11 as integer) as score from part)"
_TABLE = """Table R
- resource_name: regions
- notes: {notes}
- tags: x, y

Schema:
CREATE TABLE R (
    r_name VARCHAR(255),
    r_regionkey BIGINT
);

Rows:
| r_name | r_regionkey |
| --- | --- |
row
row
row
row
row

Column of interest: r_name"""
_PROMPT = f"Rate from 0 to 10 how sensible it is to combine these two tables on their columns of interest. End with `Answer: <number>`.\n\n{_TABLE}\n\n{_TABLE}".format(notes="n" * 1000).split("\n")

ORACLE = {
    "csv_to_parquet": "select cast(s_suppkey as varchar) as s_suppkey, s_name || ' é' as s_name, cast(s_nationkey as varchar) as s_nationkey from supplier",
    "stage_append": "select o_orderkey, o_orderpriority as priority from orders where o_orderkey % 5 <> 0",
    "dictionary_batches": """with v as (select p_type as v from part union all select p_type || ' 2' from part), w as (select count(distinct v) as n from v), f as (select count(distinct p_type) as n from part where p_partkey % 2 = 0)
select w.n, w.n as n_ids, cast(0 as bigint) as least, w.n - 1 as most, f.n as n_first, f.n as kept, (select count(*) from part) as read_back from w, f""",
    "package_lines": "select 'p' || cast(n_nationkey as varchar) as package_id, 'r' || cast(n_nationkey as varchar) as resource_id from nation where n_nationkey % 5 <> 4 and n_nationkey % 3 <> 0",
    "lake_listing": "select * from (values (0, 'region_3.parquet', 'r_regionkey,r_name', 'region'), (1, 'nation_3.parquet', 'n_nationkey,n_name,n_regionkey', 'nation')) t(place, table_name, columns, resource_id)",
    "resource_ids": "select p_partkey, p_name as resource_id from part",
    "json_file": "select n_nationkey, n_name from nation",
    "index_lookup": f"with c as (select 0 as table_id, 1 as column_id, r_name as v from region union all select 1, 1, n_name from nation) select table_id, column_id, {sql_clean('v')} as value from c where {sql_clean('v')} in ('asia', 'nation_3', 'nation_7')",
    "streamed_index": f"select p_brand as table_id, count(*) as n_cells, count(distinct {sql_clean('p_name')}) as n_values from part where not {sql_is_num(sql_clean('p_name'))} group by p_brand",
    "portal_pages": "select 'p' || lpad(cast(s_suppkey as varchar), 6, '0') as id, s_name as title from supplier order by s_suppkey offset 5",
    "portal_stream": "select 'p' || lpad(cast(s_suppkey as varchar), 6, '0') as id, case when s_suppkey = (select min(s_suppkey) from supplier) then 2 else 1 end as n, s_name as title from supplier",
    "pinned_columns": "select c_name, c_custkey, c_mktsegment from customer",
    "preview_rows": "select '| r_regionkey | r_name |' as line union all select '| --- | --- |' union all select '| ' || cast(r_regionkey as varchar) || ' | ' || r_name || ' |' from region",
    "filtered_candidates": f"""with {_BRANDS}, h as (select p_brand as t, count(*) as n_rows, cast(right(p_brand, 1) as integer) % 2 as odd from part group by p_brand),
f as (select h.t, odd, col from h, (values (0), (1), (2)) c(col) where n_rows >= 5 and not (col = 2 and odd = 1)), m as (select f.*, n.n from f join n using (t) where n.n >= 5),
b as (select r, s, k from i union all select s, r, k from i), x as (select a.t as rt, a.col as rc, a.odd as ro, a.n as rn, z.t as st, z.col as sc, z.odd as so, z.n as sn, k from b join m a on a.t = r join m z on z.t = s),
w as (select *, row_number() over (partition by rt, rc order by k desc, st, sc) as place from x),
g as (select *, round(k / cast(rn + sn - k as double), 3) as jaccard from w where place <= 40 and rc <> 1 and round(k / cast(rn + sn - k as double), 3) >= 0.4 and round(k / cast(least(rn, sn) as double), 3) >= 0.4 and ro <> so),
u as (select *, row_number() over (partition by least((rt, rc), (st, sc)), greatest((rt, rc), (st, sc)) order by rt, rc) as one from g)
select rt as r_table_id, rc as r_column_id, st as s_table_id, sc as s_column_id, k as size_intersection, jaccard from u where one = 1""",
    "pairs_for_generation": f"with {_SCORED}, o as (select *, row_number() over (partition by r_rsc_id, s_rsc_id order by score desc, r_col_id, s_col_id) as i from p where score >= 8) select r_rsc_id, s_rsc_id, r_col_id, s_col_id, score from o where i = 1 and not contains(r_rsc_id, '_')",
    "seeded_samples": """with o as (select o_orderkey, row_number() over (order by o_orderkey) - 1 as place from orders), w as (select o_orderkey from orders order by md5('42,' || o_orderkey), o_orderkey limit 100),
c as (select count(*) as c from orders), d as materialized (select cast(('0x' || substr(md5('42,' || i), 1, 15))::bigint % c as bigint) as place from range(20000) r(i), c)
select 'without' as kind, o_orderkey, cast(1 as bigint) as times from w union all
select 'with', o_orderkey, count(*) from d join o using (place) group by o_orderkey""",
    "sliced_rows": "select o_orderkey, o_totalprice from orders order by o_orderkey limit 37 offset 100",
    "prompt_text": "select * from (values " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(_PROMPT) if x != "row") + ") t(place, line)",
    "generated_records": """with k(type, r, s, rn, sn) as (values ('single-table', 'nations', null, 'Nations', null), ('multi-table-join', 'nations', 'customers', 'Nations', 'Customers'), ('single-table', 'suppliers', null, null, null), ('multi-table-union', 'suppliers', 'buyers', null, null))
select type, level as difficulty, true as success, r as r_rsc_id, s as s_rsc_id, rn as r_rsc_name, sn as s_rsc_name, 1 as nl_n_rev, 'approve' as nl_review, 2 as nl_intok, 4 as nl_outok, 0 as sql_n_rev from k, (values ('simple'), ('moderate'), ('challenging')) l(level)""",
    "leaky_questions": """select c as "case", t as type, c in (0, 3) as success, case when c in (0, 3) then 0 else 1 end as revisions from (values (0), (1), (2), (3)) a(c), (values ('single-table'), ('multi-table-join')) b(t)""",
    "evaluated_pairs": f"with {_SCORED}, d as (select distinct r_rsc_id, s_rsc_id, r_col_id, s_col_id from p order by 1, 2, 3, 4 limit 50) select *, cast(length(r_rsc_id || s_rsc_id) as integer) as score from d",
}
