"""Generated SQL under limits, whole results of the templates, and search by the persisted index."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from ..config import Limits
from ..operators import lake, search, sqlgen, tiles
from ..sources import files
from ..sources.exchange import scratch
from .lake_queries import ORACLE as LAKE_ORACLE
from .lake_queries import candidates_of_brands, read

#: Compares rows of three slices by a hash, so nothing can be pushed down; far from done within a few seconds.
PRODUCT = (
    "SELECT count(*) AS n FROM (SELECT l_orderkey AS k FROM lineitem LIMIT 6000) a, (SELECT l_partkey AS k FROM lineitem LIMIT 6000) b,"
    " (SELECT l_suppkey AS k FROM lineitem LIMIT 6000) c WHERE hash(a.k, b.k, c.k) % 7 = 0"
)
_COUNTS = (
    "SELECT count(*) AS n FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 1000",
    "SELECT count(*) AS n FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 30)",
    "SELECT count(*) AS n FROM nation a, nation b WHERE a.n_regionkey < b.n_regionkey",
)


def bounded_verdicts(spark, sf_dir):
    """Queries verified at once: those that end do so beside a three-way product that is cancelled at its deadline and one that is refused
    for its size."""
    tables = {n: read(spark, sf_dir, n) for n in ("customer", "orders", "lineitem", "nation")}
    work = [(sql, tables) for sql in _COUNTS]
    fine = sqlgen.verify_all([*work, (PRODUCT, tables)], Limits(seconds=20, pairs=1e15, at_once=4))
    large = sqlgen.verify_all([(PRODUCT, tables)], Limits(pairs=1e9))
    shown = lambda v: "" if v.status == "success" else v.error_description if v.error_description == sqlgen.TIMED_OUT else "product" if "product" in v.error_description else "other"
    rows = [(i, v.status, shown(v), int(re.search(r"\d+", v.result)[0]) if v.result else -1) for i, v in enumerate([*fine, *large])]
    return spark.createDataFrame(rows, "case int, status string, why string, n long")


def _indexed(spark, sf_dir):
    """The brands' cells as a table bucketed by value. The catalog's entry goes at once; the files stay."""
    name = f"cells_{uuid.uuid4().hex}"
    files.write_index(lake.long_cells(read(spark, sf_dir, "part"), "p_brand", "p_name", "base"), name, 16, f"{scratch(spark)}/{name}")
    table = spark.table(name)
    spark.sql(f"drop table {name}")
    return table


def indexed_candidates(spark, sf_dir):
    """The whole search, on the persisted index."""
    return candidates_of_brands(spark, sf_dir, _indexed(spark, sf_dir), True)


def topk_early_stop(spark, sf_dir):
    """The most joinable columns of each, without the posting lists of values that can't change them."""
    columns = search.columns_of(_indexed(spark, sf_dir))
    found, _ = search.top_k_early(columns, columns.select(*search.KEYS).distinct(), 5)
    return found.select(F.col("r_table_id").alias("r_table"), F.col("s_table_id").alias("s_table"), F.col("k").alias("size_intersection"), "rank")


def topk_documents(spark, sf_dir):
    """For every document whose id is divisible by 50 the ten others with most words in common."""
    words = F.split(F.lower("text"), r"[ \t\n\r\f]+")
    found = search.top_k_sets(tiles.text_sets(read(spark, sf_dir, "documents"), F.col("doc_id"), words), F.col("table_id") % 50 == 0, 10)
    return found.select(F.col("r_table_id").alias("r_doc"), F.col("s_table_id").alias("s_doc"), F.col("k").alias("size_intersection"), "rank")


QUERIES = {f.__name__: f for f in (bounded_verdicts, indexed_candidates, topk_early_stop, topk_documents)}
ORACLE = {
    "indexed_candidates": LAKE_ORACLE["full_candidates"],
    "topk_early_stop": LAKE_ORACLE["topk_joinable_columns"],
    "topk_documents": """with c as (select distinct doc_id as t, unnest(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f]+')) as v from documents), d as (select t, v from c where v <> ''),
i as (select a.t as r, b.t as s, count(*) as k from d a join d b on a.v = b.v and a.t <> b.t where a.t % 50 = 0 group by a.t, b.t)
select r as r_doc, s as s_doc, k as size_intersection, rank from (select *, cast(row_number() over (partition by r order by k desc, s) as integer) as rank from i) where rank <= 10""",
    "bounded_verdicts": "select 0 as case, 'success' as status, '' as why, n from ({}) union all select 1, 'success', '', n from ({}) union all select 2, 'success', '', n from ({})".format(*_COUNTS).replace(" as case", ' as "case"')
    + " union all select 3, 'error', 'timed out', -1 union all select 4, 'error', 'product', -1",
}
