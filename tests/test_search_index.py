"""Search on the persisted index, and top-k with early stop."""

import random
import re

from pyspark.sql import functions as F

from tablesift.config import Search
from tablesift.operators import search, workflow
from tablesift.operators.lake import Lake
from tablesift.sources import files

CELLS = "table_id int, column_id int, row_id long, value string"


def cells(spark, seed=1, n=60):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for t in range(n):
        for c in range(2):
            lot = r.sample(words, r.choice([3, 20, 60])) + [x for x in ("everywhere", "often") if r.random() < 0.9]
            rows += [(t, c, i, v) for i, v in enumerate(lot + lot[:2])]
    return spark.createDataFrame(rows, CELLS)


def profile(spark, n=60):
    return spark.createDataFrame([(t, c, "name" if c == 0 else "record_id", 100, 0.0) for t in range(n) for c in range(2)], "table_id int, column_id int, column_name string, n_rows int, null_ratio double")


def shown(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()))


def test_candidates_from_the_index_are_the_same(spark, tmp_path):
    rows = cells(spark)
    files.write_index(rows, "search_index_test", 8, f"{tmp_path}/index")
    settings = Search(budget=20, k=6, min_distinct=5, min_jaccard=0.01, min_overlap=0.01)
    want = search.candidates(rows, profile(spark), settings)
    got = search.candidates(spark.table("search_index_test"), profile(spark), settings, indexed=True)
    assert shown(got) == shown(want) and want.count() > 20
    spark.sql("drop table search_index_test")


def test_the_index_is_not_shuffled(spark, tmp_path, monkeypatch):
    files.write_index(cells(spark), "search_plan_test", 8, f"{tmp_path}/index")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if both sides were large
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        probes = profile(spark).where("table_id < 10 and column_id = 0")
        met = search.probe_overlaps(search.columns_of(spark.table("search_plan_test")), probes)
        plan = met._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan) and all("value" not in x for x in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)), plan
    assert "SortMergeJoin" in plan and plan.count("Bucketed: true") == 2, plan
    assert met.count() > 0
    spark.sql("drop table search_plan_test")


def test_an_index_that_grows_by_batches(spark, tmp_path):
    tables = {f"t{i}.parquet": spark.createDataFrame([(f"City {j}", f"k{j % 3}") for j in range(i, i + 40)], "cityName string, kind string") for i in range(5)}
    lake = Lake(spark, tables)
    settings = Search(min_distinct=3, budget=None, min_jaccard=0.1, min_overlap=0.1)
    want = shown(workflow.find_candidates(lake, settings=settings))
    for _ in range(2):  # written twice, in batches of two tables: the same index
        index = workflow.index_lake(lake, f"{tmp_path}/lake", batch=2)
        assert index[0].count() == 5 * 80
    assert shown(workflow.find_candidates(lake, settings=settings, index=index)) == want and len(want) >= 10


def test_top_k_with_early_stop_is_exact_and_reads_less(spark):
    r = random.Random(7)
    common, rows = [f"c{i}" for i in range(20)], []
    for t in range(300):
        group = t // 6
        lot = {f"g{group}_{i}" for i in range(r.choice([45, 60, 80]))} | {f"own{t}_{i}" for i in range(5)} | {c for c in common if r.random() < 0.8}
        rows += [(t, 0, v) for v in lot]
    columns = spark.createDataFrame(rows, "table_id int, column_id int, value string")
    probes = columns.select("table_id", "column_id").distinct().where("table_id % 3 = 0")
    for k, growth, first in ((3, 4, 100), (1, 2, 1), (10, 4, 1 << 20), (500, 4, 64)):
        want = search.best(search.probe_overlaps(columns, probes), k)
        got, spent = search.top_k_early(columns, probes, k, first, growth)
        assert shown(got.select(want.columns)) == shown(want), k
        if k <= 3 and first <= 100:
            assert spent["pairs"] + spent["looked_up"] < spent["all_pairs"] / 4, spent


def test_early_stop_without_probes_or_values(spark):
    none = spark.createDataFrame([], "table_id int, column_id int, value string")
    got, spent = search.top_k_early(none, none.select("table_id", "column_id"), 3)
    assert got.count() == 0 and spent["all_pairs"] == 0
    alone = spark.createDataFrame([(1, 0, "a"), (2, 0, "b")], "table_id int, column_id int, value string")
    assert search.top_k_early(alone, alone.select("table_id", "column_id"), 3)[0].count() == 0
