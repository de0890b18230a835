"""Profiles of whole lakes, and quantiles by selection."""

import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tablesift.operators import profile, stats
from tablesift.sources import files

VALUES = {"b": ["true", "no", None], "b1": ["yes"], "i": ["1", "-20", None, "300"], "f": ["1.5", "2", "1e3"], "comma": ["1,5", "2"], "s": ["x", "", "5"], "n": [None], "bits": ["0", "1"], "two": ["1", "2"], "big": ["99999999999"]}


def write_lake(folder, n, seed=3):
    r = random.Random(seed)
    for t in range(n):
        names = r.sample(sorted(VALUES), r.randrange(1, 6))
        rows = r.choice([1, 5, 30])
        pq.write_table(pa.table({c: pa.array([r.choice(VALUES[c]) for _ in range(rows)], pa.string()) for c in names}), f"{folder}/t{t:04}.parquet")


def test_thousands_of_tables_in_a_fixed_number_of_jobs(spark, tmp_path):
    write_lake(tmp_path, 2000)
    context = spark.sparkContext
    context.setJobGroup("lake", "profile of a lake")
    found = profile.profile_cells(files.table_cells(spark, str(tmp_path))).collect()
    jobs = len(context.statusTracker().getJobIdsForGroup("lake"))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 6 and len({r.table_name for r in found}) == 2000
    kinds = {(r.table_name, r.column_name): r for r in found}
    for t in range(0, 2000, 250):
        name = f"t{t:04}.parquet"
        df = spark.read.parquet(f"{tmp_path}/{name}")
        assert profile.infer_types(df) == {c: kinds[name, c].kind for c in df.columns}
        for r in profile.null_profile(df).collect():
            own = kinds[name, r.column_name]
            assert (own.column_id, own.n_rows, own.n_nulls, own.n_distinct, own.null_ratio) == (r.column_id, r.n_rows, r.n_nulls, r.n_distinct, r.null_ratio)


def test_cells_of_csv_files_and_of_what_is_no_table(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("id;naïve\n1;é\n2;\n3;x;too many\n".encode("latin-1"))
    (tmp_path / "b.csv").write_bytes(b"")
    (tmp_path / "c.parquet").write_bytes(b"not parquet")
    pq.write_table(pa.table({"k": [1, None], "x": [1.5, 2.0]}), tmp_path / "d.parquet")
    got = sorted((r.table_name, r.column_id, r.column_name, r.value) for r in files.table_cells(spark, str(tmp_path)).collect() if r.value is not None)
    assert got == [("a.csv", 0, "id", "1"), ("a.csv", 0, "id", "2"), ("a.csv", 1, "naïve", "é"), ("d.parquet", 0, "k", "1"), ("d.parquet", 1, "x", "1.5"), ("d.parquet", 1, "x", "2")]


def test_quantiles_are_exact_whatever_the_scale(spark):
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(size=3000), r.lognormal(0, 30, 3000), -r.lognormal(0, 5, 500), np.repeat(1.5, 4000), [1e300, -1e308, 1e308, 5e-324, 0.0]])
    df = spark.createDataFrame(pd.DataFrame({"x": x, "i": np.arange(len(x)) % 7})).withColumn("i", F.expr("if(i = 6, null, i)"))
    points = (0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0)
    got = stats.quantiles(df, ["x", "i"], points)
    s, i = np.sort(x), np.sort([v for v in np.arange(len(x)) % 7 if v != 6])
    for values, own in ((got["x"], s), (got["i"], i)):
        for p, v in zip(points, values):
            at = p * (len(own) - 1)
            want = own[int(np.floor(at))] * (1 - at % 1) + own[int(np.ceil(at))] * (at % 1)
            assert v == pytest.approx(want, rel=1e-12, abs=0)


def test_describe_uses_no_percentile_and_takes_empty_columns(spark):
    df = spark.createDataFrame([(1, 2.0, None), (3, float("nan"), None), (None, 8.0, None)], "a int, b double, c double")
    got = {r.column_name: tuple(r)[1:] for r in stats.describe(df, ["a", "b", "c"]).collect()}
    assert got["a"] == (2, 1, 2.0, 1.414214, 1.0, 1.5, 2.0, 2.5, 3.0) and got["b"][:2] == (2, 1) and got["b"][4:] == (2.0, 3.5, 5.0, 6.5, 8.0)
    assert got["c"] == (0, 3, None, None, None, None, None, None, None)
    assert "percentile" not in open(stats.__file__).read()


def test_the_lake_is_written_by_as_many_tasks_as_read_its_tables(spark, tmp_path, monkeypatch):
    from tablesift.plans import lake_queries

    for name, key in (("region", "r_regionkey"), ("nation", "n_nationkey"), ("supplier", "s_suppkey"), ("customer", "c_custkey"), ("part", "p_partkey"), ("orders", "o_orderkey")):
        spark.range(40).selectExpr(f"id as {key}", "concat('x', id) as name").repartition(5).write.parquet(f"{tmp_path}/in/{name}.parquet")
    monkeypatch.setattr(lake_queries, "scratch", lambda _: f"{tmp_path}/lake")
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")  # a task for each file
    try:
        got = {(r.table_name, r.column_name): (r.n_rows, r.n_distinct) for r in lake_queries.lake_types(spark, f"{tmp_path}/in").collect()}
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    assert got["orders", "name"] == (40, 40) and got["orders", "nothing"] == (40, 0)
    assert len(list((tmp_path / "lake" / "orders").glob("part-*"))) == 5
