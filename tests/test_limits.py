"""Time and size limits of generated SQL."""

import time

from tablesift.config import Limits
from tablesift.operators import sqlgen
from tablesift.operators.sqlgen import TIMED_OUT, largest_product, verify_all, verify_sql


def tables(spark):
    return {"R": spark.range(20_000).selectExpr("id as k", "id % 3 as g"), "S": spark.range(3000).selectExpr("id as k", "id % 5 as h")}


ENDLESS = "SELECT count(*) FROM R a, R b, R c WHERE hash(a.k, b.k, c.k) % 7 = 0"


def running(spark):
    return spark.sparkContext.statusTracker().getActiveJobsIds()


def test_a_product_is_cancelled_and_leaves_no_job(spark):
    began = time.monotonic()
    verdict = verify_sql(ENDLESS, tables(spark), Limits(seconds=3, pairs=1e30))
    assert (verdict.status, verdict.error_description) == ("error", TIMED_OUT) and time.monotonic() - began < 20
    assert not running(spark)
    assert verify_sql("SELECT max(k) AS k FROM R", tables(spark), Limits(seconds=30)).result == "{'k': 19999}"


def test_others_finish_beside_it(spark):
    good = ["SELECT count(*) AS n FROM R JOIN S ON R.k = S.k", "SELECT count(*) AS n FROM S WHERE h = 1", "SELECT count(*) AS n FROM R WHERE k > (SELECT avg(k) FROM S)"]
    out = verify_all([(ENDLESS, tables(spark)), *[(q, tables(spark)) for q in good]], Limits(seconds=15, pairs=1e30, at_once=4))
    assert [v.error_description for v in out] == [TIMED_OUT, "", "", ""] and [v.result for v in out[1:]] == ["{'n': 3000}", "{'n': 600}", "{'n': 18500}"]
    assert not running(spark) and verify_all([]) == []


def test_large_products_are_refused_before_they_run(spark):
    t = tables(spark)
    verdict = verify_sql(ENDLESS, t)
    assert verdict.status == "error" and "product" in verdict.error_description
    assert verify_sql("SELECT count(*) FROM S a, S b WHERE a.k < b.k", t, Limits(pairs=1e8)).status == "success"
    assert verify_sql("SELECT count(*) FROM S a, S b WHERE a.k < b.k", t, Limits(pairs=1e6)).status == "error"
    assert verify_sql("SELECT * FROM R WHERE EXISTS (SELECT 1 FROM S WHERE S.k > R.k)", t, Limits(pairs=1e6)).status == "error"
    assert verify_sql("SELECT * FROM R, (SELECT max(h) AS m FROM S) x WHERE R.g < x.m", t, Limits(pairs=1e6)).status == "success"  # one row on a side


def test_the_size_of_a_product_is_multiplied_out(spark):
    for name, df in tables(spark).items():
        df.createOrReplaceTempView(f"limits_{name}")
    sizes = {sql: largest_product(spark.sql(sql)) for sql in ("SELECT 1 FROM limits_R a JOIN limits_R b ON a.k = b.k", "SELECT 1 FROM limits_R a, limits_S b", "SELECT 1 FROM limits_R a, limits_S b, limits_S c", "SELECT (SELECT count(*) FROM limits_R a, limits_S b) AS n")}
    assert list(sizes.values()) == [0, 6e7, 1.8e11, 6e7]


def test_the_loop_passes_limits_on(spark):
    out = sqlgen.generate(lambda review: (ENDLESS if review is None else "SELECT 1 AS x FROM S", 1, 1), lambda *_: (True, "fine"), tables(spark), 2, Limits(pairs=1e6))
    assert out.success and out.revisions == 1 and out.sql == "SELECT 1 AS x FROM S"
