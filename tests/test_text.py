import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablesift.functions.text import clean, clean_name, clean_names, error_class, is_num, resource_id, strip_tags

CASES = [
    ("2024-01-01", "2024_01_01", True), ("-5", "_5", False), ("1 234", "1_234", True), ("50%", "50%", True), ("1e5", "1e5", True), ("nan", "nan", True), ("inf", "inf", True),
    ("", "", False), ("HTMLParser id", "html_parser_id", False), ("Été (fr)", "ete__fr_", False), ("Customer#000000001", "customer#000000001", False), ("straße", "strae", False),
    ("1,234.5", "1,234.5", True), ("2024-01-01 00:00:00", "2024_01_01_00:00:00", False), ("\tx ", "x_", False), ("ﬁn", "fin", False), ("①", "1", True), ("Ｆｕｌｌ", "full", False),
]


def numeric(s):
    try:
        float(s.replace(",", "").replace(".", "").replace("%", " "))
    except ValueError:
        return False
    return True


def run(spark, values, *columns):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [tuple(r)[1:] for r in rows.select("i", *columns).orderBy("i").collect()]


def test_fixed_cases(spark):
    got = run(spark, [c[0] for c in CASES], clean(F.col("v")), is_num(clean(F.col("v"))))
    assert got == [(c, n) for _, c, n in CASES]
    assert [clean_name(c[0]) for c in CASES] == [c[1] for c in CASES]


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.characters(blacklist_categories=("Cs",), max_codepoint=0x24FF)), min_size=1, max_size=60))
def test_columns_agree_with_the_driver_twins(spark, values):
    values = [v for v in values if "\0" not in v and v.lower() == v.lower().replace("ς", "σ") and "İ" not in v]
    got = run(spark, values, clean(F.col("v")), clean(F.col("v"), "base"))
    assert [g[0] for g in got] == [clean_name(v) for v in values]


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text("0123456789_,.%+-eE infatyINFNA\t"), min_size=1, max_size=80))
def test_is_num_agrees_with_the_definition(spark, values):
    assert [g[0] for g in run(spark, values, is_num(F.col("v")))] == [numeric(v) for v in values]


def test_modes_and_nulls(spark):
    assert run(spark, [None, "Ab"], clean(F.col("v"), None), clean(F.col("v"), "base"), clean(F.col("v"))) == [(None, None, None), ("Ab", "ab", "ab")]
    with pytest.raises(ValueError):
        clean(F.col("v"), "other")
    assert clean_names(["A b", "a_b", "a_b_1"]) == ["a_b", "a_b_1", "a_b_1_1"]


def test_small_functions(spark):
    assert run(spark, ["<p class='x'>a\nb</p>", None, "x" * 50], strip_tags(F.col("v"), 10)) == [(" a b ",), ("",), ("x" * 10,)]
    assert run(spark, ["abc_2.parquet", "abc.parquet", "a_b.parquet"], resource_id(F.col("v"))) == [("abc",), ("abc",), ("a_b",)]
    assert run(spark, ["Parser Error: x", "no table, sorry!"], error_class(F.col("v"))) == [("Parser Error",), ("no table, sorry",)]
