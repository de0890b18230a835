import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablesift.config import Search
from tablesift.functions.scoring import leaks, parse_review, parse_score, succeeded
from tablesift.operators import lake, metadata, order, profile, search, sets, sqlgen, stats


def columns(spark, sets_by_table):
    rows = [(t, 0, v) for t, values in sets_by_table.items() for v in values]
    return spark.createDataFrame(rows, "table_id int, column_id int, value string")


def some_sets(seed, n=40):
    r = random.Random(seed)
    base = [f"v{i}" for i in range(60)]
    out = {i: set(r.sample(base, r.choice([1, 5, 12, 30]))) for i in range(n)}
    for i in range(n, n + 15):
        out[i] = set(out[i - n]) - set(r.sample(base, 5)) | {f"u{i}"}
    return out


def test_overlaps_and_top_k_against_brute_force(spark):
    data = some_sets(1)
    found = search.overlaps(columns(spark, data))
    pairs = {(r.r_table_id, r.s_table_id): r.k for r in found.collect()}
    assert pairs == {(a, b): len(data[a] & data[b]) for a, b in itertools.combinations(sorted(data), 2) if data[a] & data[b]}
    top = {(r.r_table_id, r["rank"]): r.s_table_id for r in search.top_k(found, 3).collect()}
    for a in data:
        best = sorted((b for b in data if b != a and data[a] & data[b]), key=lambda b: (-len(data[a] & data[b]), b))[:3]
        assert [top[a, i + 1] for i in range(len(best))] == best


@pytest.mark.parametrize("t", [0.2, 0.5, 0.8, 1.0])
def test_prefix_filter_is_exact(spark, t):
    data = some_sets(2)
    got = {(r.r_table_id, r.s_table_id) for r in search.similar_columns(columns(spark, data), t).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(sorted(data), 2) if data[a] & data[b] and round(len(data[a] & data[b]) / len(data[a] | data[b]) + 1e-9, 3) >= t}


def test_candidates_filters(spark):
    data = {i: {f"v{j}" for j in range(i, i + 20)} for i in range(6)}
    info = spark.createDataFrame([(i, 0, "name" if i != 1 else "record_id", 100 if i != 2 else 5, 0.0 if i != 3 else 0.2) for i in data], "table_id int, column_id int, column_name string, n_rows int, null_ratio double")
    packages = spark.createDataFrame([(0, "p"), (1, "q"), (2, "q"), (3, "r"), (4, "p"), (5, "s")], "table_id int, package_id string")
    got = search.candidates(columns(spark, data), info, Search(budget=None, k=50, min_jaccard=0.1, min_overlap=0.1), packages)
    # 1 is no probe (bad header) but can be found; 2 is too low, 3 has too many nulls; 0 and 4 share a package
    assert {(r.r_table_id, r.s_table_id) for r in got.collect()} == {(0, 1), (0, 5), (4, 1), (4, 5), (5, 1)}
    one = got.where("r_table_id = 0 and s_table_id = 1").first()
    assert (one.size_intersection, one.size_union, one.jaccard, one.overlap) == (19, 21, 0.905, 0.95)


def test_lake_cells_ids_and_dictionary(spark):
    a = spark.createDataFrame([(1, "Ab c", "5"), (2, None, "x-y")], "k int, Name string, v string")
    b = spark.createDataFrame([("z",)], "w string")
    tables = lake.Lake(spark, {"a.parquet": a, "b.parquet": b})
    assert tables.ids == {"b.parquet": 0, "a.parquet": 1}
    cells = tables.cells(order={"a.parquet": ["k"]})
    assert sorted(map(tuple, cells.collect()), key=str) == [(0, 0, None, "z"), (1, 1, 0, "ab_c"), (1, 2, 1, "x_y")]
    assert sorted(map(tuple, lake.decode(lake.encode(cells), lake.dictionary(cells)).select(cells.columns).collect()), key=str) == sorted(map(tuple, cells.collect()), key=str)
    assert tables.dimension().count() == 2


def test_type_ladder_and_loading(spark):
    rows = [("true", "1", "1.5", "x", None, "1,5", "yes"), ("false", "2", "2", "y", None, "2", "no"), ("true", "-3", None, "z", None, "3", "yes")]
    df = spark.createDataFrame(rows, "b string, i string, f string, s string, n string, comma string, yn string")
    assert profile.infer_types(df) == {"b": "boolean", "i": "int", "f": "float", "s": "string", "n": "void", "comma": "string", "yn": "boolean"}
    loaded = profile.load_table(df.withColumnRenamed("s", "Some Name"), "complex")
    assert dict(loaded.dtypes)["some_name"] == "string" and "n" not in loaded.columns and loaded.agg(F.sum("i")).first()[0] == 0
    two = spark.createDataFrame([("1",), ("2",)], "x string")
    assert profile.infer_types(two)["x"] == "int"


def test_null_profile_and_columns(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, "a"), (3, None, None), (4, None, "b")], "x int, y string, z string")
    got = {r.column_name: (r.n_rows, r.n_nulls, r.n_distinct, r.null_ratio) for r in profile.null_profile(df).collect()}
    assert got == {"x": (4, 0, 4, 0.0), "y": (4, 4, 0, 1.0), "z": (4, 1, 2, 0.25)}
    assert profile.drop_null_columns(df).columns == ["x", "z"] and profile.pin_column(df, "z", 2).columns == ["z", "x"]
    assert profile.create_table_sql(df, "R") == "CREATE TABLE R (\n    x BIGINT,\n    y VARCHAR(255),\n    z VARCHAR(255)\n);"
    assert profile.preview(df, 2).count("\n") == 3


def test_scores_and_checks(spark):
    replies = ["Answer: 7", "answer: 11", "Answer:7", "none", "ANSWER: 0", "answer: 99999999999999999999"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, r string")
    assert [r[0] for r in df.orderBy("i").select(parse_score(F.col("r"))).collect()] == [7, -1, -1, -1, 0, -1]
    votes = spark.createDataFrame([(1, 3), (1, 5), (1, -1), (2, 4), (2, 4), (2, 1)], "k int, score int")
    assert {r.k: r.score for r in stats.majority(votes, ["k"]).collect()} == {1: -1, 2: 4}
    names = F.array(F.lit("user_id"), F.lit("city"))
    cases = {"show the 'city'": True, "by user_id please": True, "which city is it": False, 'the "USER_ID"': True}
    qs = spark.createDataFrame([(q,) for q in cases], "q string")
    assert {r.q: r.x for r in qs.select("q", leaks(F.col("q"), names).alias("x")).collect()} == cases
    got = spark.createDataFrame([("ERROR x", "ok"), ("ok", "FAILURE: y"), ("an ERROR", "ok")], "a string, b string").select(succeeded(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [False, False, True]
    reviews = spark.createDataFrame([('{"approval": " APPROVE "}',), ('{"approval": "reject"}',), ("junk",), (None,)], "r string").select(parse_review(F.col("r"))["approved"]).collect()
    assert [r[0] for r in reviews] == [True, False, False, False]


def test_stats_small(spark):
    rows = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(10)], "i int, s int")
    assert [(r.n_rows, r.rate) for r in stats.running_rate(rows, ["i"], "s", 4).orderBy("n_rows").collect()] == [(4, 0.5), (8, 0.375), (10, 0.4)]
    scores = spark.createDataFrame([(x,) for x in (-1, 0, 3, 3, 7, 12)], "x int")
    got = {r.threshold: (r.n, r.ratio) for r in stats.threshold_counts(scores, "x", 0, 10).collect()}
    assert got == {t: (n := sum(x >= t for x in (-1, 0, 3, 3, 7, 12)), round(n / 6, 6)) for t in range(11)}
    t, p = stats.t_test(0.43, 1.45, 100)
    assert abs(t - 2.96552) < 1e-4 and abs(p - 0.00378) < 1e-4


def test_row_numbers(spark):
    values = [random.Random(3).randrange(50) for _ in range(500)] + [None, None]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v int, i int")
    got = {r.i: r.n for r in order.row_numbers(df, ["v", "i"], "n", 8).collect()}
    want = sorted(range(len(values)), key=lambda i: (values[i] is not None, values[i] or 0, i))
    assert got == {i: n for n, i in enumerate(want)}
    assert order.row_numbers(df.limit(0), ["v"], "n").count() == 0 and order.row_numbers(df.select(F.col("i").cast("string").alias("s")), ["s"], "n").agg(F.max("n")).first()[0] == 501


def test_sets(spark):
    a = spark.createDataFrame([(1, "x", 5.0), (2, "y", 6.0), (2, "y", 6.0)], "k int, name string, v double")
    b = spark.createDataFrame([("y", 6.0, 2), ("q", 1.0, 9)], "name string, v double, k int")
    assert sets.same_schema(a, b) and not sets.same_schema(a, b.drop("v")) and sets.common_attributes(a, b) == ["k", "name", "v"]
    assert sets.union_common(a, b, True).count() == 3
    assert [tuple(r) for r in sets.row_intersection(a, b.select("k", "name", "v")).collect()] == [(2, "y", 6.0)]
    assert sets.first_of(a, ["name"], [F.desc("v")]).count() == 2
    assert sorted(r.k for r in sets.shuffled(a, ["k"], 1).collect()) == [1, 2, 2] and sets.drawn(a, ["k"], 2, 1).count() == 2


def test_metadata(spark):
    rows = ['{"id":"p1","notes":"<b>n</b>","keywords":["k"],"organization":{"name":"o"},"resources":[{"id":"r1","format":"CSV","name":"one","language":["en"]},{"id":"r2","format":"PDF"},{"id":"r3","format":"CSV","language":["fr"]}]}', '{"id":"p2","keywords":{"en":["e"]},"tags":["t"],"resources":[{"id":"r1","format":"CSV","name":"again"}]}']
    packages = spark.createDataFrame([(r,) for r in rows], "j string").select(F.from_json("j", metadata.PACKAGE).alias("p")).select("p.*")
    got = {r.resource_id: r for r in metadata.attributes(packages).collect()}
    assert got["r1"].package_id == "p2" and got["r1"].keywords == ["e"] and got["r1"].tags == ["t"] and got["r1"].organization_name is None and got["r1"].notes == ""
    assert set(got) == {"r1", "r3"} and {r.resource.id for r in metadata.resources(packages).collect()} == {"r1"}


def test_verify_sql_and_the_loop(spark):
    t = {"R": spark.createDataFrame([(1, "a"), (2, "b")], "k int, name string"), "S": spark.createDataFrame([(1, 9)], "k int, n int")}
    assert sqlgen.verify_sql('SELECT "name" FROM R JOIN S ON R.k = S.k', t).status == "success"
    assert sqlgen.verify_sql("SELECT * FROM R WHERE k > 5", t).error_description == "Empty result set"
    assert all(sqlgen.verify_sql(q, t).status == "error" for q in ("SELEC", "SELECT x FROM R", "INSERT INTO R VALUES (1)", "SELECT 1; DROP TABLE R"))
    assert sqlgen.verify_sql("SELECT * FROM R", t).result == "{'k': 1, 'name': 'a'}"
    assert sqlgen.verify_sql("SELECT 'it''s \"quoted\"; fine' AS q FROM R", t).status == "success"
    answers = iter(["SELEC", "SELECT k FROM R WHERE k > 9", "SELECT k FROM R"])
    seen = []
    out = sqlgen.generate(lambda review: (seen.append(review), (next(answers), 10, 5))[1], lambda sql, verdict: (True, "approve"), t)
    assert out.success and out.revisions == 2 and (out.tokens_in, out.tokens_out) == (30, 15) and seen[0] is None and seen[2] == "Empty result set"
    out = sqlgen.generate(lambda review: ("SELEC", 1, 1), lambda *_: (True, ""), t, 1)
    assert not out.success and out.sql.startswith("FAILURE: ") and out.tokens_in == 2


def test_row_numbers_by_text_and_within_groups(spark):
    import random

    from tablesift.operators.order import row_numbers

    r = random.Random(1)
    rows = [(r.choice(["a", "b", None]), r.choice([None, "x", *(f"k{i:03}" for i in range(300))]), i) for i in range(700)]
    df = spark.createDataFrame(rows, "g string, k string, i int")
    got = sorted((x.n, x.k, x.i) for x in row_numbers(df, ["k", "i"], "n", 8).collect())
    want = sorted(((k, i) for _, k, i in rows), key=lambda x: (x[0] is not None, x[0] or "", x[1]))
    assert got == [(n, *x) for n, x in enumerate(want)]
    within = {}
    for g, k, i in sorted(rows, key=lambda x: (x[1] is not None, x[1] or "", x[2])):
        within[i] = sum(x == g for x in (y[0] for y in sorted(rows, key=lambda x: (x[1] is not None, x[1] or "", x[2]))[: sorted(rows, key=lambda x: (x[1] is not None, x[1] or "", x[2])).index((g, k, i))]))
    assert {x.i: x.n for x in row_numbers(df, ["k", "i"], "n", 8, by=["g"]).collect()} == within


def test_one_value_in_all_columns_is_split(spark, monkeypatch):
    from tablesift.operators import search

    monkeypatch.setattr(search, "BLOCK", 7)
    columns = spark.range(60).selectExpr("id as table_id", "0 as column_id", "explode(array('hot', concat('own', id), concat('pair', id div 2))) as value")
    got = {(x.r_table_id, x.s_table_id): x.k for x in search.overlaps(columns).collect()}
    assert got == {(a, b): 2 if a // 2 == b // 2 else 1 for a in range(60) for b in range(a + 1, 60)}
    probes = spark.createDataFrame([(5, 0)], "table_id long, column_id int")
    for hot in (10, 1000):  # the value that all have dealt into parts, and not
        some = {(x.r_table_id, x.s_table_id): x.k for x in search.probe_overlaps(columns, probes, hot).collect()}
        assert some == {(5, a if b == 5 else b): v for (a, b), v in got.items() if 5 in (a, b)}
    near = {(x.r_table_id, x.s_table_id) for x in search.similar_columns(columns, 0.5).collect()}
    assert near == {(2 * a, 2 * a + 1) for a in range(30)}
