from pyspark.sql import functions as F

from tablesift.config import Evaluation, Generation, Search
from tablesift.operators import prompts, workflow
from tablesift.operators.lake import Lake


def tables(spark):
    city = [f"City {i}" for i in range(40)]
    a = spark.createDataFrame([(c, f"c{i % 4}", i) for i, c in enumerate(city)], "cityName string, kind string, people int")
    b = spark.createDataFrame([(c, i * 1.5) for i, c in enumerate(city[5:])], "place string, rent double")
    c = spark.createDataFrame([(c, f"c{i % 4}", i) for i, c in enumerate(city[10:])], "cityName string, kind string, people int")
    return {"aa.parquet": a, "bb.parquet": b, "cc.parquet": c}


def test_stages(spark):
    lake = Lake(spark, tables(spark))
    attributes = spark.createDataFrame([("aa", "p1"), ("bb", "p2"), ("cc", "p3")], "resource_id string, package_id string")
    found = workflow.find_candidates(lake, attributes, settings=Search(min_distinct=3, budget=None))
    found = spark.createDataFrame(found.collect(), found.schema)
    got = {(r.r_rsc_id, r.s_rsc_id, r.r_col_name, r.s_col_name): (r.size_intersection, r.jaccard) for r in found.collect()}
    assert got[("cc", "aa", "cityName", "cityName")] == (30, 0.75) and ("bb", "aa", "place", "cityName") in got or ("aa", "bb", "cityName", "place") in got
    scored = workflow.evaluate(found, F.concat("r_rsc_id", "s_rsc_id"), lambda prompt, *_: "answer: 9" if "bb" not in prompt else "Answer: 8", Evaluation())
    scored = spark.createDataFrame(scored.collect(), scored.schema)
    pairs = workflow.chosen_pairs(scored, Generation(min_score=8))
    pairs = spark.createDataFrame(pairs.collect(), pairs.schema)
    assert pairs.count() == 3 and workflow.chosen_pairs(scored, Generation(min_score=9)).count() == 1
    plain = {n.removesuffix(".parquet"): t for n, t in lake.tables.items()}
    rows = list(workflow.generate_records(pairs, plain))
    records = spark.createDataFrame(rows, workflow.RECORD)
    kinds = {(r.type, r.difficulty) for r in records.where("success").select("type", "difficulty").collect()}
    assert {k for k, _ in kinds} == {"single-table", "multi-table-join", "multi-table-union"} and len(kinds) == 9
    leaky = list(workflow.generate_records(pairs.limit(1), plain, Generation(max_reviews=1), ask=lambda sql, review: ("tell me the city_name", 3, 2)))
    assert not any(r[3] for r in leaky) and all(r[13].startswith("FAILURE") and r[22 + 1] == 6 for r in leaky)


def test_context(spark):
    context = prompts.table_context(tables(spark)["aa.parquet"], "R", "people", {"resource_name": "cities", "notes": None, "tags": ["x", "y"]})
    assert context.columns == ("people", "city_name", "kind") and "CREATE TABLE R" in context.text() and "x, y" in context.text() and "notes" not in context.text()
    assert prompts.leaks("use city_name", context.columns) and not prompts.leaks("which kind", context.columns) and prompts.leaks("the 'kind'", context.columns)
    assert "Answer: <number>" in prompts.scoring_prompt(context, context, 0, 10)


def test_a_table_is_cleaned_once_for_all_its_queries(spark, monkeypatch):
    from tablesift.config import Generation
    from tablesift.operators import profile, workflow

    made, load = [], profile.load_table
    monkeypatch.setattr(workflow.profile, "load_table", lambda df, *x: made.append(1) or load(df, *x))
    tables = {n: spark.createDataFrame([(i, f"{n} {i % 3}") for i in range(9)], f"k int, {n} string") for n in ("a", "b", "c")}
    pairs = spark.createDataFrame([("a", s, "k", "k", None, None) for s in ("b", "c")], "r_rsc_id string, s_rsc_id string, r_col_name string, s_col_name string, r_rsc_name string, s_rsc_name string")
    loaded = {}
    settings = Generation(levels=("simple",), max_reviews=1)
    first = [x[1:6] for x in workflow.generate_records(pairs, tables, settings, loaded=loaded)]
    again = [x[1:6] for x in workflow.generate_records(pairs, tables, settings, loaded=loaded)]
    assert len(made) == 3 and first == again and len(first) == 3 and all(x[2] for x in first)
    assert all("clean" not in x and x.count("Scan") + x.count("Relation") >= 1 for x in (t._jdf.queryExecution().optimizedPlan().toString() for t in loaded.values()))
