"""The stages one after the other: index, search, evaluate, generate. Tables of rows stay distributed; only the pairs
chosen for generation, bounded by its budget, pass through the driver, as each needs a model's answer."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Evaluation, Generation, Indexing, Search
from ..functions.text import clean_names
from ..sources import files
from ..sources.exchange import materialize
from . import debate, profile, prompts, search, sets, sqlgen
from .lake import Lake

RECORD = (
    "id int, type string, difficulty string, success boolean, r_rsc_id string, s_rsc_id string, r_pkg_id string, s_pkg_id string, r_rsc_name string, s_rsc_name string,"
    " r_col_name string, s_col_name string, sql string, nl string, sql_success boolean, sql_time double, sql_n_rev int, sql_review string, sql_intok int, sql_outok int,"
    " nl_time double, nl_n_rev int, nl_review string, nl_intok int, nl_outok int, tot_time double"
)


def lake_profile(lake: Lake) -> DataFrame:
    """What `search.candidates` needs of every column, by one aggregation over the cells of all tables."""
    cells = reduce(DataFrame.unionByName, [profile.text_cells(df, F.lit(name)) for name, df in lake.tables.items()])
    known = [(name, lake.ids[name], sorted(clean_names(df.columns))) for name, df in lake.tables.items()]
    tables = lake.spark.createDataFrame(known, "table_name string, table_id int, headers array<string>")
    return profile.profile_cells(cells).join(tables, "table_name").select("table_id", "column_id", "column_name", "n_rows", "null_ratio", "headers")


def index_lake(lake: Lake, folder: str, indexing: Indexing = Indexing(), batch: int = 100) -> tuple[DataFrame, DataFrame]:
    """(cells, profile) of a lake of any number of tables, written to folder batch by batch, so no plan holds more than a batch's tables. The
    cells are a table bucketed by value, on which `find_candidates` searches. A batch that is run again replaces its own files."""
    names, ids = sorted(lake.tables), lake.ids
    table = "cells_" + hashlib.sha1(folder.encode()).hexdigest()[:16]
    files.index_table(lake.spark, table, f"{folder}/cells", indexing.buckets)
    for i in range(0, len(names), batch):
        part = Lake(lake.spark, {n: lake.tables[n] for n in names[i : i + batch]}, ids)
        files.write_batch(part.cells(indexing.cleaning.elements), table, i // batch, indexing.buckets)
        lake_profile(part).write.mode("overwrite").parquet(f"{folder}/profile/batch={i // batch}")
    return lake.spark.table(table).drop("batch"), lake.spark.read.parquet(f"{folder}/profile").drop("batch")


def usable(pairs: DataFrame) -> DataFrame:
    """Pairs without members of zips of several tables: their ids have a number behind an underscore."""
    return pairs.where(~F.contains("r_rsc_id", F.lit("_")) & ~F.contains("s_rsc_id", F.lit("_")))


def find_candidates(lake: Lake, attributes: DataFrame | None = None, indexing: Indexing = Indexing(), settings: Search = Search(), index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """index: what `index_lake` gives; without it cells and profiles are worked out in one plan. attributes: resource_id, package_id, and resource_name if known. Candidate pairs in the columns that the stages exchange, and the resources' names."""
    packages = None
    if attributes is not None:
        packages = lake.dimension().join(attributes.select("resource_id", "package_id"), "resource_id").select("table_id", "package_id")
    cells, profiled = index or (lake.cells(indexing.cleaning.elements), lake_profile(lake))
    found = search.candidates(cells, profiled, settings, packages, indexed=index is not None)
    names = lake.dimension().select("table_id", "resource_id")
    called = attributes is not None and "resource_name" in attributes.columns
    names = names.join(attributes.select("resource_id", "resource_name"), "resource_id", "left") if called else names.withColumn("resource_name", F.lit(None).cast("string"))
    for side in "rs":
        found = found.join(names.select(F.col("table_id").alias(f"{side}_table_id"), F.col("resource_id").alias(f"{side}_rsc_id"), F.col("resource_name").alias(f"{side}_rsc_name")), f"{side}_table_id")
    package = lambda side: F.col(f"{side}_package_id") if packages is not None else F.lit(None).cast("string")
    return found.select(
        "r_rsc_id", "s_rsc_id", F.col("r_column_id").alias("r_col_id"), F.col("s_column_id").alias("s_col_id"), F.col("r_column_name").alias("r_col_name"), F.col("s_column_name").alias("s_col_name"),
        "size_r_col", "size_s_col", package("r").alias("r_pkg_id"), package("s").alias("s_pkg_id"), "size_intersection", "size_union", "jaccard", "overlap", "r_rsc_name", "s_rsc_name",
    )


def evaluate(candidates: DataFrame, prompt: F.Column, model: debate.Model | None = None, settings: Evaluation = Evaluation(), ask: debate.Ask | None = None) -> DataFrame:
    """Candidates (the first of the budget) with the debate's score. prompt is a column over them. The model is a function called within
    tasks, or asked round by round through `ask`."""
    keys = ["r_rsc_id", "s_rsc_id", "r_col_id", "s_col_id"]
    chosen = candidates.orderBy(*keys).limit(settings.budget).withColumn("pair_id", F.xxhash64(*keys))
    asked = chosen.select("pair_id", prompt.alias("prompt"))
    scores = debate.debate_scores(debate.replies_by_rounds(asked, ask, settings) if ask else debate.replies(asked, model, settings), settings)
    return chosen.join(scores, "pair_id").drop("pair_id")


def chosen_pairs(evaluated: DataFrame, settings: Generation = Generation(), seed: int = 42) -> DataFrame:
    """One pair of columns for each pair of tables, of at least the least score, in a seeded order, within the budget."""
    tables = ["r_rsc_id", "s_rsc_id"]
    one = sets.first_of(evaluated.where(F.col("score") >= settings.min_score), tables, [F.desc("score"), "r_col_id", "s_col_id"])
    return sets.shuffled(one, tables, seed).limit(settings.budget)


Asker = Callable[[str, str | None], tuple[str, int, int]]
#: (question, SQL) to (approved, review, tokens in, tokens out)
Judge = Callable[[str, str], tuple[bool, str, int, int]]


def question(sql: str, columns: tuple[str, ...], names: tuple[str, ...], ask: Asker | None, judge: Judge, reviews: int) -> tuple[str, int, str, int, int]:
    """(question, revisions, review, tokens in, tokens out) for a query: asked for, reviewed and revised at most so often. One that gives
    column or table names away is sent back before the reviewer sees it; what still isn't approved at the end reads `FAILURE: ...`."""
    tokens, review, nl, n = [0, 0], None, "", 0
    for n in range(reviews + 1):
        nl, more_in, more_out = ask(sql, review) if ask else (prompts.question_of(sql, columns), 0, 0)
        tokens = [tokens[0] + more_in, tokens[1] + more_out]
        if prompts.leaks(nl, columns, names):
            approved, review = False, "The question names the schema."
        else:
            approved, review, more_in, more_out = judge(nl, sql)
            tokens = [tokens[0] + more_in, tokens[1] + more_out]
        if approved:
            return nl, n, review, *tokens
    return f"FAILURE: {nl}", n, review or "", *tokens


def generate_records(pairs: DataFrame, tables: dict[str, DataFrame], settings: Generation = Generation(), ask: Asker | None = None, reviewer: sqlgen.Reviewer = lambda sql, verdict: (True, "approve"), judge: Judge = lambda nl, sql: (True, "approve", 0, 0), loaded: dict[str, DataFrame] | None = None) -> Iterator[tuple]:
    """Rows of RECORD: for each pair and level a query on the first table (each table once), and one on both. SQL comes from the
    templates, the question from ask(sql, review), or from the SQL itself, and is reviewed by judge; one that gives the schema away fails. A table is cleaned and typed once and written, and all its queries read that;
    loaded: the tables of earlier calls, and then of this one."""
    loaded = {} if loaded is None else loaded
    seen: set[str] = set()
    number = 0
    for pair in usable(pairs).toLocalIterator():
        p = pair.asDict()
        if not {p["r_rsc_id"], p["s_rsc_id"]} <= set(tables):
            continue
        for name in {p["r_rsc_id"], p["s_rsc_id"]} - set(loaded):
            table = profile.load_table(tables[name], "complex")
            loaded[name] = materialize(table) if table.columns else table
        r, s = (loaded[p[k]] for k in ("r_rsc_id", "s_rsc_id"))
        on = tuple(clean_names([p["r_col_name"], p["s_col_name"]])) if p["r_col_name"] != p["s_col_name"] else tuple(clean_names([p["r_col_name"]])) * 2
        work = ([(r, None, None)] if p["r_rsc_id"] not in seen else []) + [(r, s, on)]
        seen.add(p["r_rsc_id"])
        for left, right, key in work:
            for level in settings.levels:
                began = time.monotonic()
                kind, sql = sqlgen.propose(left, right, key, level)
                views = {"R": left} if right is None else {"R": left, "S": right}
                made = sqlgen.generate(lambda review, q=sql: (q, 0, 0), reviewer, views, settings.max_reviews)
                columns = tuple(c for t in views.values() for c in t.columns)
                names = tuple(p[k] for k in ("r_rsc_name", "s_rsc_name")[: len(views)] if p.get(k))
                nl_began, asked = time.monotonic(), ("", 0, None, 0, 0)
                if made.success:
                    asked = question(made.sql, columns, names, ask, judge, settings.max_reviews)
                nl, revisions, review, nl_in, nl_out = asked
                now = time.monotonic()
                yield (
                    number, kind, level, made.success and not nl.startswith(("ERROR", "FAILURE")), p["r_rsc_id"], p["s_rsc_id"] if right is not None else None, p.get("r_pkg_id"), p.get("s_pkg_id") if right is not None else None,
                    p.get("r_rsc_name"), p.get("s_rsc_name") if right is not None else None, p["r_col_name"], p["s_col_name"] if right is not None else None, made.sql, nl, made.success, made.seconds, made.revisions, made.review, made.tokens_in, made.tokens_out,
                    now - nl_began, revisions, review, nl_in, nl_out, now - began,
                )
                number += 1
