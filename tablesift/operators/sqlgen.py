"""SQL over discovered table pairs: templates by difficulty, safe execution, and the propose-run-review loop."""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import InheritableThread
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..config import Limits
from .sets import common_attributes, same_schema


@dataclass(frozen=True)
class Verdict:
    status: str
    error_description: str
    sql_query: str
    result: str


#: What a single query over given tables is made of, by the names of the parser's plan nodes. Anything else (commands, table functions,
#: scripts) is refused.
_NODES = frozenset(
    "Project Filter Join Aggregate Sort GlobalLimit LocalLimit Offset Distinct Union Except Intersect SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedWith"
    " UnresolvedHaving WithWindowDefinition Window Generate LateralJoin OneRowRelation UnresolvedInlineTable LocalRelation Pivot Unpivot UnresolvedHint Sample"
    " UnresolvedRelation Expand UnresolvedOrdinal ParameterizedQuery".split()
)
#: Functions that run code or tell of the host.
_FUNCTIONS = frozenset("reflect java_method try_reflect input_file_name input_file_block_start input_file_block_length session_user current_user user current_catalog current_database current_schema version".split())


class Refused(Exception):
    pass


def _each(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def check_plan(plan, tables: frozenset[str]) -> None:
    """Raises Refused unless a parsed plan reads the given tables (lower case) and its own subqueries alone, by allowed nodes and functions."""
    name = plan.nodeName()
    if name not in _NODES:
        raise Refused(f"{name} is not allowed")
    inner = _each(plan.innerChildren().toSeq()) if name == "UnresolvedWith" else []
    if name == "UnresolvedRelation":
        parts = _each(plan.multipartIdentifier())
        if len(parts) != 1 or parts[0].lower() not in tables:
            raise Refused(f"{'.'.join(parts)} is not one of the tables")
    if name == "UnresolvedWith":
        tables = tables | {x.alias().lower() for x in inner}
    for child in [*inner, *_each(plan.children())]:
        check_plan(child, tables)
    for expression in _each(plan.expressions()):
        _check_expression(expression, tables)


def _check_expression(expression, tables: frozenset[str]) -> None:
    name = expression.nodeName()
    if name in ("UnresolvedFunction", "UnresolvedGenerator"):
        parts = _each(expression.nameParts()) if name == "UnresolvedFunction" else [expression.name().funcName()]
        if len(parts) != 1 or parts[0].lower() in _FUNCTIONS:
            raise Refused(f"function {'.'.join(parts)} is not allowed")
    if name.endswith("UnresolvedIdentifier"):
        raise Refused("names made by expressions are not allowed")
    if name in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"):
        check_plan(expression.plan(), tables)
    for child in _each(expression.children()):
        _check_expression(child, tables)


def to_spark(sql: str) -> str:
    """DuckDB spellings that Spark lacks. Double-quoted identifiers become back-quoted ones; strings stay as they are."""
    parts = re.split(r"('(?:[^']|'')*')", sql.strip().rstrip(";"))
    for i in range(0, len(parts), 2):
        p = re.sub(r'"((?:[^"]|"")*)"', lambda m: "`" + m[1].replace('""', '"') + "`", parts[i])
        p = re.sub(r"(?i)\bregexp_matches\s*\(", "regexp_like(", p)
        p = re.sub(r"(?i)\bDATETIME\b(?=\s*\))", "TIMESTAMP", p)
        p = re.sub(r"(?i)\bstrptime\s*\(", "to_timestamp(", p)
        parts[i] = re.sub(r"(?i)\blen\s*\(", "length(", p)
    return "".join(parts)


def _rows(plan) -> float:
    """About how many rows a physical plan's node gives; products of products are multiplied out."""
    name, children = plan.nodeName(), _each(plan.children())
    if not children:
        link = plan.logicalLink()
        if link.isEmpty():
            return 1.0
        stats = link.get().stats()
        known = stats.rowCount()
        return float(str(known.get())) if known.isDefined() else float(str(stats.sizeInBytes())) / (8 + link.get().schema().defaultSize())
    below = [_rows(c) for c in children]
    if name in _PRODUCTS:
        return below[0] * below[1]
    if "Aggregate" in name and plan.groupingExpressions().isEmpty():
        return 1.0
    if name in ("LocalLimit", "GlobalLimit", "CollectLimit", "TakeOrderedAndProject"):
        return min(below[0], float(plan.limit()))
    return sum(below) if name == "Union" else max(below)


_PRODUCTS = frozenset(("CartesianProduct", "BroadcastNestedLoopJoin"))


def largest_product(df: DataFrame) -> float:
    """How many pairs of rows the largest join without equal keys compares, by the sizes that the optimizer knows; 0 if there is none."""

    def walk(plan) -> float:
        return max([_rows(plan) if plan.nodeName() in _PRODUCTS else 0.0, *map(walk, _each(plan.children()))])

    execution = df._jdf.queryExecution()
    planner = execution.sparkSession().sessionState().planner()
    inner = [planner.plan(x).next() for x in _each(execution.optimizedPlan().subqueriesAll())]  # scalar subqueries are planned apart
    return max(map(walk, [execution.sparkPlan(), *inner]))


def _verify(session, query: str, sql: str, tables: dict[str, DataFrame], names: dict[str, str], limits: Limits) -> Verdict:
    check_plan(session._jsparkSession.sessionState().sqlParser().parsePlan(query), frozenset(n.lower() for n in tables))
    for name, df in tables.items():
        df.createGlobalTempView(names[name])
        session.table(f"global_temp.{names[name]}").createOrReplaceTempView(name)
    found = session.sql(query).limit(1)
    pairs = largest_product(found)
    if pairs > limits.pairs:
        raise Refused(f"a product of about {pairs:.1e} pairs of rows")
    if pairs:  # a task looks whether it was cancelled at each row of an exchange, but not within a row's own product
        for name in tables:
            session.table(f"global_temp.{names[name]}").repartition(4 * session.sparkContext.defaultParallelism).createOrReplaceTempView(name)
        found = session.sql(query).limit(1)
    rows = found.collect()
    return Verdict("success", "", sql, str(rows[0].asDict())) if rows else Verdict("error", "Empty result set", sql, "")


def verify_sql(sql: str, tables: dict[str, DataFrame], limits: Limits = Limits()) -> Verdict:
    """Runs one query over the given tables in a session of its own and fetches one row. An exception, an empty result, and a statement
    that is no query or reaches beyond the tables (see `check_plan`) are errors. So is a query whose plan has too large a product, or
    that isn't done in time: its jobs, known by a tag, are cancelled then. The views last as long as the call, so a retry finds them anew."""
    query = to_spark(sql)
    spark = next(iter(tables.values())).sparkSession
    session, tag = spark.newSession(), f"tablesift-{uuid.uuid4().hex}"
    names = {name: f"tablesift_{uuid.uuid4().hex}" for name in tables}
    out: list[Verdict] = []

    def work() -> None:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", limits.pool)
        spark.sparkContext.setInterruptOnCancel(True)
        spark.sparkContext.addJobTag(tag)
        try:
            out.append(_verify(session, query, sql, tables, names, limits))
        except Exception as error:
            out.append(Verdict("error", next((x for x in str(error).split("\n") if x.strip()), type(error).__name__)[:500], sql, ""))

    runner = InheritableThread(target=work, daemon=True)
    try:
        runner.start()
        runner.join(limits.seconds)
        if runner.is_alive():
            spark.sparkContext.cancelJobsWithTag(tag)
            runner.join(10)  # until its jobs have ended; one that still plans can't be cancelled
            return Verdict("error", TIMED_OUT, sql, "")
    finally:
        for name in names.values():
            spark.catalog.dropGlobalTempView(name)
    return out[0]


TIMED_OUT = "timed out"


def verify_all(work: list[tuple[str, dict[str, DataFrame]]], limits: Limits = Limits()) -> list[Verdict]:
    """Verdicts on several queries, `at_once` at a time, in a scheduler pool of their own. Where the application schedules jobs first in, first
    out, a query may wait for another that takes all cores: there those that ran out of time are tried once more, one by one."""
    if not work:
        return []
    context = next(iter(work[0][1].values())).sparkSession.sparkContext
    with ThreadPoolExecutor(limits.at_once) as pool:
        out = list(pool.map(lambda x: verify_sql(*x, limits), work))
    if context.getConf().get("spark.scheduler.mode", "FIFO").upper() != "FAIR" and limits.at_once > 1:
        out = [verify_sql(*x, limits) if v.error_description == TIMED_OUT else v for x, v in zip(work, out)]
    return out


@dataclass(frozen=True)
class Profile:
    """What the templates need of a table: columns by kind, and a value to filter by."""

    name: str
    numbers: list[str]
    strings: list[str]
    columns: list[str]
    sample: dict[str, object] = field(default_factory=dict)

    @staticmethod
    def of(df: DataFrame, name: str) -> Profile:
        numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
        strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
        row = df.dropna().limit(1).collect()
        return Profile(name, numbers, strings, df.columns, row[0].asDict() if row else {})


def _literal(x: object) -> str:
    return "'" + str(x).replace("'", "''") + "'" if isinstance(x, str) else str(x)


def single_table(p: Profile, level: str) -> str:
    """simple filters; moderate groups and aggregates; challenging ranks within groups and compares with a subquery."""
    s, n = (p.strings or p.columns)[0], (p.numbers or p.columns)[-1]
    if level == "simple":
        return f"SELECT {', '.join(p.columns[:3])} FROM {p.name} WHERE {s} = {_literal(p.sample.get(s, ''))}"
    if level == "moderate":
        return f"SELECT REPLACE(CAST({s} AS STRING), ' ', '_') AS label, COUNT(*) AS n, SUM(CAST({n} AS DOUBLE)) AS total FROM {p.name} GROUP BY {s}"
    if level == "challenging":
        return f"SELECT {s}, {n}, place FROM (SELECT {s}, {n}, RANK() OVER (PARTITION BY {s} ORDER BY {n} DESC) AS place FROM {p.name} WHERE {n} >= (SELECT AVG({n}) FROM {p.name})) WHERE place <= 3"
    raise ValueError(f"unknown level: {level}")


def join_tables(r: Profile, s: Profile, on: tuple[str, str], level: str) -> str:
    """On the discovered pair of columns."""
    a, b = on
    g, n = (r.strings or r.columns)[0], (s.numbers or s.columns)[-1]
    tables = f"{r.name} JOIN {s.name} ON {r.name}.{a} = {s.name}.{b}"
    if level == "simple":
        return f"SELECT {r.name}.{a}, {s.name}.{n} FROM {tables}"
    if level == "moderate":
        return f"SELECT {r.name}.{g} AS label, COUNT(*) AS n, SUM({s.name}.{n}) AS total FROM {tables} GROUP BY {r.name}.{g}"
    if level == "challenging":
        return f"SELECT label, n, RANK() OVER (ORDER BY n DESC) AS place FROM (SELECT {r.name}.{g} AS label, COUNT(*) AS n FROM {tables} WHERE {s.name}.{n} > (SELECT AVG({n}) FROM {s.name}) GROUP BY {r.name}.{g})"
    raise ValueError(f"unknown level: {level}")


def union_tables(r: Profile, s: Profile, common: list[str], level: str) -> str:
    """Over the attributes that both have."""
    names = ", ".join(common)
    both = f"SELECT {names} FROM {r.name} UNION ALL SELECT {names} FROM {s.name}"
    number = next((c for c in reversed(common) if c in r.numbers), common[-1])
    if level == "simple":
        return f"SELECT {names} FROM {r.name} UNION SELECT {names} FROM {s.name}"
    if level == "moderate":
        return f"SELECT {common[0]} AS label, COUNT(*) AS n FROM ({both}) GROUP BY {common[0]}"
    if level == "challenging":
        return f"SELECT {names} FROM (SELECT {names}, ROW_NUMBER() OVER (PARTITION BY {common[0]} ORDER BY {number} DESC) AS place FROM ({both})) WHERE place = 1"
    raise ValueError(f"unknown level: {level}")


def propose(r: DataFrame, s: DataFrame | None, on: tuple[str, str] | None, level: str) -> tuple[str, str]:
    """(type, sql): single-table without a second table; tables of one schema are united, others joined on the pair."""
    p = Profile.of(r, "R")
    if s is None:
        return "single-table", single_table(p, level)
    q = Profile.of(s, "S")
    if same_schema(r, s):
        return "multi-table-union", union_tables(p, q, common_attributes(r, s), level)
    return "multi-table-join", join_tables(p, q, on, level)


@dataclass
class Generated:
    sql: str
    success: bool
    revisions: int
    review: str
    seconds: float
    tokens_in: int = 0
    tokens_out: int = 0


Generator = Callable[[str | None], tuple[str, int, int]]
Reviewer = Callable[[str, Verdict], tuple[bool, str]]


def generate(generator: Generator, reviewer: Reviewer, tables: dict[str, DataFrame], max_reviews: int = 3, limits: Limits = Limits()) -> Generated:
    """Proposes SQL, runs it, has it reviewed, and revises at most so often. generator(review) gives (sql, tokens in, tokens
    out); what still fails at the end reads `FAILURE: ...`."""
    began, review, tokens, verdict, sql, n = time.monotonic(), None, [0, 0], None, "", 0
    for n in range(max_reviews + 1):
        sql, more_in, more_out = generator(review)
        tokens = [tokens[0] + more_in, tokens[1] + more_out]
        verdict = verify_sql(sql, tables, limits)
        approved, review = reviewer(sql, verdict) if verdict.status == "success" else (False, verdict.error_description)
        if approved:
            return Generated(sql, True, n, review, time.monotonic() - began, *tokens)
    return Generated(f"FAILURE: {sql}", False, n, review or "", time.monotonic() - began, *tokens)


@dataclass
class Work:
    """A query to be generated: what the model is told, and the tables."""

    prompt: str
    tables: dict[str, DataFrame]


def sql_of(reply: str | None) -> str:
    """The SQL in a reply: what stands in its first fenced block, or all of it."""
    text = reply or ""
    fenced = re.search(r"```(?:\w+\n)?(.*?)```", text, re.S)
    return (fenced[1] if fenced else text).strip()


def revised(prompt: str, sql: str | None, review: str | None) -> str:
    return prompt if sql is None else f"{prompt}\n\nYour last query:\n{sql}\n\nIt was sent back:\n{review}\n\nGive a better one."


def review_prompt(prompt: str, sql: str, result: str) -> str:
    return f"Review this query for the task below. Reply in JSON with correctness, approval (approve or reject) and suggested_changes.\n\nTask:\n{prompt}\n\nQuery:\n{sql}\n\nFirst row:\n{result}"


def read_review(reply: str | None) -> tuple[bool, str]:
    """The driver-side twin of `functions.scoring.parse_review`: (approved, what to change)."""
    try:
        fields = json.loads(reply or "")
        return str(fields.get("approval")).strip().lower() == "approve", str(fields.get("suggested_changes") or "")
    except (ValueError, AttributeError):
        return False, "The review was not JSON."


#: Prompts to replies (see `sources.models.ask_all`)
AskAll = Callable[[list[str]], list]


def generate_all(work: list[Work], ask: AskAll, max_reviews: int = 3, limits: Limits = Limits()) -> list[Generated]:
    """`generate` for many at once, by rounds: all open queries are asked for together, verified together, those that ran reviewed
    together, and what was sent back is asked for again with the reason, at most so often."""
    out: list[Generated | None] = [None] * len(work)
    began, tokens = time.monotonic(), [[0, 0] for _ in work]
    last: list[tuple[str | None, str | None]] = [(None, None)] * len(work)
    for n in range(max_reviews + 1):
        open_ = [i for i, x in enumerate(out) if x is None]
        if not open_:
            break
        replies = ask([revised(work[i].prompt, *last[i]) for i in open_])
        sql = {i: sql_of(r.text) for i, r in zip(open_, replies)}
        verdicts = dict(zip(open_, verify_all([(sql[i], work[i].tables) for i in open_], limits)))
        good = [i for i in open_ if verdicts[i].status == "success"]
        reviews = ask([review_prompt(work[i].prompt, sql[i], verdicts[i].result) for i in good])
        for i, r in [*zip(open_, replies), *zip(good, reviews)]:
            tokens[i] = [tokens[i][0] + r.tokens_in, tokens[i][1] + r.tokens_out]
        said = {i: read_review(r.text) for i, r in zip(good, reviews)}
        for i in open_:
            approved, review = said.get(i, (False, verdicts[i].error_description))
            last[i] = (sql[i], review)
            if approved or n == max_reviews:
                out[i] = Generated(sql[i] if approved else f"FAILURE: {sql[i]}", approved, n, review, time.monotonic() - began, *tokens[i])
    return out
