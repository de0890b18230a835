"""Queries on scores, metadata, generated SQL and the statistics over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import dates
from ..functions.scoring import leaks, parse_review, parse_score, succeeded
from ..operators import debate, metadata, sqlgen, stats
from .lake_queries import read

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _replies(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    number = F.floor(F.col("value")) % 14
    text = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("no number "), number)).when(F.col("event_id") % 5 == 1, F.concat(F.lit("ANSWER: "), number)).otherwise(F.concat(F.lit("I think. Answer: "), number, F.lit(".")))
    return events.select("event_id", (F.col("event_id") % 97).alias("pair_id"), text.alias("reply"))


def score_parse(spark, sf_dir):
    return _replies(spark, sf_dir).select("event_id", parse_score(F.col("reply")).alias("score"))


def majority_vote(spark, sf_dir):
    return stats.majority(_replies(spark, sf_dir).select("pair_id", parse_score(F.col("reply")).alias("score")), ["pair_id"])


def debate_rounds(spark, sf_dir):
    """A debate with a stand-in model: a solver answers by the prompt's length, then moves towards the others."""
    prompts = read(spark, sf_dir, "conversations").where("turn = 0").groupBy("conv_id").agg(F.max("text").alias("prompt")).withColumnRenamed("conv_id", "pair_id")

    def model(prompt, solver, number, others):
        if number == 0:
            return f"Answer: {(len(prompt) + solver) % 11}"
        return "Answer: " + str(min(int(x.split()[-1]) for x in others))

    return debate.debate_scores(debate.replies(prompts, model))


def threshold_counts(spark, sf_dir):
    return stats.threshold_counts(read(spark, sf_dir, "events").select((F.col("value") / 10).alias("score")), "score", 0, 10)


def threshold_join(spark, sf_dir):
    events = read(spark, sf_dir, "events").select((F.col("value") / 10).alias("score"), "event_type")
    a, b = (stats.threshold_counts(events.where(F.length("event_type") % 2 == i), "score", 0, 10) for i in (0, 1))
    return stats.threshold_join(a, b, ("even", "odd"))


def running_success_rate(spark, sf_dir):
    return stats.running_rate(read(spark, sf_dir, "labels"), ["doc_id"], "quality", 100)


def running_success_by_group(spark, sf_dir):
    return stats.running_rate(read(spark, sf_dir, "labels"), ["doc_id"], "quality", 50, ["toxic"])


def group_count_total(spark, sf_dir):
    return stats.counts_with_total(read(spark, sf_dir, "orders"), "o_orderpriority")


def pivot_counts(spark, sf_dir):
    return stats.pivot_counts(read(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


def pivot_rescaled(spark, sf_dir):
    out = stats.pivot_counts(read(spark, sf_dir, "orders").withColumn("kind", F.when(F.col("o_orderstatus") == "F", "single").otherwise("multi")), "o_orderpriority", "kind", ["single", "multi"])
    return out.select("o_orderpriority", *[F.round(F.col(c) / 1000, 3).alias(f"{c}_k") for c in ("single", "multi")])


def group_mean_std(spark, sf_dir):
    return stats.mean_std(read(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")


def describe_numeric(spark, sf_dir):
    return stats.describe(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax", "l_extendedprice"])


def table_shapes(spark, sf_dir):
    """Rows and columns of a lake's tables."""
    names = ["region", "nation", "supplier", "customer", "part"]
    shapes = [df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns))) for df in (read(spark, sf_dir, n) for n in names)]
    return stats.table_shapes(reduce(lambda a, b: a.union(b), shapes))


def t_statistic(spark, sf_dir):
    """Whether mean discount and balance differ from given values: statistic and two-tailed p-value over all rows."""
    rows = []
    for name, df, null in (("discount", read(spark, sf_dir, "lineitem").select("l_discount"), 0.05), ("balance", read(spark, sf_dir, "customer").select("c_acctbal"), 4500.0)):
        mean, sd, n = df.agg(F.avg(df.columns[0]), F.stddev_samp(df.columns[0]), F.count("*")).first()
        t, p = stats.t_test(mean, sd, n, null)
        rows.append((name, round(t, 6), round(p, 6)))
    return spark.createDataFrame(rows, "rows string, t double, p double")


def success_rates(spark, sf_dir):
    events = read(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("process"), (F.col("value") > 50).alias("success"))
    return stats.success_rates(events, "process", "success")


def stage_seconds(spark, sf_dir):
    """Text stamps to times, and the seconds between a user's first and last."""
    stamps = read(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    a, b = (dates.parse_time(F.date_format(x, "yyyy-MM-dd HH:mm:ss")) for x in ("a", "b"))
    return stamps.select("user_id", dates.seconds_between(a, b).alias("seconds"), dates.parse_time(F.lit("no time")).isNull().alias("unreadable"))


def cast_dates(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    return orders.select("o_orderkey", dates.to_day(F.col("o_orderdate")).alias("day"), dates.to_day(F.date_format("o_orderdate", "dd/MM/yyyy"), "%d/%m/%Y").alias("read"), dates.to_day(F.col("o_orderpriority")).alias("none"))


def regex_conditional_sum(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    number = F.regexp_extract("props", r"(\d+)", 1).try_cast("bigint")
    return events.groupBy("event_type", (F.col("user_id") % 3).alias("bucket")).agg(F.sum(F.when(F.col("props").rlike(r'"k": \d*[02468]\}'), number).otherwise(0)).alias("even_sum"))


def replace_cast_sum(spark, sf_dir):
    part = read(spark, sf_dir, "part").withColumn("shown", F.concat(F.floor(F.col("p_size")).cast("string"), F.lit(",000")))
    return part.groupBy("p_brand").agg(F.sum(F.regexp_replace("shown", ",", "").cast("bigint")).alias("total"), F.count("shown").alias("n"))


def success_flag(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    outcome = F.when(F.col("o_orderkey") % 7 == 0, "ERROR: x").when(F.col("o_orderkey") % 11 == 0, "FAILURE: y").otherwise("SELECT ERROR")
    return orders.groupBy(succeeded(outcome, F.col("o_orderpriority")).alias("success")).agg(F.count("*").alias("n"))


def leak_check(spark, sf_dir):
    names = F.array(F.lit("the"), F.lit("data_set"), F.lit("in"))
    text = F.concat("text", F.when(F.col("conv_id") % 3 == 0, " of 'the' kind").when(F.col("conv_id") % 3 == 1, " Data_Set").otherwise(""))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", leaks(text, names).alias("leak"))


def review_parse(spark, sf_dir):
    labels = read(spark, sf_dir, "labels")
    reply = F.when(F.col("doc_id") % 4 == 0, "not json").otherwise(F.to_json(F.struct(F.lit("fine").alias("correctness"), F.when(F.col("quality") == 1, " Approve ").otherwise("reject").alias("approval"), F.lit("none").alias("suggested_changes"))))
    return labels.select("doc_id", parse_review(reply)["approved"].alias("approved"))


def revision_totals(spark, sf_dir):
    """Turns as revisions: tokens in all, and the last review of each conversation."""
    turns = read(spark, sf_dir, "conversations")
    return turns.groupBy("conv_id").agg(F.count("*").alias("n_rev"), F.sum(F.length("text")).alias("tokens"), F.max_by(F.sha2("text", 256), "turn").alias("last_review"))


def error_class_extract(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    message = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "ERROR").otherwise("FAILURE"), F.lit(", "), "o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, " Parser Error: at 1").otherwise(": no table"))
    return stats.error_classes(orders.select(message.alias("message")))


def _packages(spark, sf_dir):
    """Package records as JSON, made from nations and regions."""
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    one = F.struct(
        F.concat(F.lit("p"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("name"),
        F.when(F.col("r_regionkey") != 2, F.concat(F.lit("<b>Notes</b> on\n"), "r_name")).alias("notes"),
        F.when(F.col("r_regionkey") % 2 == 0, F.lit('["a","b"]')).otherwise(F.lit('{"en":["c"],"fr":["d"]}')).alias("keywords"),
        F.when(F.col("r_regionkey") != 1, F.struct(F.col("r_name").alias("name"), F.lit("t").alias("title"), F.lit(None).cast("string").alias("description"))).alias("organization"),
        F.col("rs").alias("resources"),
    )
    resource = F.struct(F.concat(F.lit("r"), (F.col("n_nationkey") % 20).cast("string")).alias("id"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 4 == 3, "PDF").otherwise("CSV").alias("format"))
    grouped = nation.groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct(F.col("n_nationkey").alias("k"), resource.alias("r")))).alias("rs"))
    rows = region.join(grouped, F.col("r_regionkey") == F.col("n_regionkey")).withColumn("rs", F.transform("rs", lambda x: x["r"]))
    return rows.select(F.from_json(F.to_json(one), metadata.PACKAGE).alias("p")).select("p.*")


def metadata_project(spark, sf_dir):
    out = metadata.attributes(_packages(spark, sf_dir), ("CSV",), 14)
    return out.withColumns({"keywords": F.array_join("keywords", ","), "tags": F.size("tags")})


def sql_templates(spark, sf_dir):
    """Every template, generated and verified."""
    tables = {"n": read(spark, sf_dir, "nation"), "c": read(spark, sf_dir, "customer"), "s": read(spark, sf_dir, "supplier").selectExpr("s_suppkey as key", "s_name as name", "s_acctbal as balance")}
    other = tables["c"].selectExpr("c_custkey as key", "c_name as name", "c_acctbal as balance")
    rows = []
    for level in ("simple", "moderate", "challenging"):
        for r, s, on in ((tables["n"], None, None), (tables["n"], tables["c"], ("n_nationkey", "c_nationkey")), (tables["s"], other, None)):
            kind, sql = sqlgen.propose(r, s, on, level)
            verdict = sqlgen.verify_sql(sql, {"R": r} if s is None else {"R": r, "S": s})
            rows.append((kind, level, verdict.status))
    return spark.createDataFrame(rows, "type string, level string, status string")


def sql_verdicts(spark, sf_dir):
    """Queries that must fail, and how."""
    t = {"R": read(spark, sf_dir, "region")}
    cases = ["SELECT \"r_name\" FROM R", "SELECT * FROM R WHERE r_regionkey > 99", "SELEC 1", "SELECT nothing FROM R", "DROP TABLE R", "SELECT 1; SELECT 2", "SELECT count(*) FROM R WHERE regexp_matches(r_name, 'A')",
             "SELECT java_method('java.lang.System', 'getProperty', 'user.home')", "SELECT reflect('java.lang.System', 'getenv', 'HOME') FROM R", "SELECT value FROM text.`/etc/passwd`", "SELECT * FROM range(5)",
             "WITH x AS (SELECT r_name FROM R) SELECT (SELECT max(r_name) FROM x) FROM R WHERE EXISTS (SELECT 1 FROM x)", "SELECT (SELECT count(*) FROM csv.`/etc/passwd`) FROM R", "SELECT transform(r_name) USING 'cat' AS (x) FROM R",
             "SELECT identifier('reflect')('a', 'b') FROM R"]
    found = [sqlgen.verify_sql(sql, t) for sql in cases]
    return spark.createDataFrame([(i, v.status, v.error_description == "Empty result set") for i, v in enumerate(found)], "case int, status string, empty boolean")


def _views(spark, sf_dir, *names):
    for n in names:
        read(spark, sf_dir, n).createOrReplaceTempView(n)


def _sql(name: str, sql: str, *tables: str):
    def run(spark, sf_dir):
        _views(spark, sf_dir, *tables)
        return spark.sql(sql)

    run.__name__ = name
    return run


#: The SQL that generated questions reach, in the dialect both engines share.
SHARED_SQL = {
    "sql_simple_single": ("select c_custkey, c_name, c_acctbal from customer where c_mktsegment = 'BUILDING' and c_acctbal > 1000", "customer"),
    "sql_simple_join": ("select o.o_orderkey, c.c_name from orders o join customer c on o.o_custkey = c.c_custkey where o.o_orderstatus = 'P'", "orders", "customer"),
    "sql_simple_union": ("select c_name as name, c_nationkey as nation from customer union select s_name, s_nationkey from supplier", "customer", "supplier"),
    "sql_moderate_single": ("select replace(p_type, ' ', '_') as kind, count(*) as n, round(sum(cast(p_retailprice as double)), 4) as total from part group by replace(p_type, ' ', '_')", "part"),
    "sql_moderate_join": ("select c.c_mktsegment, count(*) as n, round(avg(o.o_totalprice), 4) as mean_price from orders o join customer c on o.o_custkey = c.c_custkey group by c.c_mktsegment", "orders", "customer"),
    "sql_moderate_union": ("select nation, count(*) as n from (select c_nationkey as nation from customer union all select s_nationkey from supplier) t group by nation", "customer", "supplier"),
    "sql_challenging_single": ("select o_custkey, o_orderkey, place from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as place from orders where o_totalprice >= (select avg(o_totalprice) from orders)) t where place <= 3", "orders"),
    "sql_challenging_join": ("select c.c_custkey, o.o_orderkey from customer c join orders o on o.o_custkey = c.c_custkey where o.o_totalprice > (select avg(x.o_totalprice) from orders x where x.o_custkey = c.c_custkey)", "customer", "orders"),
    "sql_challenging_union": ("select nation, name, balance from (select nation, name, balance, row_number() over (partition by nation order by balance desc, name) as place from (select c_nationkey as nation, c_name as name, c_acctbal as balance from customer union all select s_nationkey, s_name, s_acctbal from supplier) u) t where place = 1", "customer", "supplier"),
    "join_on_discovered_pair": ("select p.p_brand, count(*) as n, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) as revenue from lineitem l join part p on l.l_partkey = p.p_partkey group by p.p_brand", "lineitem", "part"),
    "sql_outer_join": ("select c.c_custkey, count(o.o_orderkey) as n from customer c left join orders o on o.o_custkey = c.c_custkey group by c.c_custkey", "customer", "orders"),
    "sql_semi_anti": ("select 'with' as kind, count(*) as n from customer where exists (select 1 from orders where o_custkey = c_custkey) union all select 'without', count(*) from customer where not exists (select 1 from orders where o_custkey = c_custkey)", "customer", "orders"),
    "sql_except": ("select c_nationkey as nation from customer except select s_nationkey from supplier where s_acctbal > 5000", "customer", "supplier"),
    "sql_grouping_sets": ("select o_orderstatus, o_orderpriority, count(*) as n from orders group by grouping sets ((o_orderstatus, o_orderpriority), (o_orderstatus), ())", "orders"),
    "sql_case_having": ("select l_suppkey, sum(case when l_returnflag = 'R' then 1 else 0 end) as returned from lineitem group by l_suppkey having sum(case when l_returnflag = 'R' then 1 else 0 end) > 5", "lineitem"),
    "sql_window_frames": ("select user_id, event_id, sum(value) over (partition by user_id order by event_id rows between 2 preceding and current row) as recent, lag(event_type) over (partition by user_id order by event_id) as before from events", "events"),
    "sql_sort_nulls": ("select x from (select case when o_orderkey % 10 = 0 then null else o_orderkey end as x from orders) t order by x nulls last limit 20", "orders"),
}

QUERIES = {
    f.__name__: f
    for f in (
        score_parse, majority_vote, debate_rounds, threshold_counts, threshold_join, running_success_rate, running_success_by_group, group_count_total, pivot_counts, pivot_rescaled,
        group_mean_std, describe_numeric, table_shapes, t_statistic, success_rates, stage_seconds, cast_dates, regex_conditional_sum, replace_cast_sum, success_flag, leak_check, review_parse, revision_totals, error_class_extract,
        metadata_project, sql_templates, sql_verdicts, *(_sql(n, s[0], *s[1:]) for n, s in SHARED_SQL.items()),
    )
}

_REPLY = "r as (select event_id, event_id % 97 as pair_id, case when event_id % 5 = 0 then 'no number' when event_id % 5 = 1 then 'answer: ' else 'i think. answer: ' end || cast(cast(floor(value) as bigint) % 14 as varchar) as reply from events), p as (select event_id, pair_id, try_cast(regexp_extract(reply, 'answer: (\\d+)', 1) as bigint) as x from r), s as (select event_id, pair_id, cast(case when x between 0 and 10 then x else -1 end as integer) as score from p)"


def _thresholds(where: str) -> str:
    return f"select cast(t as integer) as threshold, count(v.score) as n, round(count(v.score) / (select count(*) from events where {where}), 6) as ratio from range(0, 11) g(t) left join (select value / 10 as score from events where {where}) v on least(floor(v.score), 10) >= t group by t"


def _running(by: str, step: int) -> str:
    key, over = (f"{by}, ", f"partition by {by}") if by else ("", "")
    return f"""with n as (select {key}quality, row_number() over ({over} order by doc_id) as i, count(*) over ({over}) as c from labels),
r as (select {key}i, c, avg(quality) over ({over} order by i) as rate from n)
select {key}i as n_rows, round(rate, 6) as rate from r where i % {step} = 0 or i = c"""


ORACLE = {
    "score_parse": f"with {_REPLY} select event_id, score from s",
    "majority_vote": f"with {_REPLY}, c as (select pair_id, score, row_number() over (partition by pair_id order by count(*) desc, score) as i from s group by pair_id, score) select pair_id, score from c where i = 1",
    "debate_rounds": """with p as (select conv_id as pair_id, length(max(text)) as n from conversations where turn = 0 group by conv_id),
a as (select pair_id, (n + 0) % 11 as a, (n + 1) % 11 as b, (n + 2) % 11 as c from p), l as (select pair_id, unnest([least(b, c), least(a, c), least(a, b)]) as score from a),
v as (select pair_id, score, row_number() over (partition by pair_id order by count(*) desc, score) as i from l group by pair_id, score) select pair_id, cast(score as integer) as score from v where i = 1""",
    "threshold_counts": _thresholds("true"),
    "threshold_join": f"select a.threshold, a.n as n_even, a.ratio as ratio_even, b.n as n_odd, b.ratio as ratio_odd from ({_thresholds('length(event_type) % 2 = 0')}) a join ({_thresholds('length(event_type) % 2 = 1')}) b using (threshold)",
    "running_success_rate": _running("", 100),
    "running_success_by_group": _running("toxic", 50),
    "group_count_total": "select case when grouping(o_orderpriority) = 1 then 'total' else o_orderpriority end as o_orderpriority, count(*) as n from orders group by rollup (o_orderpriority)",
    "pivot_counts": 'select o_orderpriority, count(*) filter (where o_orderstatus = \'F\') as "F", count(*) filter (where o_orderstatus = \'O\') as "O", count(*) filter (where o_orderstatus = \'P\') as "P" from orders group by o_orderpriority',
    "pivot_rescaled": "select o_orderpriority, round(count(*) filter (where o_orderstatus = 'F') / 1000, 3) as single_k, round(count(*) filter (where o_orderstatus <> 'F') / 1000, 3) as multi_k from orders group by o_orderpriority",
    "group_mean_std": "select l_returnflag, l_linestatus, count(l_extendedprice) as n, round(avg(l_extendedprice), 6) as mean, round(stddev_samp(l_extendedprice), 6) as std from lineitem group by l_returnflag, l_linestatus",
    "describe_numeric": " union all ".join(f"select '{c}' as column_name, count({c}) as n, count(*) - count({c}) as n_nulls, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std, round(min({c}), 6) as min, round(quantile_cont({c}, 0.25), 6) as q25, round(quantile_cont({c}, 0.5), 6) as q50, round(quantile_cont({c}, 0.75), 6) as q75, round(max({c}), 6) as max from lineitem" for c in ("l_quantity", "l_discount", "l_tax", "l_extendedprice")),
    "table_shapes": """with t as (select count(*) as r, 2 as c from region union all select count(*), 3 from nation union all select count(*), 4 from supplier union all select count(*), 5 from customer union all select count(*), 6 from part)
select count(*) as n_tables, round(avg(r), 6) as mean_rows, round(stddev_samp(r), 6) as std_rows, round(avg(c), 6) as mean_columns, round(stddev_samp(c), 6) as std_columns from t""",
    "t_statistic": """with s as (select 'discount' as rows, (avg(l_discount) - 0.05) / (stddev_samp(l_discount) / sqrt(count(*))) as t, count(*) - 1.0 as v from lineitem
 union all select 'balance', (avg(c_acctbal) - 4500) / (stddev_samp(c_acctbal) / sqrt(count(*))), count(*) - 1.0 from customer),
p as (select rows, t, abs(t) / 6000 * sum((case when i in (0, 2000) then 1 when i % 2 = 1 then 4 else 2 end) * exp(lgamma((v + 1) / 2) - lgamma(v / 2) - 0.5 * ln(v * pi()) - (v + 1) / 2 * ln(1 + (t * i / 2000) * (t * i / 2000) / v))) as area
 from s, range(0, 2001) r(i) group by rows, t)
select rows, round(t, 6) as t, round(1 - 2 * area, 6) as p from p""",
    "success_rates": "with r as (select count(*) filter (where value > 50) as n, avg(case when value > 50 then 1.0 else 0.0 end) as rate from events group by user_id % 10) select count(*) as n_processes, cast(sum(n) as bigint) as n_success, round(avg(rate), 6) as mean_rate from r",
    "stage_seconds": "select user_id, date_diff('second', date_trunc('second', min(ts)), date_trunc('second', max(ts))) as seconds, true as unreadable from events group by user_id",
    "cast_dates": "select o_orderkey, cast(o_orderdate as date) as day, cast(strptime(strftime(o_orderdate, '%d/%m/%Y'), '%d/%m/%Y') as date) as read, cast(null as date) as none from orders",
    "regex_conditional_sum": "select event_type, user_id % 3 as bucket, cast(sum(case when regexp_matches(props, '\"k\": \\d*[02468]\\}') then try_cast(regexp_extract(props, '(\\d+)', 1) as bigint) else 0 end) as bigint) as even_sum from events group by event_type, user_id % 3",
    "replace_cast_sum": "select p_brand, cast(sum(cast(replace(cast(p_size as varchar) || ',000', ',', '') as bigint)) as bigint) as total, count(*) as n from part group by p_brand",
    "success_flag": "select not (o_orderkey % 7 = 0 or o_orderkey % 11 = 0) as success, count(*) as n from orders group by 1",
    "leak_check": """with t as (select conv_id, turn, lower(text || case when conv_id % 3 = 0 then ' of ''the'' kind' when conv_id % 3 = 1 then ' Data_Set' else '' end) as q from conversations)
select conv_id, turn, contains(q, '''the''') or contains(q, '"the"') or contains(q, '`the`') or contains(q, '''in''') or contains(q, '"in"') or contains(q, '`in`') or contains(q, 'data_set') as leak from t""",
    "review_parse": "select doc_id, doc_id % 4 <> 0 and quality = 1 as approved from labels",
    "revision_totals": "select conv_id, count(*) as n_rev, cast(sum(length(text)) as bigint) as tokens, arg_max(sha256(text), turn) as last_review from conversations group by conv_id",
    "error_class_extract": "select regexp_extract(case when o_orderkey % 2 = 0 then 'ERROR' else 'FAILURE' end || ', ' || o_orderstatus || case when o_orderkey % 5 = 0 then ' Parser Error: at 1' else ': no table' end, '(\\w+ Error|[\\w ,]+)', 1) as error_class, count(*) as n from orders group by 1",
    "metadata_project": """with x as (select *, 'r' || cast(n_nationkey % 20 as varchar) as rid, row_number() over (partition by n_nationkey % 20 order by r_regionkey desc, n_nationkey desc) as i from nation join region on n_regionkey = r_regionkey where n_nationkey % 4 <> 3)
select rid as resource_id, n_name as resource_name, 'p' || cast(r_regionkey as varchar) as package_id, r_name as package_name, case when r_regionkey = 2 then '' else substring(' Notes  on ' || r_name, 1, 14) end as notes,
 case when r_regionkey % 2 = 0 then 'a,b' else 'c' end as keywords, cast(0 as integer) as tags, case when r_regionkey <> 1 then r_name end as organization_name, case when r_regionkey <> 1 then 't' end as organization_title, cast(null as varchar) as organization_description, cast(null as varchar) as jurisdiction from x where i = 1""",
    "sql_templates": "select t as type, l as level, 'success' as status from (values ('single-table'), ('multi-table-join'), ('multi-table-union')) a(t), (values ('simple'), ('moderate'), ('challenging')) b(l)",
    "sql_verdicts": "select * from (values (0, 'success', false), (1, 'error', true), (2, 'error', false), (3, 'error', false), (4, 'error', false), (5, 'error', false), (6, 'success', false), (7, 'error', false), (8, 'error', false), (9, 'error', false), (10, 'error', false), (11, 'success', false), (12, 'error', false), (13, 'error', false), (14, 'error', false)) t(\"case\", status, empty)",
    **{n: s[0] for n, s in SHARED_SQL.items()},
}
