"""Queries that ask a language model over HTTP. A stand-in service, on the driver's host or beside each task that asks, answers by rule, and
fails every third call."""

from __future__ import annotations

import contextlib
import functools
import json
import re
import threading
from collections.abc import Callable, Iterator

from pyspark.sql import functions as F

from ..operators import debate, sqlgen
from ..sources import models
from ..sources.exchange import scratch
from .lake_queries import read
from .services import Answer, listen, serve
from .stats_queries import ORACLE as STATS_ORACLE


def _replier(reply: Callable[[str, int], str], fail_every: int, asked: list[str] | None = None) -> Answer:
    lock, calls = threading.Lock(), [0]

    def answer(_, sent: dict) -> tuple[int, dict | None]:
        prompt = sent["messages"][0]["content"]
        with lock:
            calls[0] += 1
            if fail_every and calls[0] % fail_every == 0:
                return 503, None
            if asked is not None:
                asked.append(prompt)
        text = reply(prompt, sent["seed"])
        return 200, {"choices": [{"message": {"content": text}}], "usage": {"prompt_tokens": len(prompt.split()), "completion_tokens": len(text.split())}}

    return answer


@contextlib.contextmanager
def stand_in(spark, reply: Callable[[str, int], str], fail_every: int = 3) -> Iterator[tuple[models.Endpoint, list[str]]]:
    """A service that replies by a function of (prompt, seed); gives its endpoint and the prompts it was asked so far."""
    asked: list[str] = []
    with serve(spark, _replier(reply, fail_every, asked)) as url:
        yield models.Endpoint(f"{url}/v1/chat/completions", "stand-in", wait=0.01, longest=0.1, tries=12), asked


@contextlib.contextmanager
def _replica(reply: Callable[[str, int], str], fail_every: int) -> Iterator[str]:
    with listen(_replier(reply, fail_every), "127.0.0.1") as port:
        yield f"http://127.0.0.1:{port}/v1/chat/completions"


def stand_ins(spark, reply: Callable[[str, int], str], fail_every: int = 3) -> models.Endpoint:
    """Such a service for each task that asks, on its own host: no prompts pass through the driver, and more cores bring more services."""
    tasks = max(models.Endpoint.tasks, 4 * spark.sparkContext.defaultParallelism)
    return models.Endpoint("", "stand-in", tasks=tasks, wait=0.01, longest=0.1, tries=12, beside=functools.partial(_replica, reply, fail_every))


def _debater(prompt: str, seed: int) -> str:
    base, _, others = prompt.partition("\n\nOther solvers answered:\n")
    return f"Answer: {min(map(int, re.findall(r'Answer: (\d+)', others)))}" if others else f"Answer: {(len(base) + seed) % 11}"


def debate_over_http(spark, sf_dir):
    """The debate, asked round by round through the client."""
    prompts = read(spark, sf_dir, "conversations").where("turn = 0").groupBy(F.col("conv_id").alias("pair_id")).agg(F.max("text").alias("prompt"))
    store = f"{scratch(spark)}/answers"
    endpoint = stand_ins(spark, _debater)
    return debate.debate_scores(debate.replies_by_rounds(prompts, lambda rows: models.answers(rows, endpoint, store)))


def _author(prompt: str, seed: int) -> str:
    """First a query that doesn't parse, then one without rows, then a right one, which the reviewer approves."""
    if prompt.startswith("Review"):
        return json.dumps({"correctness": "fine", "approval": "approve", "suggested_changes": "none"})
    task = re.search(r"segment '(\w+)'", prompt)[1]
    if "sent back" not in prompt:
        return f"```sql\nSELEC count(*) FROM R WHERE c_mktsegment = '{task}'\n```"
    if "Empty result set" not in prompt:
        return f"SELECT c_name FROM R WHERE c_mktsegment = '{task}' AND c_custkey < -1"
    return f"Here:\n```\nSELECT count(*) AS n FROM R WHERE c_mktsegment = '{task}'\n```"


def revised_queries(spark, sf_dir):
    """For each segment a query that is sent back twice: tokens and revisions add up, and what is asked again comes from the store."""
    customer = read(spark, sf_dir, "customer")
    segments = sorted(r[0] for r in customer.select("c_mktsegment").distinct().collect())
    store = f"{scratch(spark)}/answers"
    with stand_in(spark, _author) as (endpoint, asked):
        ask = lambda texts: models.ask_all(spark, texts, endpoint, store)
        work = [sqlgen.Work(f"How many customers are in segment '{s}'?", {"R": customer}) for s in segments]
        made = sqlgen.generate_all(work, ask)
        first = len(asked)
        sqlgen.generate_all(work, ask)
        again = len(asked) - first
    rows = []
    for s, m in zip(segments, made):
        verdict = sqlgen.verify_sql(m.sql, {"R": customer})
        rows.append((s, m.success, m.revisions, int(re.search(r"\d+", verdict.result)[0]), m.tokens_in > 0, first, again))
    return spark.createDataFrame(rows, "segment string, success boolean, sql_n_rev int, n long, counted boolean, asked int, asked_again int")


QUERIES = {f.__name__: f for f in (debate_over_http, revised_queries)}
ORACLE = {
    "debate_over_http": STATS_ORACLE["debate_rounds"],
    "revised_queries": "select c_mktsegment as segment, true as success, 2 as sql_n_rev, count(*) as n, true as counted, cast(4 * (select count(distinct c_mktsegment) from customer) as integer) as asked, 0 as asked_again from customer group by 1",
}
