"""The model client, its store, the debate by rounds and the revision loop, against a local service that fails every third call."""

import dataclasses
import json
import types

from pyspark.sql import functions as F

from tablesift.config import Evaluation
from tablesift.operators import debate, sqlgen, workflow
from tablesift.plans import model_queries, services
from tablesift.plans.model_queries import stand_in, stand_ins
from tablesift.sources import models


def test_answers_are_asked_once_and_joined(spark, tmp_path):
    rows = [(i, None if i % 7 == 0 else f"prompt {i % 5}", i % 2, "x") for i in range(70)]
    df = spark.createDataFrame(rows, "id int, prompt string, seed int, error_ string")
    with stand_in(spark, lambda prompt, seed: f"{prompt}/{seed}") as (endpoint, asked):
        got = models.answers(df, endpoint, f"{tmp_path}/store").collect()
        assert len(got) == 70 and all(r.reply == (None if r.prompt is None else f"{r.prompt}/{r.seed}") and r.error is None for r in got)
        assert sorted(asked) == sorted([f"prompt {i}" for i in range(5)] * 2)  # each once for either seed, though calls failed
        assert all(r.tokens_in == 2 for r in got if r.prompt)
        more = df.unionByName(spark.createDataFrame([(99, "new", 0, "")], df.schema))
        assert len(models.answers(more, endpoint, f"{tmp_path}/store").collect()) == 71 and asked[10:] == ["new"]
        other = dataclasses.replace(endpoint, temperature=0.5)
        models.answers(df.limit(2), other, f"{tmp_path}/store")
        assert len(asked) == 12  # another temperature is another question


def test_what_fails_for_good_is_reported_and_asked_again(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, prompt string")
    with stand_in(spark, lambda prompt, seed: "fine", fail_every=1) as (endpoint, _):
        got = models.answers(df, dataclasses.replace(endpoint, tries=2), f"{tmp_path}/store").collect()
        assert [r.reply for r in got] == [None, None] and {r.error for r in got} == {"HTTP 503"}
    gone = models.answers(df, dataclasses.replace(endpoint, tries=2), f"{tmp_path}/store").collect()
    assert all(r.reply is None and "Error" in r.error for r in gone)
    with stand_in(spark, lambda prompt, seed: "fine") as (endpoint, asked):
        assert [r.reply for r in models.answers(df, endpoint, f"{tmp_path}/store").collect()] == ["fine", "fine"] and sorted(asked) == ["a", "b"]
    assert models.ask_all(spark, [], endpoint, f"{tmp_path}/store") == []


def test_a_wrong_request_is_not_repeated():
    assert models.call(models.Endpoint("http://127.0.0.1:1/none", "m", tries=2, wait=0.0), "x", 0)[3].startswith("URLError")


def test_a_batch_waits_once_an_attempt_and_keeps_its_connections(spark, monkeypatch):
    waits, accepted = [], []
    monkeypatch.setattr(models, "time", types.SimpleNamespace(sleep=waits.append))
    accept = services.ThreadingHTTPServer.get_request
    monkeypatch.setattr(services.ThreadingHTTPServer, "get_request", lambda self: accepted.append(0) or accept(self))
    endpoint = stand_ins(spark, lambda prompt, seed: f"{prompt}/{seed}")
    with models.calls(endpoint) as ask:
        for n in (3000, 1, 0):  # a third fails, then a third of these, ...: none for good
            assert ask([(f"p{i}", i % 2) for i in range(n)]) == [(f"p{i}/{i % 2}", 1, 1, None) for i in range(n)]
    assert len(waits) < 2 * endpoint.tries and 0 < len(accepted) <= endpoint.at_once


def test_a_connection_closed_while_idle_is_opened_anew():
    with services.listen(lambda path, sent: (200, {"sent": sent, "path": path})) as port:
        line = models.Line(f"http://127.0.0.1:{port}/a?b=c", 5.0)
        for n in range(3):
            assert json.loads(line.post(b"[1]", {})[2]) == {"sent": [1], "path": "/a?b=c"}
            [kept] = line.open.values()
            kept.sock.shutdown(2)
        line.close()


def test_the_debate_sends_no_prompt_through_the_driver(spark, monkeypatch):
    def none(*_):
        raise AssertionError("a service on the driver's host")

    monkeypatch.setattr(model_queries, "serve", none)
    assert model_queries.debate_over_http(spark, "/root/testdata/sf0.001").count() > 0


def test_debate_by_rounds_equals_the_debate_in_tasks(spark, tmp_path):
    prompts = spark.createDataFrame([(i, "p" * (i % 13)) for i in range(40)], "pair_id long, prompt string")
    settings = Evaluation(solvers=3, rounds=3)

    def model(prompt, solver, number, others):
        return f"Answer: {(len(prompt) * (solver + 1)) % 11}" if number == 0 else "Answer: " + str(sum(int(x.split()[-1]) for x in others) % 11)

    def reply(prompt, seed):
        base, _, others = prompt.partition("\n\nOther solvers answered:\n")
        return model(base, seed, int(bool(others)), [x[2:] for x in others.split("\n") if x.startswith("- ")])

    with stand_in(spark, reply) as (endpoint, asked):
        got = debate.replies_by_rounds(prompts, lambda rows: models.answers(rows, endpoint, f"{tmp_path}/s"), settings)
        n = len(asked)
        again = debate.replies_by_rounds(prompts, lambda rows: models.answers(rows, endpoint, f"{tmp_path}/s"), settings)
        assert len(asked) == n  # the second run is answered by the store
    want = debate.replies(prompts, model, settings)
    shown = lambda df: sorted(map(tuple, df.select("pair_id", "round", "solver", "reply").collect()))
    assert shown(got) == shown(want) == shown(again) and len(shown(got)) == 40 * 9
    pairs = spark.createDataFrame([("a", "b", 0, i) for i in range(4)], "r_rsc_id string, s_rsc_id string, r_col_id int, s_col_id int")
    prompt = F.repeat(F.lit("p"), F.col("s_col_id"))
    with stand_in(spark, reply) as (endpoint, _):
        scored = workflow.evaluate(pairs, prompt, settings=settings, ask=lambda rows: models.answers(rows, endpoint, f"{tmp_path}/s"))
    assert sorted((r.s_col_id, r.score) for r in scored.collect()) == sorted((r.s_col_id, r.score) for r in workflow.evaluate(pairs, prompt, model, settings).collect())


def test_queries_are_revised_in_rounds(spark, tmp_path):
    t = {"R": spark.createDataFrame([(1, "a"), (2, "b")], "k int, name string")}

    def reply(prompt, seed):
        if prompt.startswith("Review"):
            good = "name" in prompt.split("Query:")[1]
            return json.dumps({"correctness": "?", "approval": "approve" if good else "reject", "suggested_changes": "show the name"})
        if "never" in prompt:
            return "SELEC"
        return "SELECT name FROM R" if "show the name" in prompt else "```sql\nSELECT k FROM R\n```"

    with stand_in(spark, reply) as (endpoint, asked):
        made = sqlgen.generate_all([sqlgen.Work("the first", t), sqlgen.Work("never right", t)], lambda x: models.ask_all(spark, x, endpoint, f"{tmp_path}/s"), 2)
    assert [(m.sql, m.success, m.revisions) for m in made] == [("SELECT name FROM R", True, 1), ("FAILURE: SELEC", False, 2)]
    assert made[0].tokens_in > 0 and "SYNTAX" in made[1].review and sqlgen.generate_all([], lambda x: []) == []
    assert sqlgen.read_review("no json") == (False, "The review was not JSON.") and sqlgen.read_review("[1]")[0] is False
