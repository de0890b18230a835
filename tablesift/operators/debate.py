"""Scoring by debate: several solvers answer, see each other's answers, answer again; the majority decides."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Evaluation
from ..functions.scoring import parse_score
from .stats import majority

#: model(prompt, solver, round, others' answers of the round before) -> reply
Model = Callable[[str, int, int, list[str]], str]


def replies(prompts: DataFrame, model: Model, settings: Evaluation = Evaluation()) -> DataFrame:
    """prompts: pair_id long, prompt string. (pair_id, round, solver, reply): a pair is debated within one task, batch by batch."""
    solvers, rounds = settings.solvers, settings.rounds

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for pair, prompt in zip(batch["pair_id"], batch["prompt"]):
                last: list[str] = []
                for n in range(rounds):
                    last = [model(prompt, i, n, [x for j, x in enumerate(last) if j != i]) for i in range(solvers)]
                    out += [(pair, n, i, x) for i, x in enumerate(last)]
            yield pd.DataFrame(out, columns=["pair_id", "round", "solver", "reply"])

    return prompts.select("pair_id", "prompt").mapInPandas(run, "pair_id long, round int, solver int, reply string")


#: (prompt, seed, more columns) to the same rows with reply
Ask = Callable[[DataFrame], DataFrame]


def round_prompt(prompt: F.Column, others: F.Column) -> F.Column:
    """What a solver is told from the second round on: the prompt, and the others' last replies."""
    return F.concat(prompt, F.lit("\n\nOther solvers answered:\n- "), F.array_join(others, "\n- ", "(no answer)"), F.lit("\n\nConsider their answers, then give yours."))


def replies_by_rounds(prompts: DataFrame, ask: Ask, settings: Evaluation = Evaluation()) -> DataFrame:
    """(pair_id, round, solver, reply) like `replies`, but a round of all pairs is asked at once (see `sources.models.answers`): a service's
    latency is waited for once a round, not once a pair, and a run that is repeated continues where the store ends."""
    solvers = F.explode(F.sequence(F.lit(0), F.lit(settings.solvers - 1)))
    now = prompts.select("pair_id", "prompt", solvers.alias("solver")).withColumns({"base": F.col("prompt"), "seed": F.col("solver")})
    rounds = []
    for n in range(settings.rounds):
        found = ask(now).select("pair_id", "base", "solver", "seed", "reply")
        rounds.append(found.select("pair_id", F.lit(n).alias("round"), "solver", "reply"))
        if n + 1 < settings.rounds:
            group = found.groupBy("pair_id").agg(F.first("base").alias("base"), F.sort_array(F.collect_list(F.struct("solver", "reply"))).alias("all"))  # a row for each solver
            each = group.select("pair_id", "base", "all", solvers.alias("solver"))
            others = F.transform(F.filter("all", lambda x: x["solver"] != F.col("solver")), lambda x: x["reply"])
            now = each.select("pair_id", "base", "solver", F.col("solver").alias("seed"), round_prompt(F.col("base"), others).alias("prompt"))
    return reduce(DataFrame.unionByName, rounds)


def debate_scores(answers: DataFrame, settings: Evaluation = Evaluation()) -> DataFrame:
    """(pair_id, score): the majority of the last round's scores, the lowest of several."""
    last = answers.where(F.col("round") == settings.rounds - 1)
    return majority(last.select("pair_id", parse_score(F.col("reply"), settings.min_score, settings.max_score).alias("score")), ["pair_id"])
