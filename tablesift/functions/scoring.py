"""Checks on model replies and generated questions, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bounded(score: Column, least: int, most: int) -> Column:
    """The score if it lies in the bounds, else -1."""
    return F.when(score.between(least, most), score).otherwise(F.lit(-1)).cast("int")


def parse_score(reply: Column, least: int = 0, most: int = 10) -> Column:
    """The number after `answer: ` in a reply, whatever its case; -1 if there is none or it is out of bounds."""
    digits = F.regexp_extract(F.lower(reply), r"answer: (\d+)", 1)
    return bounded(F.coalesce(digits.try_cast("bigint"), F.lit(-1)), least, most)


def succeeded(*outcomes: Column) -> Column:
    """No outcome starts with ERROR or FAILURE."""
    ok = F.lit(True)
    for c in outcomes:
        ok = ok & ~F.startswith(c, F.lit("ERROR")) & ~F.startswith(c, F.lit("FAILURE"))
    return ok


def leaks(question: Column, columns: Column, tables: Column | None = None) -> Column:
    """Whether a question gives the schema away: a column (or table) name in quotes, or one with an underscore anywhere."""
    low = F.lower(question)
    quoted = lambda name: F.contains(low, F.concat(F.lit("'"), F.lower(name), F.lit("'"))) | F.contains(low, F.concat(F.lit('"'), F.lower(name), F.lit('"'))) | F.contains(low, F.concat(F.lit("`"), F.lower(name), F.lit("`")))
    out = F.exists(columns, lambda n: quoted(n) | (F.contains(n, F.lit("_")) & F.contains(low, F.lower(n))))
    return out | F.exists(tables, quoted) if tables is not None else out


def parse_review(reply: Column) -> Column:
    """(approved, correctness, suggested_changes) of a reviewer's JSON; a reply that is no JSON approves nothing."""
    fields = F.from_json(reply, "correctness string, approval string, suggested_changes string")
    approved = F.coalesce(F.lower(F.trim(fields["approval"])) == "approve", F.lit(False))
    return F.struct(approved.alias("approved"), fields["correctness"].alias("correctness"), fields["suggested_changes"].alias("suggested_changes"))
