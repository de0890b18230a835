"""Dates and times: text to time, casts, and differences."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: strptime's letters and Spark's patterns for them.
LETTERS = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS", "p": "a", "b": "MMM", "B": "MMMM", "a": "EEE", "j": "DDD", "%": "%"}


def pattern(strptime: str) -> str:
    """A strptime format as a Spark pattern; other letters are quoted."""

    def part(m: re.Match) -> str:
        if m[1]:
            if m[1] not in LETTERS:
                raise ValueError(f"unknown format letter: %{m[1]}")
            return LETTERS[m[1]]
        return f"'{m[2]}'"

    return re.sub(r"%(.)|([A-Za-z]+)", part, strptime)


def parse_time(c: Column, strptime: str = "%Y-%m-%d %H:%M:%S") -> Column:
    """A time without zone from text; null where it doesn't fit."""
    return F.try_to_timestamp(c, F.lit(pattern(strptime))).cast("timestamp_ntz")


def to_day(c: Column, strptime: str | None = None) -> Column:
    """A column cast to a date: times lose their time of day, text is read by the format (ISO if none); null where that fails."""
    return parse_time(c, strptime).cast("date") if strptime else c.try_cast("date")


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds from start to end."""
    return F.timestamp_diff("SECOND", start, end)
