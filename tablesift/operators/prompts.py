"""What a language model is told about a table, and questions made from SQL without one."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..config import Generation
from .profile import create_table_sql, load_table, pin_column, preview


@dataclass(frozen=True)
class TableContext:
    """A table as a prompt shows it: its metadata, the pinned column first, schema text and a few rows."""

    name: str
    column: str
    attributes: dict[str, object]
    schema: str
    rows: str
    columns: tuple[str, ...]

    def text(self) -> str:
        known = "\n".join(f"- {k}: {', '.join(map(str, v)) if isinstance(v, list) else v}" for k, v in self.attributes.items() if v)
        return f"Table {self.name}\n{known}\n\nSchema:\n{self.schema}\n\nRows:\n{self.rows}\n\nColumn of interest: {self.column}"


def table_context(df: DataFrame, name: str, column: str, attributes: dict[str, object], settings: Generation = Generation(), headers: str | None = "complex", elements: str | None = None) -> TableContext:
    from ..functions.text import clean_name

    table = load_table(df, headers, elements)
    pinned = clean_name(column, headers)
    table = pin_column(table, pinned, settings.max_columns)
    notes = {**attributes, "notes": str(attributes.get("notes") or "")[: settings.max_notes]}
    return TableContext(name, pinned, notes, create_table_sql(table, name), preview(table, settings.sample_rows), tuple(table.columns))


def scoring_prompt(r: TableContext, s: TableContext, least: int, most: int) -> str:
    return f"Rate from {least} to {most} how sensible it is to combine these two tables on their columns of interest. End with `Answer: <number>`.\n\n{r.text()}\n\n{s.text()}"


def question_of(sql: str, columns: tuple[str, ...] = ()) -> str:
    """A plain question for a template's SQL: names lose their underscores and quotes, so that the schema doesn't leak."""
    shown = re.sub(r"\s+", " ", sql)
    parts = re.match(r"(?i)select (?P<what>.*?) from (?P<rest>.*)", shown)
    what, rest = (parts["what"], parts["rest"]) if parts else (shown, "")
    out = f"What are {what.lower()} in {rest.lower()}?"
    for name in sorted(columns, key=len, reverse=True):
        out = re.sub(rf"\b{re.escape(name.lower())}\b", name.lower().replace("_", " "), out)
    return re.sub(r"[\"'`_]", " ", out)


def leaks(question: str, columns: tuple[str, ...], tables: tuple[str, ...] = ()) -> bool:
    """The driver-side twin of `functions.scoring.leaks`."""
    low = question.lower()
    quoted = lambda n: any(f"{q}{n.lower()}{q}" in low for q in "'\"`")
    return any(quoted(n) or ("_" in n and n.lower() in low) for n in columns) or any(map(quoted, tables))
