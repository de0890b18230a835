"""String functions that define what equal cells and headers are, as Column expressions with driver-side twins."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Mode

#: These become underscores in complex cleaning.
TO_UNDERSCORE = "\n \\\"()[]"


@cache
def _ascii_forms() -> tuple[str, str, dict[str, str]]:
    """By the rule NFKD without what isn't ASCII: characters with a one-letter form and these letters, and those with longer ones."""
    one, letters, longer = [], [], {}
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        if 0xD800 <= code <= 0xDFFF:
            continue
        form = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode()
        if len(form) == 1 and code <= 0xFFFF:
            one.append(char)
            letters.append(form)
        elif form:
            longer[char] = form
    return "".join(one), "".join(letters), longer


def underscore(c: Column) -> Column:
    """CamelCase and hyphens to lower-case words with underscores."""
    c = F.regexp_replace(c, r"([A-Z]+)([A-Z][a-z])", "$1_$2")
    c = F.regexp_replace(c, r"([a-z\d])([A-Z])", "$1_$2")
    return F.lower(F.translate(c, "-", "_"))


def to_ascii(c: Column) -> Column:
    """NFKD, then only its ASCII characters. Texts of ASCII alone skip all of it, those with accented Latin letters take one
    small translation, and only others (ligatures, full-width forms and so on) the tables for all of Unicode."""
    one, letters, longer = _ascii_forms()
    latin = [i for i, x in enumerate(one) if x <= "\u024f"]
    listed = lambda x: F.split(F.lit("\x01".join(x)), "\x01")  # noqa: E731  (folded into one literal when planned)
    table = F.map_from_arrays(listed(longer), listed(longer.values()))
    spelled = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.try_element_at(table, x), x)), "")
    hard = c.rlike("[^\\x00-\\u024F]") | c.rlike(_class(x for x in longer if x <= "\u024f"))
    form = F.when(hard, F.translate(spelled, one, letters)).otherwise(F.translate(c, "".join(one[i] for i in latin), "".join(letters[i] for i in latin)))
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(F.regexp_replace(form, "[^\\x00-\\x7F]", ""))


def _class(chars) -> str:
    """A regex class of the characters, as ranges."""
    codes, parts, i = sorted(map(ord, chars)), [], 0
    while i < len(codes):
        j = i
        while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1:
            j += 1
        parts.append(f"\\x{{{codes[i]:X}}}" + (f"-\\x{{{codes[j]:X}}}" if j > i else ""))
        i = j + 1
    return "[" + "".join(parts) + "]"


def clean(c: Column, mode: Mode = "complex") -> Column:
    """None: the value as a string; base: lower case; complex: underscored, ASCII, without brackets, quotes and spaces.
    A null stays null."""
    c = c.cast("string")
    if mode is None:
        return c
    if mode == "base":
        return F.lower(c)
    if mode != "complex":
        raise ValueError(f"unknown cleaning mode: {mode}")
    c = F.translate(to_ascii(underscore(c)), TO_UNDERSCORE, "_" * len(TO_UNDERSCORE))
    return F.regexp_replace(c, r"^[\t\r\x0B\f\x1C-\x1F ]+|[\t\r\x0B\f\x1C-\x1F ]+$", "")


def clean_name(s: str, mode: Mode = "complex") -> str:
    """`clean` for a header, on the driver."""
    if mode is None:
        return s
    if mode == "base":
        return s.lower()
    if mode != "complex":
        raise ValueError(f"unknown cleaning mode: {mode}")
    s = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", s)
    s = re.sub(r"([a-z\d])([A-Z])", r"\1_\2", s, flags=re.ASCII).replace("-", "_").lower()
    s = unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode()
    return "".join("_" if x in TO_UNDERSCORE else x for x in s).strip()


def clean_names(names: list[str], mode: Mode = "complex") -> list[str]:
    """Cleaned headers; one that another has already taken gets a number."""
    out: list[str] = []
    for name in (clean_name(n, mode) for n in names):
        new, i = name, 1
        while new in out:
            new, i = f"{name}_{i}", i + 1
        out.append(new)
    return out


def is_num(c: Column) -> Column:
    """Whether the value reads as a number once commas and dots are out and percent signs are blanks."""
    bare = F.translate(F.translate(c.cast("string"), ",.", ""), "%", " ")
    return bare.rlike(r"(?i)^[\s\x1C-\x1F]*[+-]?(\d+(_\d+)*(e[+-]?\d+(_\d+)*)?|inf|infinity|nan)[\s\x1C-\x1F]*$")


def strip_tags(c: Column, longest: int) -> Column:
    """Tags, line breaks and tabs to blanks, then the first `longest` characters; null as empty."""
    return F.substring(F.regexp_replace(F.coalesce(c, F.lit("")), r"(<[^>]+>)|\n|\r|\t", " "), 1, longest)


def resource_id(file_name: Column) -> Column:
    """The resource behind a lake file: without the number of a zip member and the extension."""
    return F.regexp_replace(file_name, r"(_\d+)?\.parquet$", "")


def error_class(c: Column) -> Column:
    """The first words of an error message, up to `Error` if it has that."""
    return F.regexp_extract(c, r"(\w+ Error|[\w ,]+)", 1)
