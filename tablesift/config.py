"""Settings of the workflow's stages."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Literal

Mode = Literal["base", "complex"] | None


@dataclass(frozen=True)
class Cleaning:
    headers: Mode = "complex"
    elements: Mode = None


# The defaults below are those of the workflow's published configuration.


@dataclass(frozen=True)
class Crawling:
    accepted_formats: tuple[str, ...] = ("CSV",)
    packages_per_page: int = 10
    max_resource_bytes: int = 1 << 29


@dataclass(frozen=True)
class Indexing:
    cleaning: Cleaning = field(default_factory=lambda: Cleaning("complex", "complex"))
    buckets: int = 64


@dataclass(frozen=True)
class Search:
    budget: int | None = 10
    k: int = 50
    min_height: int = 30
    min_distinct: int = 10
    max_null_ratio: float = 0.2
    accept_same_schema: bool = True
    bad_header_tokens: tuple[str, ...] = ("id", "date", "unnamed")
    min_jaccard: float = 0.2
    min_overlap: float = 0.2
    dedup: bool = True


@dataclass(frozen=True)
class Evaluation:
    min_score: int = 0
    max_score: int = 10
    solvers: int = 3
    rounds: int = 2
    budget: int = 10000


@dataclass(frozen=True)
class Generation:
    levels: tuple[str, ...] = ("simple", "moderate", "challenging")
    types: tuple[str, ...] = ("single", "join", "union")
    max_reviews: int = 3
    min_score: int = 8
    budget: int = 10000
    max_notes: int = 1000
    max_columns: int = 20
    sample_rows: int = 5


@dataclass(frozen=True)
class Limits:
    """What a generated query may use."""

    seconds: float = 60
    #: Pairs of rows (estimated) that a join without equal keys may compare. It also bounds what a cancelled task still does.
    pairs: float = 1e10
    at_once: int = 8
    pool: str = "verification"
