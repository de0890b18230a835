"""The corpus pipeline: documents in, a source mix out.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet
and read again as the next one's docs. All but the last return the columns of documents: those that a stage does not change stay as
they are, whatever their names. Null texts go in the first stage; null ids, languages and sources stay what they are; repeated rows
are treated alike until near_dedup leaves one; an empty table stays empty; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablesift.llm.common import materialize, table
from tablesift.llm.decontaminate import without_contaminated
from tablesift.llm.langid import with_known_language
from tablesift.llm.linededup import without_boilerplate
from tablesift.llm.mixing import mix
from tablesift.llm.nearcopies import one_of_each


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of unknown language; lang becomes the predicted one."""
    return with_known_language(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts cross-site boilerplate lines out of all documents but their home; drops documents that had nothing else."""
    return without_boilerplate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of texts with five-word Jaccard similarity of at least 0.8: candidates from the SimHash trie
    join and, beyond its error budget, from MinHash bands; each verified."""
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that share a span with a benchmark item."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mix(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix_sources", mix_sources)]

#: SQL can express neither the trained language model nor the seeded mix; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
