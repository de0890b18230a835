"""What the training-data operators share: table access, intermediate tables, row keys, exact numpy helpers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Maps A-Z to a-z and leaves every other byte, so UTF-8 sequences stay whole.
ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

#: ASCII_LOWER, and every ASCII byte outside [0-9a-z] becomes a space: splitting the outcome gives
#: the words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the lower-cased text.
WORD_BYTES = bytes(
    b if b > 0x7F or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own_dir: list[str] = []
_run_dirs: dict[str, object] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``. Where that is unset, a temporary one, for local
    masters alone: on a cluster every host would write to its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _own_dir:
            _own_dir.append(tempfile.mkdtemp(prefix="tablesift-"))
            atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
        base = f"file://{_own_dir[0]}"
    return base.rstrip("/") if "://" in base else f"file://{os.path.abspath(base)}"


def run_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one. What is not discarded before goes when the driver ends, or by `clear`."""
    path = f"{shared_dir(spark)}/tablesift/{spark.sparkContext.applicationId}"
    if path not in _run_dirs:
        _run_dirs[path] = spark.sparkContext
        atexit.register(_delete, spark.sparkContext, path)
    return path


def _delete(context, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone
        jpath = context._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(context._jsc.hadoopConfiguration() if context._jsc else context._jvm.org.apache.hadoop.conf.Configuration()).delete(jpath, True)


def clear(spark: SparkSession) -> None:
    """Deletes all this application's intermediate tables and archives; results not yet written can't be read after that."""
    _delete(spark.sparkContext, run_dir(spark))


#: With this setting Spark deletes an execution's shuffle files when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: lineage ends here, and a lost
    executor costs no recomputation of what came before. The shuffle files of the way there go at once."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _cleaning(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tablesift_path = path
    return out


def bucketed(df: DataFrame, by: str, name: str) -> DataFrame:
    """Like `materialize`, dealt out by a column into as many buckets as shuffles have partitions: joins and aggregations by this
    column move only the other side."""
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table_name = f"tablesift_{name}_{uuid.uuid4().hex}"
    path = f"{run_dir(spark)}/{table_name}"
    with _cleaning(spark):
        dealt = df.repartition(buckets, by).write.bucketBy(buckets, by).option("path", path).option("compression", "zstd")
        dealt.format("parquet").saveAsTable(table_name)
    out = spark.table(table_name)
    out._tablesift_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes materialized tables that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_tablesift_path", None):
            _delete(df.sparkSession.sparkContext, path)


def row_key(id_col: Column, text: Column) -> Column:
    """128 bits for a document, a struct of two longs: rows with the same id and text share it, and then all results too."""
    parts = (id_col.isNull(), id_col, text.isNull(), text)
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(7), *parts).alias("b"))


#: Type of a row_key.
KEY = "struct<a:bigint,b:bigint>"


def unused(df: DataFrame, *names: str) -> list[str]:
    """For each name one that no column of df has, however it is capitalised."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def columns(df: DataFrame, leave: tuple[str, ...] = ()) -> list[Column]:
    """df's columns as expressions, whatever characters their names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c not in leave]


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, marked for broadcast if it has at most so many rows; else a shuffle join takes place.
    df must be cheap to count (materialized)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def without_rows(docs: DataFrame, gone: DataFrame, rows: int = 500_000) -> DataFrame:
    """docs without the rows that have one of the keys in gone (key: distinct row_keys; materialized)."""
    key, drop = unused(docs, "key", "gone")
    keyed = docs.select(*columns(docs), row_key(F.col("doc_id"), F.col("text")).alias(key))
    kept = keyed.join(small(gone.select(F.col("key").alias(drop)), rows), F.col(key) == F.col(drop), "left_anti")
    return kept.select(*columns(docs))


def one_per_group(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs with one row left of each group: that of the smallest doc_id (a null one only if there is no other). rows: doc_id, key,
    group for each row of docs. Only the members of groups of several are looked up again; repeated rows are dropped too."""
    several = rows.groupBy("group").agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("one")).where("n > 1")
    several = materialize(several.select("group", F.col("one.key").alias("one")), "several")
    members = rows.join(several, "group").select("key", "one")
    gone = materialize(members.where("key <> one").select("key").distinct(), "gone")
    repeated = materialize(members.where("key = one").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "repeated")
    discard(several)
    kept = without_rows(docs, gone)
    if repeated.limit(1).count():
        key, of = unused(docs, "key", "of")
        keyed = kept.select(*columns(docs), row_key(F.col("doc_id"), F.col("text")).alias(key))
        again = small(repeated.select(F.col("key").alias(of)), 500_000)
        once = keyed.join(again, F.col(key) == F.col(of), "left_semi").dropDuplicates([key])
        kept = keyed.join(again, F.col(key) == F.col(of), "left_anti").union(once).select(*columns(docs))
    return kept


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """`work` for mapInArrow; afterwards the worker, which Spark keeps for later tasks, gives its free memory back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return run


def map_rows(df: DataFrame, work: Callable, schema) -> DataFrame:
    """mapInArrow, tidied up after, in batches of at most a thousand rows (texts are long) unless the session asks for fewer."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1000:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return df.mapInArrow(tidy(work), schema)


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a piece holds about `most` bytes of the given column, or one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        part = (np.cumsum(size) - size) // most
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(a, b - a)


def joined(batch_column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column in one array, and the offsets of its rows (n + 1 of them)."""
    texts = byte_texts(batch_column)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    return np.frombuffer(b"".join(texts), dtype=np.uint8), np.concatenate([[0], ends]).astype(np.int64)
