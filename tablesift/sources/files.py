"""Files of a lake: lenient CSV, zips of CSV, Parquet, JSON lines, and the tables the stages exchange."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metadata import PACKAGE
from . import commits

DELIMITERS = ",;\t|"


def sniff(head: str) -> str:
    """The delimiter of a CSV by its first lines."""
    try:
        return csv.Sniffer().sniff(head, DELIMITERS).delimiter
    except csv.Error:
        return max(DELIMITERS, key=head.split("\n")[0].count)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV in Latin-1 with a sniffed delimiter, all columns as strings; malformed rows are dropped. A web page in its place is an error."""
    head = "\n".join(r[0] for r in spark.read.option("encoding", "ISO-8859-1").text(path).limit(20).collect())
    if "DOCTYPE" in head[:100].upper():
        raise ValueError(f"{path} is a web page")
    return spark.read.options(header=True, sep=sniff(head), encoding="ISO-8859-1", mode="DROPMALFORMED", multiLine=True, escape='"').csv(path)


def zip_members(names: list[str]) -> list[tuple[str, str]]:
    """(member, suffix) of the tables in a zip: CSV files that are neither metadata nor French; numbered if several."""
    own = [n for n in names if n.lower().endswith(".csv") and "metadata" not in n.lower() and "fr" not in n.lower()]
    return [(n, f"_{i}" if len(own) > 1 else "") for i, n in enumerate(own)]


def read_zips(spark: SparkSession, path: str, most_bytes: int = 1 << 29) -> DataFrame:
    """(file, table, content) of each CSV in each zip under path; zips over the size limit are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    stem = name.rsplit("/", 1)[-1].removesuffix(".zip")
                    rows = [(name, stem + suffix, z.read(member).decode("latin-1")) for member, suffix in zip_members(z.namelist())]
                yield pd.DataFrame(rows, columns=["file", "table", "content"])

    files = spark.read.format("binaryFile").load(path).where(F.col("length") <= most_bytes)
    return files.select("path", "content").mapInPandas(run, "file string, table string, content string")


def parse_csv_text(spark: SparkSession, content: str) -> DataFrame:
    """A table from a CSV's text."""
    sep = sniff("\n".join(content.split("\n")[:20]))
    rows = list(csv.reader(io.StringIO(content), delimiter=sep))
    width = len(rows[0])
    kept = [r for r in rows[1:] if len(r) == width]
    return spark.createDataFrame([[x or None for x in r] for r in kept], ", ".join(f"`{c.strip() or f'unnamed_{i}'}` string" for i, c in enumerate(rows[0])))


def table_cells(spark: SparkSession, path: str, most_bytes: int = 1 << 29, level: int = -1) -> DataFrame:
    """(table_name, column_id, column_name, value) of all cells of all Parquet and CSV files under path, as text: a lake of any number of
    tables, each with columns of its own, in one scan. A file is read within a task, row group by row group; larger ones than most_bytes
    are left out, and so are files that can't be read as tables. A table is called by its file, or, with level -2, by the folder its files are in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                table = name.split("/")[level]
                for rows in _read_rows(name, content.as_buffer()):
                    for i, (column, values) in enumerate(zip(rows.schema.names, rows.columns)):
                        n = len(values)
                        yield pa.RecordBatch.from_arrays([pa.array([table] * n, pa.string()), pa.array([i] * n, pa.int32()), pa.array([column] * n, pa.string()), values.cast(pa.string())], names=["table_name", "column_id", "column_name", "value"])

    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{parquet,csv}").load(path)
    return found.where(F.col("length") <= most_bytes).select("path", "content").mapInArrow(run, "table_name string, column_id int, column_name string, value string")


def _read_rows(name: str, content: pa.Buffer) -> Iterator[pa.RecordBatch]:
    from pyarrow import csv as arrow_csv
    from pyarrow import parquet

    try:
        if name.endswith(".parquet"):
            yield from parquet.ParquetFile(pa.BufferReader(content)).iter_batches(8192)
            return
        text = content.to_pybytes().decode("latin-1")
        head = text.split("\n", 1)[0]
        names = next(csv.reader([head], delimiter=(sep := sniff("\n".join(text.split("\n")[:20])))))
        kinds = arrow_csv.ConvertOptions(column_types={c: pa.string() for c in names}, strings_can_be_null=True, null_values=[""], quoted_strings_can_be_null=True)
        parse = arrow_csv.ParseOptions(delimiter=sep, newlines_in_values=True, invalid_row_handler=lambda row: "skip")
        yield from arrow_csv.open_csv(pa.BufferReader(text.encode()), parse_options=parse, convert_options=kinds)
    except (pa.ArrowInvalid, StopIteration):
        return


def write_table(df: DataFrame, path: str, compression: str = "gzip") -> None:
    df.write.mode("overwrite").option("compression", compression).parquet(path)


def table_names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the Parquet tables in a folder of any file system, in descending order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return sorted((f.getPath().getName() for f in found if f.getPath().getName().endswith(".parquet")), reverse=True)


def schema_names(spark: SparkSession, path: str) -> list[str]:
    """Column names, from the footer alone."""
    return spark.read.parquet(path).schema.names


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """Package records: of a log of batches those committed, else of the JSON lines at path."""
    known = commits.folders(spark, path)
    return spark.read.schema(PACKAGE).json(known or path)


def append_packages(packages: DataFrame, path: str, batch: str | None = None) -> bool:
    """Appends package records as JSON lines; a batch of one name once."""
    return commits.append(packages, path, lambda df, folder: df.write.json(folder), batch)


def read_stage(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stage's CSV, its committed batches alone: rows that don't fit, and rows with nulls, are dropped."""
    known = commits.folders(spark, path)
    return (spark.read.schema(schema).options(header=True, mode="PERMISSIVE").csv(known) if known else spark.createDataFrame([], schema)).dropna()


def write_stage(df: DataFrame, path: str, batch: str | None = None) -> bool:
    """Appends rows to a stage; a batch of one name once, however often it is written."""
    return commits.append(df, path, lambda rows, folder: rows.write.option("header", True).csv(folder), batch)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def lookup(spark: SparkSession, name: str, values: list[str]) -> DataFrame:
    """Cells of the index table that hold one of the values: only their buckets are read."""
    return spark.table(name).where(F.col("value").isin(values))


def write_index(cells: DataFrame, name: str, buckets: int = 64, path: str | None = None) -> None:
    """The cell index as a table bucketed and sorted by value: later joins on the value need no shuffle, and a lookup reads
    one bucket, in it only row groups whose range and Bloom filter admit the value."""
    out = cells.write.mode("overwrite").bucketBy(buckets, "value").sortBy("value").option("parquet.bloom.filter.enabled#value", "true")
    (out.option("path", path) if path else out).saveAsTable(name)


def index_table(spark: SparkSession, name: str, path: str, buckets: int = 64) -> None:
    """The catalog's entry of an index that grows batch by batch at path; its files may be there already."""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} (table_id INT, column_id INT, row_id BIGINT, value STRING, batch INT) USING parquet OPTIONS ('parquet.bloom.filter.enabled#value' 'true')"
        f" PARTITIONED BY (batch) CLUSTERED BY (value) SORTED BY (value) INTO {buckets} BUCKETS LOCATION '{path}'"
    )


def write_batch(cells: DataFrame, name: str, batch: int, buckets: int = 64) -> None:
    """One batch of an `index_table`, a file for each bucket. A batch that is written again takes the place of its first copy."""
    spark = cells.sparkSession
    rows = cells.select("table_id", "column_id", F.col("row_id").cast("long").alias("row_id"), "value", F.lit(batch).alias("batch"))
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        rows.repartition(buckets, "value").write.insertInto(name, overwrite=True)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
