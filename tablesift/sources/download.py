"""Resources of an open-data portal into a lake of Parquet tables, one for each table found, and a lake from such a folder."""

from __future__ import annotations

import csv
import io
import urllib.request
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from ..operators.lake import Lake
from .files import DELIMITERS, table_names, zip_members

RESULT = "resource_id string, table_name string, n_rows long, n_columns int, status string"
RESULT_ARROW = pa.schema([("resource_id", pa.string()), ("table_name", pa.string()), ("n_rows", pa.int64()), ("n_columns", pa.int32()), ("status", pa.string())])


class TooLarge(Exception):
    pass


def get(url: str, most_bytes: int, timeout: float = 60) -> bytes:
    """The content behind a URL; TooLarge if it says it has more bytes, or has them."""
    with urllib.request.urlopen(url, timeout=timeout) as reply:
        if int(reply.headers.get("Content-Length") or 0) > most_bytes:
            raise TooLarge(url)
        content = reply.read(most_bytes + 1)
    if len(content) > most_bytes:
        raise TooLarge(url)
    return content


def parse_csv(content: bytes) -> pa.Table:
    """A CSV in Latin-1 with any of the usual delimiters: the one that gives the most rows as wide as the header, of at least two columns if
    any does. Ragged rows are dropped, empty cells are null, headers without a name are numbered."""
    if b"DOCTYPE" in content[:100].upper():
        raise ValueError("a web page, not a table")
    text = content.decode("latin-1")
    best: tuple[int, int, list[list[str]]] | None = None
    for delimiter in DELIMITERS:
        head = list(csv.reader(io.StringIO(text[: 1 << 16]), delimiter=delimiter))
        fit = sum(len(r) == len(head[0]) for r in head[1:]) if head else 0
        if head and (best is None or (len(head[0]) > 1, fit) > best[:2]):
            best = (len(head[0]) > 1, fit, delimiter)
    if best is None:
        raise ValueError("no rows")
    rows = csv.reader(io.StringIO(text), delimiter=best[2])
    header = next(rows)
    kept = [r for r in rows if len(r) == len(header)]
    names: list[str] = []
    for i, c in enumerate(header):
        name = c.strip() or f"unnamed_{i}"
        names.append(name if name not in names else f"{name}_{i}")
    columns = [pa.array([r[i] or None for r in kept], pa.string()) for i in range(len(header))]
    return pa.Table.from_arrays(columns, names=names)


def tables_in(resource_id: str, content: bytes) -> list[tuple[str, pa.Table]]:
    """(file name, table) of a resource: one CSV, or, if it doesn't read as one, the CSVs of a zip."""
    if not content.startswith(b"PK\x03\x04"):
        return [(f"{resource_id}.parquet", parse_csv(content))]
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return [(f"{resource_id}{suffix}.parquet", parse_csv(z.read(name))) for name, suffix in zip_members(z.namelist())]


def download(resources: DataFrame, folder: str, most_bytes: int = 1 << 29, fetch: Callable[[str, int], bytes] = get) -> DataFrame:
    """resources: resource_id, url. Fetches each within a task and writes its tables to folder, as gzipped Parquet; gives what became
    of them. A task that is run again writes the same files. A resource that fails, or has more bytes than allowed, leaves no table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for resource, url in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                try:
                    found = tables_in(resource, fetch(url, most_bytes))
                    for name, table in found:
                        pq.write_table(table, f"{root}/{name}", compression="gzip", filesystem=store)
                        rows.append((resource, name, table.num_rows, table.num_columns, "ok"))
                    rows = rows or [(resource, None, None, None, "no table")]
                except TooLarge:
                    rows = [(resource, None, None, None, "too large")]
                except Exception as error:  # one bad resource among many
                    rows = [(resource, None, None, None, f"ERROR: {type(error).__name__}")]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), RESULT_ARROW)], schema=RESULT_ARROW)

    return resources.select("resource_id", "url").mapInArrow(run, RESULT)


def lake_of(spark: SparkSession, folder: str) -> Lake:
    """The tables in a folder."""
    return Lake(spark, {name: spark.read.parquet(f"{folder}/{name}") for name in table_names(spark, folder)})
