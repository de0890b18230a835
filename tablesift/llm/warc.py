"""WARC archives and their capture index.

Pages are written as WARC/1.1 records, a gzip member each, in the order of URL key and timestamp within each task. Each
archive is then read back from front to back; its index rows, in order as they are, make one run, a file in the shared folder. The runs are
merged with a loser tree, `FAN` at a time, reading each in small pieces: in passes until `FAN` are left, and then a key range per
task into globally ordered capture histories. Only runs and archives that a committed row names are ever
read, so a retried task leaves no trace in the result.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows, materialize, run_dir, slices, small, table

LEAST = 1000
#: Index rows that one task of the last merge takes, about.
MERGE_ROWS = 100_000
#: An archive is closed and the next begun at this size.
ARCHIVE_BYTES = 64 << 20
#: Runs merged at once, rows read of each at once, and sample keys kept of each.
FAN, READ_ROWS, SAMPLES = 64, 1024, 128
ROW = "url_key string, captured string, page_id long, archive string, at long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
ROW_ARROW = pa.schema([(x.split()[0], pa.string() if x.split()[1] == "string" else pa.int64()) for x in ROW.split(", ")])
RUN = "run string, n long, samples array<struct<url_key:string,captured:string,known:boolean,page_id:long>>"


def url_key(url: Column) -> Column:
    """Sort-friendly key: host labels reversed and comma-joined, then the path; scheme, `www.`, port and fragment go."""
    rest = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?(?:www\.)?|#.*$", "")
    host = F.regexp_replace(F.regexp_extract(rest, r"^([^/?]*)", 1), r":\d*$", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_extract(rest, r"^[^/?]*(.*)$", 1))


def record(page_id: int | None, url: str, key: str, captured: str, payload: bytes, digest: str, refers: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit keeps the HTTP header (with the full length) and leaves out the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:capture:{page_id}>", f"WARC-Date: {captured}",
        f"WARC-Target-URI: {url}", f"Url-Key: {key}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:capture:{refers}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _capture(value: str) -> int | None:
    name = value.removeprefix("<urn:capture:").removesuffix(">")
    return None if name == "None" else int(name)


def parse(raw: bytes) -> dict:
    """Reads one record; the payload of a response is held against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    field = {k: v.removeprefix(" ") for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(field["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(http.decode().rpartition("Content-Length: ")[2].split("\r\n")[0])
    digest = base64.b32decode(field["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = field["WARC-Type"]
    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {field['WARC-Record-ID']}")
    return {
        "page_id": _capture(field["WARC-Record-ID"]), "payload_bytes": length, "payload_digest": digest, "record_type": kind,
        "refers_to": _capture(field["WARC-Refers-To"]) if kind == "revisit" else None, "url": field["WARC-Target-URI"], "url_key": field["Url-Key"], "captured": field["WARC-Date"],
    }


def loser_tree_merge(runs: list[Iterable], key) -> Iterator:
    """Merges sorted runs. tree[1:] holds the loser of each inner node, tree[0] the winner; ties go to the earlier run."""
    k = len(runs)
    if not k:
        return
    heads = [iter(r) for r in runs]
    end = (1, None, k)
    now = [next(h, None) for h in heads]
    keys = [end if x is None else (0, key(x), i) for i, x in enumerate(now)]
    tree = [0] * k

    def build(node: int) -> int:
        if node >= k:
            return node - k
        a, b = build(2 * node), build(2 * node + 1)
        lose, win = (a, b) if keys[b] < keys[a] else (b, a)
        tree[node] = lose
        return win

    tree[0] = build(1) if k > 1 else 0
    while keys[tree[0]][0] == 0:
        win = tree[0]
        yield now[win]
        now[win] = next(heads[win], None)
        keys[win] = end if now[win] is None else (0, key(now[win]), win)
        node = (win + k) // 2
        while node >= 1:
            if keys[tree[node]] < keys[win]:
                win, tree[node] = tree[node], win
            node //= 2
        tree[0] = win


def _writer(folder: str, limit: int):
    """Sorted rows to archives; a row (archive) for each."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        context, out, at, names = TaskContext.get(), None, 0, []
        try:
            for batch in slices(batches, 3, 4 << 20):
                for r in batch.to_pylist():
                    if out is None or at >= limit:
                        if out is not None:
                            out.close()
                        names.append(f"{context.partitionId():06d}-{context.taskAttemptId()}-{len(names):04d}.warc.gz")
                        out, at = store.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                    gz = zlib.compressobj(6, wbits=31)
                    raw = record(r["page_id"], r["url"], r["url_key"], r["captured"], (r["html"] or "").encode(), r["digest"], r["refers"], r["revisit"])
                    data = gz.compress(raw) + gz.flush()
                    out.write(data)
                    at += len(data)
        finally:
            if out is not None:
                out.close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["archive"])

    return write


def members(source, most: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each gzip member of a file, read from front to back."""
    at, rest = 0, source.read(most)
    while rest:
        gz, parts, used = zlib.decompressobj(wbits=31), [], 0
        while not gz.eof:
            if not rest:
                raise ValueError("archive ends within a record")
            parts.append(gz.decompress(rest))
            used += len(rest) - len(gz.unused_data)
            rest = gz.unused_data if gz.eof else source.read(most)
        yield at, b"".join(parts)
        at, rest = at + used, rest or source.read(most)


def _order(row: tuple) -> tuple:
    """Sort key of an index row (as in ROW)."""
    return row[0], row[1], row[2] is not None, row[2] or 0, row[3], row[4]


class _RunWriter:
    """Writes one run, and keeps evenly spread keys of it."""

    def __init__(self, store: fs.FileSystem, root: str, name: str):
        self.name, self.n, self.samples, self.every, self.rows = name, 0, [], 1, []
        self.out = pq.ParquetWriter(f"{root}/{name}", ROW_ARROW, filesystem=store, compression="zstd")

    def add(self, row: tuple) -> None:
        if self.n % self.every == 0:
            self.samples.append(_order(row)[:4])
            if len(self.samples) > SAMPLES:
                self.samples, self.every = self.samples[::2], self.every * 2
        self.n += 1
        self.rows.append(row)
        if len(self.rows) == READ_ROWS:
            self._flush()

    def _flush(self) -> None:
        self.out.write_batch(_batch(self.rows, ROW_ARROW), row_group_size=READ_ROWS)
        self.rows = []

    def close(self) -> pa.RecordBatch:
        if self.rows:
            self._flush()
        self.out.close()
        samples = [dict(zip(("url_key", "captured", "known", "page_id"), x)) for x in self.samples]
        return pa.RecordBatch.from_pylist([{"run": self.name, "n": self.n, "samples": samples}], RUN_ARROW)


RUN_ARROW = pa.schema([("run", pa.string()), ("n", pa.int64()), ("samples", pa.list_(pa.struct([("url_key", pa.string()), ("captured", pa.string()), ("known", pa.bool_()), ("page_id", pa.int64())])))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _run_rows(store: fs.FileSystem, path: str, low: tuple | None = None, high: tuple | None = None) -> Iterator[tuple]:
    """Rows of a run with low <= key < high, a row group at a time, from the group where they begin."""
    with store.open_input_file(path) as file:
        run = pq.ParquetFile(file)
        for g in range(run.num_row_groups):
            keys = run.metadata.row_group(g).column(0).statistics
            if keys is not None and keys.has_min_max and (low is not None and keys.max < low[0] or high is not None and keys.min > high[0]):
                continue
            for row in zip(*(c.to_pylist() for c in run.read_row_group(g).columns)):
                key = _order(row)[:4]
                if high is not None and key >= high:
                    return
                if low is None or key >= low:
                    yield row


def _indexer(folder: str):
    """Rows (archive): each is read from front to back into a run."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                run = _RunWriter(store, root, f"{archive}-{TaskContext.get().taskAttemptId()}.run")
                with store.open_input_stream(f"{root}/{archive}", compression=None) as source:
                    for at, raw in members(source):
                        found = parse(raw) | {"archive": archive, "at": at}
                        run.add(tuple(found[name] for name in ROW_ARROW.names))
                yield run.close()

    return read


def _pass(folder: str):
    """Row: the names of some runs, which become one."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for names in batch.column(0).to_pylist():
                run = _RunWriter(store, root, f"merged-{uuid.uuid4().hex}-{TaskContext.get().taskAttemptId()}.run")
                for row in loser_tree_merge([_run_rows(store, f"{root}/{name}") for name in names], _order):
                    run.add(row)
                yield run.close()

    return merge


def _last_pass(folder: str, runs: list[str], bounds: list[tuple]):
    """Row i: the rows of key range i, in order, with their number in it."""
    schema = pa.schema([("part", pa.int64()), ("i", pa.int64()), *ROW_ARROW])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for part in batch.column(0).to_pylist():
                low, high = bounds[part - 1] if part else None, bounds[part] if part < len(bounds) else None
                rows = []
                for i, row in enumerate(loser_tree_merge([_run_rows(store, f"{root}/{name}", low, high) for name in runs], _order)):
                    rows.append((part, i, *row))
                    if len(rows) == READ_ROWS:
                        yield _batch(rows, schema)
                        rows = []
                if rows:
                    yield _batch(rows, schema)

    return merge


def _captured(pages: DataFrame) -> Column:
    """The time of each capture, as text: `captured` (text, date or timestamp), or, where that is null or missing, a time made from page_id."""
    made = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(1 << 31))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    if "captured" not in pages.columns:
        return made
    kind = pages.schema["captured"].dataType
    if isinstance(kind, T.StringType):
        return F.coalesce(F.regexp_replace("captured", r"[\r\n]", ""), made)
    if not isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        raise TypeError(f"captured must be text or a time, not {kind.simpleString()}")
    return F.coalesce(F.date_format("captured", "yyyy-MM-dd'T'HH:mm:ss'Z'"), made)


def capture_histories(pages: DataFrame, least: int = LEAST, folder: str | None = None) -> DataFrame:
    """pages: page_id, url, html, captured (see `_captured`), more or none.

    Writes the archives, merges the index and returns a row per record as read back; `place` is its number, from 0, in the
    order of (url_key, captured, page_id). Null html is an empty payload, null url an empty one; line ends in a url are percent-encoded. Of
    rows with equal payloads of `least` bytes, those with the largest page_id are responses (repeated rows are all
    of them); a null page_id is below any other. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    folder = folder or f"{run_dir(spark)}/warc-{uuid.uuid4().hex}"
    url = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), "html", url_key(url).alias("url_key"), _captured(pages).alias("captured"), F.sha1(F.coalesce("html", F.lit(""))).alias("digest"), F.coalesce(F.octet_length("html"), F.lit(0)).alias("bytes"))
    equal = rows.where(F.col("bytes") >= least).groupBy("digest").agg(F.max("page_id").alias("refers"), F.count("*").alias("n")).where("n > 1").select("digest", "refers", F.lit(True).alias("copied"))
    rows = rows.join(small(materialize(equal, "payloads"), 500_000), "digest", "left")
    revisit = F.coalesce("copied", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("refers"))
    rows = rows.select("page_id", "url", "url_key", "html", "captured", "digest", "refers", revisit.alias("revisit"))
    archives = materialize(rows.sortWithinPartitions("url_key", "captured", "page_id").transform(map_rows, _writer(folder, ARCHIVE_BYTES), "archive string"), "archives")
    count = archives.count()
    made = materialize(archives.repartition(max(1, count)).transform(map_rows, _indexer(folder), RUN), "runs")
    runs = sorted(tuple(r) for r in made.select("run", "n").collect())  # a name per archive; each task gets its own ones
    task_each = lambda n: spark.range(0, n, 1, n)
    while len(runs) > FAN:
        groups = [([name for name, _ in runs[i : i + FAN]],) for i in range(0, len(runs), FAN)]
        made = materialize(spark.createDataFrame(groups, "runs array<string>").repartition(len(groups)).transform(map_rows, _pass(folder), RUN), "runs")
        runs = sorted(tuple(r) for r in made.select("run", "n").collect())
    keys = sorted({tuple(x) for r in made.select("samples").collect() for x in r["samples"]})  # of the last runs alone, at most FAN
    ranges = max(1, min(len(keys), max(-(-sum(n for _, n in runs) // MERGE_ROWS), spark.sparkContext.defaultParallelism)))
    bounds = [keys[len(keys) * i // ranges] for i in range(1, ranges)]
    merged = task_each(ranges).transform(map_rows, _last_pass(folder, [name for name, _ in runs], bounds), f"part long, i long, {ROW}")
    merged = materialize(merged, "histories")
    starts, at = [], 0
    for part, n in sorted(tuple(r) for r in merged.groupBy("part").agg(F.count("*")).collect()):
        starts.append((part, at))
        at += n
    offsets = spark.createDataFrame(starts, "part long, start long")
    return merged.join(F.broadcast(offsets), "part").select((F.col("start") + F.col("i")).alias("place"), *ROW_ARROW.names)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture_histories(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "place")


QUERIES = {"op8_warc_index_merge": op8_warc}
ORACLE = {
    "op8_warc_index_merge": r"""
with p as (select page_id, coalesce(html, '') as html, regexp_replace(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?(?:www\.)?|#.*$', '', 'g') as rest from pages),
d as (select page_id, strlen(html) as n, sha1(html) as digest, strftime(make_timestamp((1700000000 + page_id) * 1000000), '%Y-%m-%dT%H:%M:%SZ') as captured,
  array_to_string(list_reverse(string_split(regexp_replace(regexp_extract(rest, '^([^/?]*)', 1), ':\d*$', ''), '.')), ',') || ')' || regexp_extract(rest, '^[^/?]*(.*)$', 1) as url_key from p),
g as (select digest, max(page_id) as first_id from d where n >= 1000 group by digest)
select d.page_id, cast(d.n as bigint) as payload_bytes, d.digest as payload_digest,
  case when g.first_id is not null and g.first_id <> d.page_id then 'revisit' else 'response' end as record_type,
  case when g.first_id <> d.page_id then g.first_id end as refers_to,
  d.url_key, d.captured, row_number() over (order by d.url_key, d.captured, d.page_id) - 1 as place
from d left join g on d.digest = g.digest and d.n >= 1000
"""
}
