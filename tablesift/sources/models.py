"""A language model behind HTTP, asked from within tasks, and a store of its answers.

Every prompt is known by a hash of it and of what else decides the answer. `answers` looks prompts up in the store, asks the model for the
others, each distinct one once, writes what it replied to the store, and joins: a rerun asks nothing twice, and of a job that died only
what was not yet written is asked again. Prompts and replies stay distributed.
"""

from __future__ import annotations

import contextlib
import http.client
import json
import threading
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from email.message import Message

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exchange import discard, materialize

REPLY = "key string, reply string, tokens_in long, tokens_out long, error string"
#: HTTP codes after which the same request may succeed.
AGAIN = (408, 409, 425, 429, 500, 502, 503, 504)


@dataclass(frozen=True)
class Endpoint:
    """url takes POSTs in the chat-completions format. At most tasks * at_once requests are under way. Before the second of `tries` attempts
    a task waits `wait` seconds, then twice as long each time, at most `longest`, or as long as the service says. beside: opens a service
    for a task alone, on the task's host, and gives its url; it is asked instead of url."""

    url: str
    model: str
    temperature: float = 0.0
    headers: tuple[tuple[str, str], ...] = ()
    tasks: int = 8
    at_once: int = 4
    tries: int = 6
    wait: float = 0.5
    longest: float = 30.0
    timeout: float = 120.0
    beside: Callable[[], contextlib.AbstractContextManager[str]] | None = None


class Line:
    """Connections to a service that stay open from one request to the next, one for each thread."""

    def __init__(self, url: str, timeout: float):
        self.url, self.timeout, self.to = url, timeout, urllib.parse.urlsplit(url)
        self.path = urllib.parse.urlunsplit(("", "", self.to.path or "/", self.to.query, ""))
        self.direct = self.to.scheme not in urllib.request.getproxies() or bool(urllib.request.proxy_bypass(self.to.netloc))
        self.open: dict[int, http.client.HTTPConnection] = {}

    def post(self, body: bytes, headers: dict[str, str]) -> tuple[int, Message, bytes]:
        """(status, headers, body). What a service closed while it was idle is opened anew."""
        if not self.direct:
            try:
                with urllib.request.urlopen(urllib.request.Request(self.url, body, headers), timeout=self.timeout) as found:
                    return found.status, found.headers, found.read()
            except urllib.error.HTTPError as failure:
                return failure.code, failure.headers, failure.read()
        me = threading.get_ident()
        while True:
            line = self.open.pop(me, None)
            used = line is not None
            if not used:
                line = (http.client.HTTPSConnection if self.to.scheme == "https" else http.client.HTTPConnection)(self.to.hostname, self.to.port, timeout=self.timeout)
                try:
                    line.connect()
                except OSError as failure:
                    raise urllib.error.URLError(failure) from failure
            try:
                line.request("POST", self.path, body, headers)
                found = line.getresponse()
                out = found.status, found.headers, found.read()
            except BaseException as failure:
                line.close()
                if used and isinstance(failure, ConnectionError):
                    continue
                raise
            if found.will_close:
                line.close()
            else:
                self.open[me] = line
            return out

    def close(self) -> None:
        for line in self.open.values():
            line.close()


#: reply, tokens in, tokens out, error
Said = tuple[str | None, int, int, str | None]


def _once(endpoint: Endpoint, line: Line, prompt: str, seed: int) -> tuple[Said, float | None]:
    """What one request gave; the seconds that the service says to wait, 0 if it doesn't say, None if the request need not be sent again."""
    body = json.dumps({"model": endpoint.model, "temperature": endpoint.temperature, "seed": seed, "messages": [{"role": "user", "content": prompt}]}).encode()
    try:
        status, headers, found = line.post(body, {"Content-Type": "application/json", **dict(endpoint.headers)})
        if not 200 <= status < 300:
            after = headers.get("Retry-After", "")
            return (None, 0, 0, f"HTTP {status}"), None if status not in AGAIN else float(after) if after.replace(".", "", 1).isdigit() else 0.0
        out = json.loads(found)
        used = out.get("usage") or {}
        return (out["choices"][0]["message"]["content"], int(used.get("prompt_tokens", 0)), int(used.get("completion_tokens", 0)), None), None
    except (OSError, http.client.HTTPException, ValueError, KeyError, IndexError, TypeError) as failure:
        return (None, 0, 0, f"{type(failure).__name__}: {failure}"[:300]), 0.0


def call_all(endpoint: Endpoint, line: Line, pool: ThreadPoolExecutor, asked: list[tuple[str, int]]) -> list[Said]:
    """What came for each (prompt, seed). An answer that can't be read is tried again like one that didn't come. What is to be tried again
    waits until the others were asked, so a batch waits once before each attempt, not once for each of its requests."""
    said: list[Said] = [(None, 0, 0, "never asked")] * len(asked)
    left = list(range(len(asked)))
    for n in range(endpoint.tries):
        after: list[float] = []
        again = []
        for i, (what, pause) in zip(left, pool.map(lambda i: _once(endpoint, line, *asked[i]), left)):
            said[i] = what
            if pause is not None:
                again.append(i)
                after.append(pause or endpoint.wait * 2**n)
        left = again
        if not left or n + 1 == endpoint.tries:
            break
        time.sleep(min(endpoint.longest, max(after)))
    return said


@contextlib.contextmanager
def calls(endpoint: Endpoint) -> Iterator[Callable[[list[tuple[str, int]]], list[Said]]]:
    """call_all over connections that stay open in between, to the endpoint's service or one of the task's own."""
    with endpoint.beside() if endpoint.beside else contextlib.nullcontext(endpoint.url) as url, ThreadPoolExecutor(endpoint.at_once) as pool:
        line = Line(url, endpoint.timeout)
        try:
            yield lambda asked: call_all(endpoint, line, pool, asked)
        finally:
            line.close()


def call(endpoint: Endpoint, prompt: str, seed: int) -> Said:
    """One prompt's reply."""
    with calls(endpoint) as ask:
        return ask([(prompt, seed)])[0]


def answers(prompts: DataFrame, endpoint: Endpoint, store: str) -> DataFrame:
    """prompts: prompt, seed (an int; draws of one prompt differ by it) or none, more columns or none. They, with reply, tokens_in,
    tokens_out and error, one row for each of their rows. What the model did not answer has a null reply and the error, is not
    stored, and so is asked again next time. A null prompt is not asked."""
    spark = prompts.sparkSession
    seed = F.coalesce(F.col("seed"), F.lit(0)).cast("int") if "seed" in prompts.columns else F.lit(0)
    asked = F.sha2(F.to_json(F.struct(F.lit(endpoint.model).alias("m"), F.lit(endpoint.temperature).alias("t"), seed.alias("s"), F.col("prompt").alias("p"))), 256)
    keyed = prompts.withColumn("_key", F.when(F.col("prompt").isNotNull(), asked))
    once = keyed.where("_key is not null").groupBy("_key").agg(F.first("prompt").alias("prompt"), F.first(seed).alias("seed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with calls(endpoint) as ask:
            for batch in batches:
                keys, texts, seeds = (batch.column(i).to_pylist() for i in range(3))
                found = ask(list(zip(texts, seeds)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((keys, *(zip(*found) if found else [[]] * 4)), (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["key", "reply", "tokens_in", "tokens_out", "error"])

    missing = once.join(stored(spark, store).select(F.col("key").alias("_key")), "_key", "left_anti")
    new = materialize(missing.repartition(endpoint.tasks, "_key").mapInArrow(run, REPLY))
    new.where("reply is not null").coalesce(endpoint.tasks).write.mode("append").parquet(store)
    failed = materialize(new.where("reply is null"))
    discard(new)
    known = stored(spark, store).unionByName(failed).withColumnRenamed("key", "_key")
    out = materialize(keyed.join(known, "_key", "left").drop("_key"))  # the store grows: Spark takes two readings of one folder for the same
    discard(failed)
    return out


def stored(spark: SparkSession, store: str) -> DataFrame:
    """The answers in a store, one for each key; none if it isn't there yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], REPLY)
    return spark.read.schema(REPLY).parquet(store).groupBy("key").agg(F.min_by(F.struct("reply", "tokens_in", "tokens_out", "error"), "reply").alias("x")).select("key", "x.*")


@dataclass(frozen=True)
class Reply:
    text: str | None
    tokens_in: int
    tokens_out: int
    error: str | None


def ask_all(spark: SparkSession, texts: list[str], endpoint: Endpoint, store: str) -> list[Reply]:
    """Replies to a list of prompts that the driver holds anyway, in its order."""
    rows = answers(spark.createDataFrame(list(enumerate(texts)), "place int, prompt string"), endpoint, store).collect() if texts else []
    return [Reply(r["reply"], r["tokens_in"] or 0, r["tokens_out"] or 0, r["error"]) for r in sorted(rows, key=lambda r: r["place"])]
