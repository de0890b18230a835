import gzip
import hashlib
import io
import random

import pytest

from tablesift.llm import warc
from tablesift.llm.warc import capture_histories, loser_tree_merge

SCHEMA = "page_id long, url string, html string, digest string, run string"


def test_loser_tree():
    r = random.Random(4)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(r.randrange(50) for _ in range(r.choice([0, 1, 9, 40]))) for _ in range(k)]
        assert list(loser_tree_merge(runs, lambda x: x)) == sorted(x for run in runs for x in run)


def test_round_trip(spark):
    big, long = "é" * 500, "<p>" + "x" * 400000
    rows = [
        (1, "http://b.example.com/x", big, "", ""), (5, "http://www.a.example.com:80/y#z", big, "", ""), (3, None, big, "", ""), (9, "u\r\nv", "é" * 499, "", ""),
        (10, "u", "é" * 499, "", ""), (2, "http://b.example.com/x", None, "", ""), (4, "http://b.example.com/", "", "", ""), (7, "q", long, "", ""), (8, "q", long + "\r\n\r\n", "", ""),
        (None, "n", big, "", ""), (6, "r", "same" * 300, "", ""), (6, "r", "same" * 300, "", ""),
    ]
    out = capture_histories(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = sorted(out.collect(), key=lambda r: r.place)
    assert [r.place for r in got] == list(range(len(rows)))
    assert [(r.url_key, r.captured) for r in got] == sorted((r.url_key, r.captured) for r in got)
    assert {r.page_id: r.url_key for r in got}[5] == "com,example,a)/y"
    want = []
    for page, _, html, *_ in rows:
        data = (html or "").encode()
        same = [p for p, _, h, *_ in rows if (h or "").encode() == data and p is not None]
        revisit = len(data) >= 1000 and page != max(same)
        want.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None))
    assert sorted(map(str, want)) == sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)


def test_many_runs_are_merged_in_passes(spark, monkeypatch):
    monkeypatch.setattr(warc, "FAN", 3)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    r = random.Random(5)
    rows = [(i, f"http://h{r.randrange(4)}.org/{r.randrange(30)}" if i % 3 else "http://hot.org/", f"<p>{i}", "", "") for i in range(900)]
    got = sorted(capture_histories(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect(), key=lambda x: x.place)
    assert [x.place for x in got] == list(range(900)) and sorted(x.page_id for x in got) == list(range(900)) and len({x.archive for x in got}) > 9
    assert [(x.url_key, x.captured, x.page_id) for x in got] == sorted((x.url_key, x.captured, x.page_id) for x in got)


def test_captured(spark):
    rows = [(i, "u", "h", c) for i, c in enumerate(["2024-05-01T00:00:00Z", None, "2023-05-01T00:00:00Z", "x\r\ny", ""])]
    got = {x.page_id: x.captured for x in capture_histories(spark.createDataFrame(rows, "page_id long, url string, html string, captured string")).collect()}
    assert got == {0: "2024-05-01T00:00:00Z", 1: "2023-11-14T22:13:21Z", 2: "2023-05-01T00:00:00Z", 3: "xy", 4: ""}
    times = spark.sql("select 1L as page_id, 'u' as url, 'h' as html, timestamp'2024-01-02 03:04:05' as captured union all select 2L, 'u', 'h', null")
    assert sorted(x.captured for x in capture_histories(times).collect()) == ["2023-11-14T22:13:22Z", "2024-01-02T03:04:05Z"]
    with pytest.raises(TypeError):
        capture_histories(spark.sql("select 1L as page_id, 'u' as url, 'h' as html, 5 as captured"))


def test_members_of_an_archive():
    parts = [b"a" * 10, b"", bytes(range(256)) * 900, b"z"]
    packed = [gzip.compress(p) for p in parts]
    data, starts = b"".join(packed), [sum(map(len, packed[:i])) for i in range(4)]
    for most in (1, 7, 100, 1 << 20):
        assert list(warc.members(io.BytesIO(data), most)) == list(zip(starts, parts))
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(data[:-3])))


def test_empty(spark):
    assert capture_histories(spark.createDataFrame([], SCHEMA)).count() == 0
