"""Exactly-once appends, the growing dictionary, and the portal as a stream."""

import json

import pytest

from tablesift.operators import dictionary, lake
from tablesift.plans.services import portal_service
from tablesift.sources import commits, files, portal


def rows(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_a_batch_counts_once_and_a_dead_one_never(spark, tmp_path):
    path = f"{tmp_path}/stage"
    assert files.read_stage(spark, path, "value string").count() == 0
    assert files.write_stage(rows(spark, "a", "b"), path, "one") and not files.write_stage(rows(spark, "a", "b"), path, "one")

    def dies(df, folder):
        df.write.option("header", True).csv(folder)
        raise OSError("lost")

    with pytest.raises(OSError):
        commits.append(rows(spark, "x"), path, dies, "two")
    assert sorted(r.value for r in files.read_stage(spark, path, "value string").collect()) == ["a", "b"]
    assert files.write_stage(rows(spark, "x"), path, "two") and files.write_stage(rows(spark, "y"), path) and files.write_stage(rows(spark, "y"), path)
    assert sorted(r.value for r in files.read_stage(spark, path, "value string").collect()) == ["a", "b", "x", "y", "y"]
    assert [x["version"] for x in commits.log(spark, path)] == [0, 1, 2, 3]


def test_two_writers_at_once(spark, tmp_path):
    path = f"{tmp_path}/t"
    plain = lambda df, folder: df.write.parquet(folder)

    def slow(df, folder):  # while this one writes, another commits
        plain(df, folder)
        assert commits.append(rows(spark, "other"), path, plain, "other")

    assert commits.append(rows(spark, "mine"), path, slow, "mine")
    assert [x["batch"] for x in commits.log(spark, path)] == ["other", "mine"]
    with pytest.raises(commits.Conflict):
        commits.append(rows(spark, "late"), path, plain, "late", expect=1)

    def same(df, folder):
        plain(df, folder)
        commits.append(rows(spark, "again"), path, plain, "again")

    assert not commits.append(rows(spark, "again"), path, same, "again")  # the other one was first
    assert sorted(r.value for r in spark.read.parquet(*commits.folders(spark, path)).collect()) == ["again", "mine", "other"]


def test_the_dictionary_keeps_its_ids(spark, tmp_path):
    path = f"{tmp_path}/words"
    first = {r.value: r.id for r in dictionary.grow(rows(spark, "b", "a", "b", None), path, "1").collect()}
    assert first == {"a": 0, "b": 1}
    many = [f"v{i}" for i in range(500)]
    for _ in range(2):
        words = dictionary.grow(rows(spark, "a", *many), path, "2")
        got = {r.value: r.id for r in words.collect()}
        assert sorted(got.values()) == list(range(502)) and got["a"] == 0 and got["b"] == 1
    assert {r.value: r.id for r in dictionary.grow(rows(spark, "a", "b"), path, "3").collect()} == got  # nothing new
    cells = rows(spark, "v7", "a", "v7").selectExpr("0 as k", "value")
    assert sorted(r.value for r in lake.decode(dictionary.encode(cells, words), words).collect()) == ["a", "v7", "v7"]


def test_a_faster_writer_makes_the_dictionary_start_again(spark, tmp_path, monkeypatch):
    path, real = f"{tmp_path}/words", commits.append
    hurried = []

    def append(df, where, write, batch=None, expect=None, **more):
        if batch == "mine" and not hurried:
            hurried.append(dictionary.grow(rows(spark, "x", "y"), path, "theirs"))
        return real(df, where, write, batch, expect, **more)

    monkeypatch.setattr(dictionary.commits, "append", append)
    got = {r.value: r.id for r in dictionary.grow(rows(spark, "y", "z"), path, "mine").collect()}
    assert got == {"x": 0, "y": 1, "z": 2}


def test_offsets_of_the_portal_stream(spark):
    p = lambda name, time: {"id": name, "metadata_modified": time}
    packages = [p("a", "1"), p("b", "2"), p("c", "2")]

    def take(reader, start, end):
        return [name for part in reader.partitions(start, end) for name, _ in reader.read(part)]

    with portal_service(spark, packages) as url:
        reader = portal.PortalStream({"url": url, "page": "2"})
        zero = reader.initialOffset()
        one = json.loads(json.dumps(reader.latestOffset()))
        assert take(reader, zero, one) == ["a", "b", "c"] and reader.latestOffset() == one and take(reader, one, one) == []
        packages += [p("d", "2"), p("e", "3"), p("f", "3"), p("g", "4")]  # one more of the last time
        packages[0] = p("a", "5")
        two = reader.latestOffset()
        packages.append(p("h", "5"))  # after the poll
        assert sorted(take(reader, one, two)) == ["a", "d", "e", "f", "g"]
        assert take(reader, two, reader.latestOffset()) == ["h"]
        assert sorted(take(reader, zero, one)) == ["b", "c"]  # a batch that is read again lacks only what was changed since
    with portal_service(spark, []) as url:
        reader = portal.PortalStream({"url": url})
        assert reader.latestOffset() == reader.initialOffset() and reader.partitions(reader.initialOffset(), reader.latestOffset()) == []
