import io
import json
import zipfile

import pytest

from tablesift.operators import lake, search
from tablesift.sources import files, portal
from tablesift.streaming.index import append_cells


def test_lenient_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("id;naïve\n1;é\n2;x\n".encode("latin-1"))
    df = files.read_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["id", "naïve"] and [tuple(r) for r in df.collect()] == [("1", "é"), ("2", "x")]
    (tmp_path / "b.csv").write_text("<!DOCTYPE html><p>")
    with pytest.raises(ValueError):
        files.read_csv(spark, str(tmp_path / "b.csv"))


def test_zips(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "r1.zip", "w") as z:
        for name in ("one.csv", "two.csv", "metadata.csv", "data_fr.csv", "read.txt"):
            z.writestr(name, f"a,b\n1,{name}\n")
    rows = {r.table: r.content for r in files.read_zips(spark, f"{tmp_path}/*.zip").collect()}
    assert set(rows) == {"r1_0", "r1_1"}
    assert files.parse_csv_text(spark, rows["r1_1"] + "bad\n,x\n").collect()[0].b == "two.csv"


def test_tables_and_stages(spark, tmp_path):
    files.write_table(spark.range(3), f"{tmp_path}/t1.parquet")
    files.write_table(spark.range(3).toDF("x"), f"{tmp_path}/t2.parquet")
    assert files.table_names(spark, str(tmp_path)) == ["t2.parquet", "t1.parquet"] and files.schema_names(spark, f"{tmp_path}/t2.parquet") == ["x"]
    for rows in ([(1, "a")], [(2, None)]):
        files.write_stage(spark.createDataFrame(rows, "score int, name string"), f"{tmp_path}/stage")
    assert [tuple(r) for r in files.read_stage(spark, f"{tmp_path}/stage", "score int, name string").collect()] == [(1, "a")]
    (tmp_path / "p.jsonl").write_text(json.dumps({"id": "p", "resources": [{"id": "r", "format": "CSV"}]}) + "\n")
    packages = files.read_packages(spark, f"{tmp_path}/p.jsonl")
    files.append_packages(packages, f"{tmp_path}/out")
    files.append_packages(packages, f"{tmp_path}/out")
    assert files.read_packages(spark, f"{tmp_path}/out").count() == 2


def test_portal_pages():
    assert portal.pages(0, 25, 10, 23) == [(0, 10), (10, 10), (20, 3)] and portal.pages(30, 20, 10) == [] and portal.range_name("CAN", 0, 9) == "CAN_from0_to9"
    calls = []

    def get(url):
        calls.append(url)
        return {"result": {"count": 12, "results": [{"id": url[-6:]}]}}

    reader = portal.PortalReader({"url": "http://x/", "page": "5"}, get)
    parts = reader.partitions()
    assert [(p.start, p.rows) for p in parts] == [(0, 5), (5, 5), (10, 2)]
    assert list(reader.read(parts[2]))[0][0] == "rows=2"


def test_bucketed_index(spark, tmp_path):
    cells = lake.long_cells(spark.createDataFrame([("t1", "x"), ("t2", "x"), ("t2", "y")], "t string, v string"), "t", "v")
    spark.sql("drop table if exists cell_index_test")
    files.write_index(cells, "cell_index_test", 4)
    back = spark.table("cell_index_test")
    assert back.count() == 3 and search.overlaps(search.columns_of(back)).count() == 1
    spark.sql("drop table cell_index_test")


def test_streamed_index_equals_the_batch_one(spark, tmp_path):
    rows = [[("t1", "Ab"), ("t1", "5")], [("t2", "Ab"), ("t3", None)]]
    for i, r in enumerate(rows):
        spark.createDataFrame(r, "t string, v string").write.mode("append").parquet(f"{tmp_path}/in")
        append_cells(spark, f"{tmp_path}/in", "t string, v string", "t", "v", f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").select("table_id", "value")
    assert sorted(map(tuple, got.collect())) == [("t1", "ab"), ("t2", "ab")]


def test_the_portal_is_put_in_order_once_for_each_change(spark):
    import json
    import urllib.parse
    import urllib.request

    from tablesift.plans import services

    class Counted(dict):
        looked = 0

        def __getitem__(self, key):
            Counted.looked += 1
            return super().__getitem__(key)

    packages = [Counted(id=f"p{i:03}", metadata_modified=f"t{(i * 7) % 50:02}") for i in range(200)]
    by_time = lambda: sorted((p.get("metadata_modified"), p.get("id")) for p in packages)
    with services.portal_service(spark, packages) as url:
        def ask(**query):
            with urllib.request.urlopen(f"{url}/package_search?{urllib.parse.urlencode(query)}") as reply:
                got = json.load(reply)["result"]
            return got["count"], [(p["metadata_modified"], p["id"]) for p in got["results"]]

        order = by_time()
        within = [x for x in order if "t10" <= x[0] <= "t20"]
        for at in (0, 30, 60):
            assert ask(fq="metadata_modified:[t10 TO t20]", sort="metadata_modified asc, id asc", rows=20, start=at) == (len(within), within[at : at + 20])
            assert ask(fq="metadata_modified:[* TO t20]", sort="metadata_modified desc, id desc", rows=20, start=at)[1] == [x for x in order if x[0] <= "t20"][::-1][at : at + 20]
        assert ask(rows=3, start=1)[1] == [(p.get("metadata_modified"), p.get("id")) for p in packages[1:4]]
        before = Counted.looked
        for at in range(10):
            ask(sort="metadata_modified asc, id asc", rows=20, start=at)
        assert Counted.looked == before  # not sorted again
        packages.append(Counted(id="new", metadata_modified="t99"))
        assert ask(sort="metadata_modified desc, id desc", rows=1, start=0) == (201, [("t99", "new")])
