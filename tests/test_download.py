import http.server
import io
import json
import threading
import zipfile

import pytest
from pyspark.sql import functions as F

from tablesift.config import Search
from tablesift.operators import metadata, workflow
from tablesift.sources import download, portal

CITIES = [f"City {i}" for i in range(40)]


def content():
    people = "cityName;people\n" + "".join(f"{c};{i}\n" for i, c in enumerate(CITIES)) + "ragged\n"
    rents = "place,rent\r\n" + "".join(f'"{c}",{i}.5\r\n' for i, c in enumerate(CITIES[5:]))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for name, text in (("one.csv", "a|b\n1|é\n"), ("two.csv", "a|b\n2|x\n3|y\n"), ("metadata.csv", "m\n"), ("data_fr.csv", "f\n")):
            z.writestr(name, text.encode("latin-1"))
    return {"/r1": people.encode("latin-1"), "/r2": rents.encode(), "/r3": packed.getvalue(), "/r4": b"<!DOCTYPE html><p>", "/r5": b"a,b\n" + b"1,2\n" * 3000}


@pytest.fixture(scope="module")
def site():
    files = content()
    packages = [{"id": f"p{i}", "name": f"package {i}", "resources": [{"id": f"r{i}", "name": f"Resource {i}", "format": "CSV", "url": None, "language": None}]} for i in range(1, 7)]

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            url = f"http://127.0.0.1:{self.server.server_port}"
            if self.path.startswith("/package_search"):
                asked = dict(x.split("=") for x in self.path.partition("?")[2].split("&"))
                a = int(asked.get("start", 0))
                some = [{**p, "resources": [{**p["resources"][0], "url": f"{url}/{p['resources'][0]['id']}"}]} for p in packages[a : a + int(asked["rows"])]]
                body = json.dumps({"result": {"count": len(packages), "results": some}}).encode()
            elif self.path in files:
                body = files[self.path]
            else:
                self.send_error(404)
                return
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_from_a_portal_to_candidates(spark, site, tmp_path):
    spark.dataSource.register(portal.PortalSource)
    pages = spark.read.format("portal").options(url=site, page="4").load()
    packages = pages.select(F.from_json("package", metadata.PACKAGE).alias("p")).select("p.*")
    found = packages.select("id", F.explode("resources").alias("r")).select(F.col("r.id").alias("resource_id"), "r.url")
    assert found.count() == 6
    folder = f"file://{tmp_path}/lake"
    got = sorted(tuple(r) for r in download.download(found, folder, most_bytes=10000).select("resource_id", F.coalesce("table_name", F.lit("")), F.coalesce("n_rows", F.lit(0)), "status").collect())
    assert got == [
        ("r1", "r1.parquet", 40, "ok"), ("r2", "r2.parquet", 35, "ok"), ("r3", "r3_0.parquet", 1, "ok"), ("r3", "r3_1.parquet", 2, "ok"), ("r4", "", 0, "ERROR: ValueError"), ("r5", "", 0, "too large"), ("r6", "", 0, "ERROR: HTTPError"),
    ]
    lake = download.lake_of(spark, folder)
    assert sorted(lake.tables) == ["r1.parquet", "r2.parquet", "r3_0.parquet", "r3_1.parquet"] and lake.tables["r3_0.parquet"].collect()[0].b == "é"
    attributes = metadata.attributes(packages)
    settings = Search(min_distinct=3, budget=None)
    index = workflow.index_lake(lake, f"{tmp_path}/index", batch=3)
    both = [sorted(map(str, workflow.find_candidates(lake, attributes, settings=settings, index=x).collect())) for x in (None, index)]
    pairs = workflow.find_candidates(lake, attributes, settings=settings, index=index).collect()
    assert both[0] == both[1] and [(p.size_intersection, {p.r_rsc_name, p.s_rsc_name}) for p in pairs] == [(35, {"Resource 1", "Resource 2"})]


def test_csv_shapes():
    table = download.parse_csv(b"x;y;\n1;2;3\nbad\n4;;6\n")
    assert table.column_names == ["x", "y", "unnamed_2"] and table.to_pylist() == [{"x": "1", "y": "2", "unnamed_2": "3"}, {"x": "4", "y": None, "unnamed_2": "6"}]
    assert download.parse_csv(b"one\n1\n2\n").num_rows == 2 and download.parse_csv(b"a,a\n1,2\n").column_names == ["a", "a_1"]
    with pytest.raises(ValueError):
        download.parse_csv(b"")
