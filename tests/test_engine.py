"""Catalog, loads, sinks, HTTP, benchmarks and streams."""

import io
import json
import pathlib
import threading
import urllib.error
import urllib.request

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from cases import USER_COLUMNS, USERS

from loomwork import benchmarks, http
from loomwork.engine import Engine
from loomwork.errors import InvalidQueryError, LoadError, TableExistsError, TableNotFoundError, TooLargeError
from loomwork.plans.request import QueryRequest
from loomwork.sources import csv, parquet, remote, sinks
from loomwork.streaming.requests import follow, running
from loomwork.types import Column, Profile, infer


def test_catalog(engine):
    assert engine.table_exists("users") and engine.table_count() == 1 and engine.list_tables() == ["users"]
    assert engine.describe("users")["rowCount"] == 10
    with pytest.raises(TableExistsError):
        engine.create_table(" users ", USER_COLUMNS)
    with pytest.raises(InvalidQueryError):
        engine.create_table("x", [])
    assert engine.drop_table("users") and not engine.drop_table("users")
    with pytest.raises(TableNotFoundError):
        engine.describe("users")


def test_loads_append(engine, users_csv):
    assert engine.load("users", users_csv, "csv", max_rows=3) == 3
    assert engine.load("users", users_csv, "csv", max_rows=4, skip_rows=8) == 2
    assert engine.add_rows("users", [(11, "Zoe", None, None, 1)]) == 1
    assert engine.describe("users")["rowCount"] == 16
    assert engine.scan_count("users", ["id"], "nom = iris") == 2
    with pytest.raises(LoadError):
        engine.load("users", users_csv, "xls")


def test_csv_quirks(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('B , extra,A,t,d,ok,a\n 7 ,x,1,2020-01-02 03:04:05,1.5,TRUE,"say ""hi"", you"\n\n   \n3.0,,,12,oops,yes\n,y,2,2020-13-01 00:00:00,, true ,z,surplus\n')
    columns = [Column("a", "STRING"), Column("b", "INTEGER"), Column("T", "LONG"), Column("D", "DOUBLE"), Column("ok", "BOOLEAN"), Column("gone", "DOUBLE")]
    want = [('say "hi", you', 7, 1577934245, 1.5, True, None), (None, None, 12, None, False, None), ("z", None, None, None, True, None)]
    assert [tuple(r) for r in csv.read(spark, str(path), columns).collect()] == want
    uploads = Engine(spark)
    uploads.create_table("q", columns)
    assert uploads.load_bytes("q", path.read_bytes(), "CSV") == 3 and [tuple(r) for r in uploads.table("q").collect()] == want
    assert uploads.load_bytes("q", io.BytesIO(path.read_bytes()), "csv", max_rows=2) == 2
    # The two lines without text count when skipped.
    assert [tuple(r) for r in csv.read_slice(spark, str(path), columns, 1, 5).collect()] == want[1:]
    assert [tuple(r) for r in csv.read_slice(spark, str(path), columns, 4, 5).collect()] == want[2:]
    assert csv.read(spark, str(path), columns, Profile.COMPAT).collect()[1].b == 0
    assert csv.read_slice(spark, str(path), columns, 3).count() == 2  # no end
    assert csv.read(spark, str(path), columns, max_rows=2).count() == 2
    (tmp_path / "e.csv").write_text("")
    with pytest.raises(LoadError):
        csv.read(spark, str(tmp_path / "e.csv"), columns)


def test_parquet_types_and_slices(spark, tmp_path):
    path = str(tmp_path / "p.parquet")
    n = 1000
    pq.write_table(pa.table({"I": pa.array(range(n), pa.int64()), "f": pa.array([None, *[i + 0.1 for i in range(1, n)]]), "b": [i % 2 == 0 for i in range(n)], "s": [f"x{i}" for i in range(n)], "ts": pa.array([i * 1_000_000 for i in range(n)], pa.timestamp("us"))}), path, row_group_size=128)
    columns = [Column("i", "INTEGER"), Column("F", "DOUBLE"), Column("b", "BOOLEAN"), Column("s", "STRING"), Column("ts", "LONG")]
    got = parquet.read_slice(spark, path, columns, 120, 20).collect()
    assert [r.i for r in got] == list(range(120, 140)) and got[0].F == 120.1 and got[0].ts == 120 and got[1].b is False
    assert parquet.count_rows(spark, path) == n and parquet.read(spark, path, max_rows=7).count() == 7
    assert parquet.read_slice(spark, path, columns, 990, 50).count() == 10
    compat = parquet.read(spark, path, columns, Profile.COMPAT).orderBy("i").limit(2).collect()
    assert compat[0].F == 0.0 and compat[1].F != 1.1 and abs(compat[1].F - 1.1) < 1e-6 and compat[1].ts == 1_000_000
    wide = parquet.read(spark, path, [Column("i", "DOUBLE"), Column("f", "INTEGER"), Column("s", "INTEGER"), Column("b", "LONG")])
    assert tuple(wide.where("i = 2").collect()[0]) == (2.0, 2, None, 1)
    assert [(c.name, c.type) for c in infer(spark.read.parquet(path).schema)] == [("I", "LONG"), ("f", "DOUBLE"), ("b", "BOOLEAN"), ("s", "STRING"), ("ts", "LONG")]
    data = io.BytesIO()
    pq.write_table(pa.table({"id": [1, 2, 3]}), data)
    uploads = Engine(spark)
    uploads.create_table("p", [("id", "LONG")])
    assert uploads.load_bytes("p", data.getvalue(), "PARQUET", max_rows=2) == 2
    (held,) = uploads._spooled["p"]
    assert sorted(r.id for r in uploads.table("p").collect()) == [1, 2]
    uploads.drop_table("p")
    assert not pathlib.Path(held.removeprefix("file:")).exists()


def test_slices_of_many_files(spark, tmp_path):
    """Prefixes and slices follow the order of files and rows, over splits of a few bytes too."""
    for k in range(4):
        (tmp_path / "c").mkdir(exist_ok=True)
        (tmp_path / "p").mkdir(exist_ok=True)
        (tmp_path / "c" / f"{k}.csv").write_text("\n" * (k == 2) + "id,x\n" + "".join(f"{k * 50 + i},{i}\n" + "\n" * (i == 7) for i in range(50)))
        pq.write_table(pa.table({"id": list(range(k * 50, k * 50 + 50))}), str(tmp_path / "p" / f"{k}.parquet"), row_group_size=9)
    lines = [x for k in range(4) for x in [*(k * 50 + i for i in range(8)), None, *(k * 50 + i for i in range(8, 50))]]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64b")
    try:
        for skip, most in ((0, 3), (0, 120), (8, 10), (9, 10), (45, 60), (51, None), (203, 5), (500, None)):
            want = [x for x in lines[skip:] if x is not None][:most]
            assert [r.id for r in csv.read_slice(spark, str(tmp_path / "c"), [Column("id", "LONG")], skip, most).orderBy("id").collect()] == want
            want = list(range(200))[skip : None if most is None else skip + most]
            assert sorted(r.id for r in parquet.read_slice(spark, str(tmp_path / "p"), [Column("id", "LONG")], skip, most).collect()) == want
        assert sorted(r.id for r in csv.read(spark, str(tmp_path / "c"), [Column("id", "LONG")], max_rows=70).collect()) == list(range(70))
        assert sorted(r.id for r in csv.read(spark, str(tmp_path / "c"), [Column("id", "LONG")]).collect()) == list(range(200))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_a_load_that_fails_changes_nothing(spark, tmp_path, engine):
    (tmp_path / "bad.parquet").write_text("no parquet")
    with pytest.raises(Exception):  # noqa: B017
        engine.load("users", str(tmp_path / "bad.parquet"), "PARQUET")
    assert engine.describe("users")["rowCount"] == 10 and engine.query({"tableName": "users"}).count() == 10


def test_sorted_groups_after_analysis(engine):
    asked = QueryRequest("users", ["SUM(age)"], group_by=["ville"], order_by="SUM(age)", direction="DESC")
    before = engine.query(asked).collect()
    assert engine.analyze("users", ["ville"])["ville"] in (3, 4, 5)
    plan = engine.query(asked)
    assert plan.collect() == before and "rangepartitioning" not in plan._jdf.queryExecution().executedPlan().toString()
    engine.add_rows("users", [(11, "Zoe", 1, "Nice", 1)])
    assert len(engine.query(asked).collect()) == 4


def test_cut_and_discard(spark):
    import pathlib as paths

    from loomwork import session

    df = session.cut(spark.range(50).repartition(30), rows=50)
    assert df.rdd.getNumPartitions() == 8 and df.count() == 50 and session.cut(spark.range(50).repartition(9)).rdd.getNumPartitions() == 9
    held = paths.Path(df._jdf.queryExecution().logical().rdd().getCheckpointFile().get().removeprefix("file:"))
    assert held.is_dir()
    session.discard(df)
    assert not held.exists()


def test_places(spark):
    from loomwork.operators.scan import placed

    got = placed(spark.range(100).repartition(7).orderBy("id")).collect()
    assert sorted((r.id, r.place) for r in got) == [(i, i + 1) for i in range(100)]
    assert placed(spark.range(0).orderBy("id")).collect() == []


def test_sinks(engine, tmp_path):
    df = engine.query(QueryRequest("users", ["AVG(age)"], group_by=["ville"], order_by="ville"))
    got = sinks.envelope(df)
    assert got["rowCount"] == 3 and got["data"][0] == {"ville": "Lyon", "AVG(age)": 73 / 3}
    sinks.write_csv(df.coalesce(1), str(tmp_path / "out"), {"AVG(age)": "mean"}, 2)
    text = next((tmp_path / "out").glob("part-*.csv")).read_text()
    assert text.splitlines() == ["ville,mean", "Lyon,24.33", "Marseille,36.33", "Paris,28.75"]
    assert "| Lyon" in sinks.table_text(df, {"AVG(age)": "mean"}) and sinks.table_text(df.limit(0)) == sinks.NO_ROWS
    assert "there are more" in sinks.table_text(df, rows=2)
    sinks.write_csv(df.limit(0), str(tmp_path / "none"), placeholder="nothing")
    assert next((tmp_path / "none").glob("part-*")).read_text() == "nothing\n"
    with pytest.raises(TooLargeError):
        sinks.envelope(engine.table("users"), 9)
    metric = benchmarks.timed_group(engine, QueryRequest("users", group_by=["ville"]))
    sinks.write_metrics([metric], str(tmp_path / "m.csv"))
    sinks.write_trace([metric], str(tmp_path / "m.md"))
    assert (tmp_path / "m.csv").read_text().splitlines()[0] == "operation,rowCount,elapsedMs,elapsedNs"
    sinks.write_plot({10: [metric], 20: [metric]}, str(tmp_path / "plot.py"))
    assert "GROUP_BY" in (tmp_path / "plot.py").read_text() and compile((tmp_path / "plot.py").read_text(), "plot", "exec")
    assert metric.rows == 3 and "GROUP_BY" in (tmp_path / "m.md").read_text()


def test_ladder(spark, tmp_path):
    path = str(tmp_path / "p.parquet")
    pq.write_table(pa.table({"k": [i % 3 for i in range(100)], "x": [float(i) for i in range(100)]}), path)
    out = benchmarks.ladder(spark, path, [10, 100, 1000], {"S": QueryRequest("t", ["x"], "x > 4"), "G": QueryRequest("t", ["SUM(x)"], group_by=["k"]), "BAD": QueryRequest("t", group_by=["nope"])})
    assert list(out) == [10, 100] and [m.rows for m in out[10]] == [10, 10, 5, 3, 0] and out[10][-1].error


def test_demo(spark, tmp_path):
    path = str(tmp_path / "p.parquet")
    pq.write_table(pa.table({"l_linenumber": [i % 3 for i in range(100)], "l_extendedprice": [float(i) for i in range(100)]}), path)
    out = benchmarks.demo(spark, path, [10, 40, 1000], {k: benchmarks.REQUESTS[k] for k in ("R4", "S1")})
    assert {k: [m.rows for m in v] for k, v in out.items()} == {10: [10, 10, 3, 10], 40: [30, 40, 3, 40], 100: [60, 100, 3, 100]}


def test_http(spark, tmp_path, users_csv, monkeypatch):
    pq.write_table(pa.table({"k": [1, 2]}), str(tmp_path / "b.parquet"))
    server = http.serve(Engine(spark), roots=[str(tmp_path)])
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}/api"

    def call(method, path, body=None, kind="application/json"):
        data = body if isinstance(body, bytes) else None if body is None else json.dumps(body).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(base + path, data, {"Content-Type": kind}, method=method)) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    try:
        table = {"name": "users", "columns": [{"name": n, "type": t} for n, t in USER_COLUMNS]}
        assert call("POST", "/tables", table)[0] == 201 and call("POST", "/tables", table)[0] == 409
        file = open(users_csv, "rb").read()
        body = b"".join(b'--X\r\nContent-Disposition: form-data; name="%s"%s\r\n\r\n%s\r\n' % x for x in ((b"tableName", b"", b"users"), (b"fileFormat", b"", b"CSV"), (b"file", b'; filename="u.csv"', file))) + b"--X--\r\n"
        status, got = call("POST", "/tables/load", body, "multipart/form-data; boundary=X")
        assert (status, got["rowsLoaded"]) == (200, len(USERS))
        status, got = call("POST", "/query/select", {"tableName": "users", "select": ["nom"], "where": "age > 50"})
        assert got["data"] == [{"nom": "Grace"}]
        assert call("POST", "/query/select", {"tableName": "users", "where": "nope = 1"})[0] == 400
        assert call("POST", "/query/select", {"tableName": "none"})[0] == 404
        assert call("GET", "/tables")[1][0]["rowCount"] == 10 and call("GET", "/tables/users")[0] == 200
        assert call("POST", "/tables/load-url", {"tableName": "users", "url": "file:///etc/passwd", "fileFormat": "CSV"})[0] == 400
        assert call("POST", "/benchmark/run-path", {"path": "/etc/passwd"})[0] == 400
        status, got = call("POST", f"/benchmark/run-path?filePath={tmp_path}/b.parquet&scales=1,2,9")
        assert status == 200 and (got["file"], got["totalRowsInFile"], got["columnsDetected"]) == ("b.parquet", 2, 1)
        assert [r["scale"] for r in got["results"]] == [1, 2] and got["results"][1]["LOAD"]["rowCount"] == 2 and got["results"][1]["GROUP_BY_SIMPLE"]["status"] == "error"
        form = lambda *fields: b"".join(b"--X\r\nContent-Disposition: form-data; %s\r\n\r\n%s\r\n" % x for x in fields) + b"--X--"
        taxi = io.BytesIO()
        pq.write_table(pa.table({c: [1.0, 20.0, 30.0] for c in ("fare_amount", "total_amount", "passenger_count", "trip_distance", "payment_type", "VendorID", "tip_amount")}), taxi)
        status, got = call("POST", "/benchmark/run", form((b'name="scales"', b"2, 3"), (b'name="file"; filename="t.parquet"', taxi.getvalue())), "multipart/form-data; boundary=X")
        assert status == 200 and got["file"] == "t.parquet" and [r["scale"] for r in got["results"]] == [2, 3]
        assert {k: v["rowCount"] for k, v in got["results"][1].items() if k != "scale"} == {"LOAD": 3, "CACHE": 3, "SELECT": 3, "WHERE_SIMPLE": 2, "WHERE_COMPLEX": 1, "GROUP_BY_SIMPLE": 3, "GROUP_BY_COMPLEX": 3}
        assert call("POST", "/benchmark/run", form((b'name="file"; filename="t.parquet"', b"")), "multipart/form-data; boundary=X")[0] == 400
        assert call("POST", "/benchmark/run", b"--X\r\nContent-Disposition: form-data; name=\"file\"; filename=\"t\"\r\n\r\ncut short", "multipart/form-data; boundary=X")[0] == 400
        monkeypatch.setattr(http, "LARGEST_JSON", 100)
        assert call("POST", "/query/select", {"tableName": "users", "where": "x" * 200})[0] == 413
        monkeypatch.setattr(http, "LARGEST_BODY", 150)
        assert call("POST", "/tables/load", b"x" * 200)[0] == 413
        monkeypatch.setattr(http, "envelope", lambda df: 1 / 0)
        assert call("POST", "/query/select", {"tableName": "users"})[0] == 500
        assert call("POST", "/benchmark/run-path", {"path": str(tmp_path / "b.parquet"), "scales": [2]})[1]["results"][0]["LOAD"]["rowCount"] == 2
        assert call("DELETE", "/tables/users")[0] == 200 and call("GET", "/tables/users")[0] == 404 and call("GET", "/nope")[0] == 404
    finally:
        server.shutdown()


def test_url_load(engine, users_csv):
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            if self.path == "/moved":
                self.send_response(302)
                self.send_header("Location", "/users.csv")
                self.end_headers()
                return
            self.send_response(200 if self.path == "/users.csv" else 404)
            self.end_headers()
            self.wfile.write(open(users_csv, "rb").read())

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        assert engine.load_url("users", base + "/moved", "CSV", max_rows=4) == 4
        for url in (base + "/none", "ftp://x/y"):
            with pytest.raises(LoadError):
                list(remote.fetch(url))
        with pytest.raises(LoadError):
            list(remote.fetch(base + "/users.csv", hosts=["example.org"]))
        with pytest.raises(LoadError):
            list(remote.fetch(base + "/users.csv", largest=10))
    finally:
        server.shutdown()


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    pq.write_table(pa.table({"k": ["a", "b", "a"], "x": pa.array([1, 2, 3], pa.int32())}), str(folder / "1.parquet"))
    stream = running(follow(spark, str(folder), [Column("k", "STRING"), Column("x", "INTEGER")]), QueryRequest("t", ["SUM(x)"], "x > 0", ["k"]))
    query = stream.writeStream.format("memory").queryName("sums").outputMode("complete").start()
    try:
        query.processAllAvailable()
        pq.write_table(pa.table({"k": ["b"], "x": pa.array([5], pa.int32())}), str(folder / "2.parquet"))
        query.processAllAvailable()
        assert {tuple(r) for r in spark.table("sums").collect()} == {("a", 4.0), ("b", 7.0)}
    finally:
        query.stop()
    with pytest.raises(InvalidQueryError):
        running(stream, QueryRequest("t", limit=3))
