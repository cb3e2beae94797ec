"""Queries through the engine itself: catalog, loads, sinks, HTTP and benchmarks, each with SQL that gives the same rows."""

from __future__ import annotations

import json
import threading
import urllib.error
import urllib.request
import uuid
from contextlib import contextmanager
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import benchmarks, http
from .engine import Engine
from .errors import EngineError
from .operators.scan import placed, renamed
from .plans.request import QueryRequest
from .registry import ORACLE_SQL, QUERIES, _read, _rounded, query
from .session import shared_folder
from .sources import parquet, sinks
from .types import Column, infer

_NATION = [("n_nationkey", "LONG"), ("n_name", "STRING"), ("n_regionkey", "LONG")]
_ORDERS = [("O_OrderKey", "LONG"), ("o_orderstatus", "STRING"), ("o_totalprice", "DOUBLE"), ("o_orderdate", "LONG"), ("missing", "INTEGER")]


def _figures(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Named figures as text, in order."""
    return spark.createDataFrame([(k, None if v is None else str(v)) for k, v in rows], "step string, value string")


def _values(*rows: tuple[str, str]) -> str:
    """SQL for named figures; each value is an SQL expression."""
    return " UNION ALL ".join(f"SELECT '{k}' AS step, CAST(({v}) AS VARCHAR) AS value" for k, v in rows)


def _outcome(run) -> str:
    try:
        return str(run())
    except EngineError as e:
        return f"{type(e).__name__} {e.status}"


def _orders_csv(spark: SparkSession, sf_dir: str, files: int) -> str:
    """All orders by key as CSV files, their rows in the order of the files' names."""
    folder = shared_folder(spark, "csv")
    out = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"))
    out.repartitionByRange(files, "o_orderkey").sortWithinPartitions("o_orderkey").write.option("header", "true").option("escape", '"').csv(folder)
    return folder


_ROWS = "o_orderkey AS \"O_OrderKey\", o_orderstatus, o_totalprice, epoch(o_orderdate)::BIGINT AS o_orderdate, NULL::INT AS missing"


# Catalog.
@query("engine_catalog", _values(("created", "1"), ("again", "'TableExistsError 409'"), ("blank", "'InvalidQueryError 400'"), ("names", "'nation,users'"), ("exists", "'True'"), ("count", "2"), ("missing", "'TableNotFoundError 404'"), ("rows", "SELECT count(*) FROM nation"), ("columns", "'n_nationkey LONG,n_name STRING,n_regionkey LONG'"), ("dropped", "'True'"), ("dropped twice", "'False'"), ("left", "'nation'")))
def engine_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark)
    engine.create_table(" users ", [("id", "INTEGER")])
    out = [("created", engine.table_count()), ("again", _outcome(lambda: engine.create_table("users", [("id", "INTEGER")]))), ("blank", _outcome(lambda: engine.create_table(" ", [("id", "INTEGER")])))]
    engine.create_table("nation", _NATION)
    engine.load("nation", f"{sf_dir}/nation.parquet", "PARQUET")
    told = engine.describe("nation")
    out += [("names", ",".join(engine.list_tables())), ("exists", engine.table_exists("nation")), ("count", engine.table_count()), ("missing", _outcome(lambda: engine.table("nope"))), ("rows", told["rowCount"]), ("columns", ",".join(f"{c['name']} {c['type']}" for c in told["columns"]))]
    out += [("dropped", engine.drop_table("users")), ("dropped twice", engine.drop_table("users")), ("left", ",".join(engine.list_tables()))]
    return _figures(spark, out)


@query("engine_errors", _values(("where column", "'InvalidQueryError 400'"), ("where operator", "'InvalidQueryError 400'"), ("where number", "'InvalidQueryError 400'"), ("group column", "'InvalidQueryError 400'"), ("aggregate column", "'InvalidQueryError 400'"), ("all names unknown", "'InvalidQueryError 400'"), ("table", "'TableNotFoundError 404'"), ("no table", "'InvalidQueryError 400'"), ("order column", "SELECT count(*) FROM nation")))
def engine_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark)
    engine.register("nation", _read(spark, sf_dir, "nation"))
    asked = {
        "where column": {"where": "nope = 1"},
        "where operator": {"where": "n_name"},
        "where number": {"where": "n_nationkey > many"},
        "group column": {"groupBy": ["nope"]},
        "aggregate column": {"groupBy": ["n_name"], "select": ["SUM(nope)"]},
        "all names unknown": {"select": ["nope", "neither"]},
        "table": {"tableName": "nope"},
        "no table": {"tableName": " "},
        "order column": {"orderBy": "nope"},
    }
    return _figures(spark, [(k, _outcome(lambda v=v: engine.query({"tableName": "nation", **v}).count())) for k, v in asked.items()])


# Loads.
@query("engine_loads", _values(("whole", "SELECT count(*) FROM orders"), ("prefix", "120"), ("slice", "75"), ("parquet", "SELECT count(*) FROM orders"), ("parquet slice", "33"), ("added", "2"), ("bad format", "'LoadError 400'"), ("empty", "'LoadError 400'"), ("rows", "SELECT 2 * count(*) + 120 + 75 + 33 + 2 FROM orders")))
def engine_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every load adds to what the table holds."""
    engine, csv, path = Engine(spark), _orders_csv(spark, sf_dir, 3), f"{sf_dir}/orders.parquet"
    engine.create_table("orders", _ORDERS)
    out = [("whole", engine.load("orders", csv, "csv")), ("prefix", engine.load("orders", csv, "CSV", max_rows=120)), ("slice", engine.load("orders", csv, "CSV", max_rows=75, skip_rows=40))]
    out += [("parquet", engine.load("orders", path, "PARQUET")), ("parquet slice", engine.load("orders", path, "PARQUET", 33, 17)), ("added", engine.add_rows("orders", [(-1, "X", None, None, 1), (-2, None, 0.5, 2, None)]))]
    out += [("bad format", _outcome(lambda: engine.load("orders", path, "XLS"))), ("empty", _outcome(lambda: engine.load_bytes("orders", b"", "CSV"))), ("rows", engine.table("orders").count())]
    return _figures(spark, out)


@query("csv_prefix", f"SELECT {_ROWS} FROM orders ORDER BY o_orderkey LIMIT 250")
def csv_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark)
    engine.create_table("orders", _ORDERS)
    engine.load("orders", _orders_csv(spark, sf_dir, 4), "CSV", max_rows=250)
    return engine.table("orders")


@query("csv_slice", f"SELECT {_ROWS} FROM orders ORDER BY o_orderkey LIMIT 500 OFFSET 200")
def csv_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, folder = Engine(spark), _orders_csv(spark, sf_dir, 4)
    engine.create_table("orders", _ORDERS)
    engine.load("orders", folder, "CSV", max_rows=300, skip_rows=200)
    engine.load("orders", folder, "CSV", max_rows=200, skip_rows=500)
    return engine.table("orders")


@query("csv_blank_lines", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def csv_blank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A blank line before each row, some of spaces: none is a row."""
    engine, folder = Engine(spark), shared_folder(spark, "csv")
    rows = _read(spark, sf_dir, "nation").select("n_nationkey", F.concat_ws(",", F.col("n_nationkey").cast("string"), F.concat(F.lit('"'), "n_name", F.lit('"'))).alias("line"))
    lines = rows.select("n_nationkey", F.posexplode(F.array(F.when(F.col("n_nationkey") % 2 == 0, "   ").otherwise(""), "line")).alias("k", "value"))
    head = spark.createDataFrame([(-1, 0, "N_NationKey, n_name")], "n_nationkey long, k int, value string")
    head.union(lines).coalesce(1).sortWithinPartitions("n_nationkey", "k").select("value").write.text(folder)
    engine.create_table("nation", _NATION[:2])
    engine.load("nation", folder, "CSV")
    return engine.table("nation")


def _upload(spark: SparkSession, sf_dir: str, table: str) -> bytes:
    """A small table's one file, as a client would send it."""
    return bytes(spark.read.format("binaryFile").load(f"{sf_dir}/{table}.parquet").select("content").first()[0])


@query("load_bytes", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation UNION ALL SELECT n_nationkey::BIGINT, n_name, NULL FROM nation")
def load_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark)
    engine.create_table("nation", _NATION)
    engine.load_bytes("nation", _upload(spark, sf_dir, "nation"), "PARQUET")
    text = "n_name,n_nationkey\r\n" + "".join(f'"{r.n_name}",{r.n_nationkey}\r\n' for r in _read(spark, sf_dir, "nation").collect())
    engine.load_bytes("nation", text.encode(), "CSV")
    return engine.table("nation")


@query("parquet_coercion", "SELECT l_orderkey::DOUBLE AS l_orderkey, trunc(l_extendedprice)::INT AS l_extendedprice, NULL::BIGINT AS l_returnflag, l_linenumber <> 0 AS l_linenumber, l_suppkey::VARCHAR AS l_suppkey, epoch(l_shipdate)::BIGINT AS l_shipdate FROM lineitem")
def parquet_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared types other than the file's: cast where they fit, null where they don't."""
    engine = Engine(spark)
    engine.create_table("lineitem", [("l_orderkey", "DOUBLE"), ("l_extendedprice", "INTEGER"), ("l_returnflag", "LONG"), ("l_linenumber", "BOOLEAN"), ("l_suppkey", "VARCHAR"), ("l_shipdate", "LONG")])
    engine.load("lineitem", f"{sf_dir}/lineitem.parquet", "PARQUET")
    return engine.table("lineitem")


@query("parquet_inference", "SELECT * FROM (VALUES (0, 'o_orderkey', 'LONG'), (1, 'o_custkey', 'LONG'), (2, 'o_orderstatus', 'STRING'), (3, 'o_totalprice', 'DOUBLE'), (4, 'o_orderdate', 'LONG'), (5, 'o_orderpriority', 'STRING')) AS t(place, name, type)")
def parquet_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = infer(_read(spark, sf_dir, "orders").schema)
    return spark.createDataFrame([(i, c.name, c.type) for i, c in enumerate(found)], "place int, name string, type string")


@query("add_rows", "SELECT 1 AS id, 'a' AS name, 1.5::DOUBLE AS x UNION ALL SELECT NULL, NULL, NULL UNION ALL SELECT 1, 'a', 1.5")
def add_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark)
    engine.create_table("t", [("id", "INTEGER"), ("name", "STRING"), ("x", "DOUBLE")])
    for _ in range(2):
        engine.add_rows("t", [(1, "a", 1.5)])
    engine.add_rows("t", [(None, None, None)])
    return engine.table("t")


# Values that the tables lack: NaN and null.
_HOLES = "SELECT l_orderkey, l_linenumber, l_returnflag, CASE WHEN l_linenumber = 1 THEN 'NaN'::DOUBLE WHEN l_linenumber = 2 THEN NULL ELSE l_quantity END AS q FROM lineitem"


def _holes(spark: SparkSession, sf_dir: str) -> Engine:
    engine = Engine(spark)
    q = F.when(F.col("l_linenumber") == 1, F.lit(float("nan"))).when(F.col("l_linenumber") != 2, F.col("l_quantity"))
    engine.register("holes", _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", q.alias("q")))
    return engine


@query("group_nan", f"SELECT l_linenumber, count(*) AS rows, count(q) AS n, coalesce(round(sum(q) FILTER (NOT isnan(q)), 4), 0) AS s, round(avg(q) FILTER (NOT isnan(q)), 4) AS a, min(q) FILTER (NOT isnan(q)) AS lo, max(q) FILTER (NOT isnan(q)) AS hi FROM ({_HOLES}) GROUP BY 1")
def group_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _holes(spark, sf_dir).query({"tableName": "holes", "select": ["COUNT(*)", "COUNT(q)", "SUM(q)", "AVG(q)", "MIN(q)", "MAX(q)"], "groupBy": ["l_linenumber"]})
    return renamed(_rounded(got), {"COUNT(*)": "rows", "COUNT(q)": "n", "SUM(q)": "s", "AVG(q)": "a", "MIN(q)": "lo", "MAX(q)": "hi"})


@query("where_nan", f"SELECT l_orderkey, l_linenumber FROM ({_HOLES}) WHERE NOT isnan(q) AND q >= 25")
def where_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _holes(spark, sf_dir).query({"tableName": "holes", "select": ["l_orderkey", "l_linenumber"], "where": "q >= 25"})


for _key, _direction, _order in (("nulls_last_up", "ASC", "s NULLS LAST"), ("nulls_first_down", "DESC", "s DESC NULLS FIRST")):

    def _sorted_holes(spark: SparkSession, sf_dir: str, direction: str = _direction) -> DataFrame:
        asked = {"tableName": "holes", "select": ["MIN(q)"], "groupBy": ["l_linenumber", "l_returnflag"], "where": "l_linenumber = 2 OR l_linenumber = 5 AND l_returnflag = R", "orderBy": "MIN(q)", "orderDirection": direction}
        return placed(_holes(spark, sf_dir).query(asked)).select(F.col("`MIN(q)`").alias("lo"), "place")

    QUERIES[f"sort_{_key}"] = _sorted_holes
    ORACLE_SQL[f"sort_{_key}"] = f"SELECT s AS lo, row_number() OVER (ORDER BY {_order}) AS place FROM (SELECT min(q) AS s FROM ({_HOLES}) WHERE l_linenumber = 2 OR (l_linenumber = 5 AND l_returnflag = 'R') GROUP BY l_linenumber, l_returnflag)"


@query("group_order_analyzed", "SELECT l_suppkey, count(*) AS n, row_number() OVER (ORDER BY l_suppkey DESC) AS place FROM lineitem GROUP BY 1")
def group_order_analyzed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The engine has measured the key, so the few groups are sorted in one task."""
    engine = Engine(spark)
    engine.register("lineitem", _read(spark, sf_dir, "lineitem"))
    engine.analyze("lineitem", ["l_suppkey"])
    return renamed(placed(engine.query({"tableName": "lineitem", "select": ["COUNT(*)"], "groupBy": ["l_suppkey"], "orderBy": "l_suppkey", "orderDirection": "DESC"})), {"COUNT(*)": "n"})


# Sinks.
def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.text(folder).select(F.col("value").alias("line"))


@query("sink_csv_aliases", "SELECT 'status,mean' AS line UNION ALL SELECT o_orderstatus || ',' || printf('%.2f', avg(o_totalprice)) FROM orders GROUP BY o_orderstatus")
def sink_csv_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, folder = Engine(spark), shared_folder(spark, "sink")
    engine.register("orders", _read(spark, sf_dir, "orders"))
    sinks.write_csv(engine.query({"tableName": "orders", "select": ["AVG(o_totalprice)"], "groupBy": ["o_orderstatus"]}).coalesce(1), folder, {"o_orderstatus": "status", "AVG(o_totalprice)": "mean"}, 2)
    return _lines(spark, folder)


@query("sink_csv_raw", """SELECT 'q,COUNT(*)' AS line UNION ALL SELECT '"' || upper(l_returnflag) || ' says ""x"", ' || l_linestatus || '",' || count(*) FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def sink_csv_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, folder = Engine(spark), shared_folder(spark, "sink")
    engine.register("t", _read(spark, sf_dir, "lineitem").select(F.concat(F.upper("l_returnflag"), F.lit(' says "x", '), "l_linestatus").alias("q")))
    sinks.write_csv(engine.query({"tableName": "t", "select": ["COUNT(*)"], "groupBy": ["q"]}).coalesce(1), folder)
    return _lines(spark, folder)


@query("sink_csv_empty", "SELECT 'nothing found' AS line")
def sink_csv_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, folder = Engine(spark), shared_folder(spark, "sink")
    engine.register("nation", _read(spark, sf_dir, "nation"))
    sinks.write_csv(engine.query({"tableName": "nation", "where": "n_name = atlantis"}), folder, placeholder="nothing found")
    return _lines(spark, folder)


@query("sink_envelope", "SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS high, (SELECT count(DISTINCT o_orderstatus) FROM orders) AS told FROM orders GROUP BY 1")
def sink_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark)
    engine.register("orders", _read(spark, sf_dir, "orders"))
    got = json.loads(json.dumps(sinks.envelope(engine.query({"tableName": "orders", "select": ["COUNT(*)", "MAX(o_totalprice)"], "groupBy": ["o_orderstatus"]}))))
    return spark.createDataFrame([(r["o_orderstatus"], r["COUNT(*)"], r["MAX(o_totalprice)"], got["rowCount"]) for r in got["data"]], "o_orderstatus string, n long, high double, told long")


@query("sink_console", "SELECT '| ' || rpad(r_regionkey::VARCHAR, greatest(3, max(length(r_regionkey::VARCHAR)) OVER ())::INT, ' ') || ' | ' || rpad(r_name, greatest(6, max(length(r_name)) OVER ())::INT, ' ') || ' |' AS line FROM region")
def sink_console(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark)
    engine.register("region", _read(spark, sf_dir, "region"))
    text = sinks.table_text(engine.query({"tableName": "region", "select": ["r_regionkey", "r_name"]}), {"r_regionkey": "key", "r_name": "region"})
    return spark.createDataFrame([(x,) for x in text.split("\n")[3:-1]], "line string")


@query("sink_reports", _values(("metrics", "'operation,rowCount,elapsedMs,elapsedNs|SCAN,5,2,2500000|BAD,0,0,7'"), ("trace", "'| SCAN | 5 | 2.5 |'"), ("plot", "'[(5, 2.5)]'")))
def sink_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    import tempfile
    from pathlib import Path

    metrics = [benchmarks.Metric("SCAN", 5, 2_500_000), benchmarks.Metric("BAD", 0, 7, "error")]
    with tempfile.TemporaryDirectory() as folder:  # reports are files of the driver's machine
        sinks.write_metrics(metrics, f"{folder}/m.csv")
        sinks.write_trace(metrics, f"{folder}/m.md")
        sinks.write_plot({5: metrics}, f"{folder}/plot.py")
        held: dict = {}
        exec(Path(f"{folder}/plot.py").read_text().split("\n")[2], held)  # noqa: S102
        return _figures(spark, [("metrics", "|".join(Path(f"{folder}/m.csv").read_text().split())), ("trace", Path(f"{folder}/m.md").read_text().split("\n")[4]), ("plot", held["TIMES"]["SCAN"])])


# HTTP.
@contextmanager
def _served(server: ThreadingHTTPServer):
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        yield f"http://127.0.0.1:{server.server_port}"
    finally:
        server.shutdown()
        server.server_close()


def _call(method: str, url: str, body=None, kind: str = "application/json"):
    data = body if isinstance(body, bytes) else None if body is None else json.dumps(body).encode()
    try:
        with urllib.request.urlopen(urllib.request.Request(url, data, {"Content-Type": kind}, method=method)) as r:
            return r.status, json.loads(r.read())
    except urllib.error.HTTPError as e:
        return e.code, json.loads(e.read())


def _form(fields: dict[str, bytes], file: bytes) -> tuple[bytes, str]:
    mark = uuid.uuid4().hex
    parts = [f'--{mark}\r\nContent-Disposition: form-data; name="{k}"\r\n\r\n'.encode() + v for k, v in fields.items()]
    parts.append(f'--{mark}\r\nContent-Disposition: form-data; name="file"; filename="upload"\r\n\r\n'.encode() + file)
    return b"\r\n".join(parts) + f"\r\n--{mark}--\r\n".encode(), f"multipart/form-data; boundary={mark}"


@query("http_tables", _values(("create", "201"), ("create again", "409"), ("load", "SELECT count(*) FROM nation"), ("list", "SELECT 'nation ' || count(*) FROM nation"), ("describe", "3"), ("select", "SELECT string_agg(n_name, ',' ORDER BY n_nationkey DESC) FROM nation WHERE n_regionkey = 1"), ("no such column", "400"), ("delete", "200"), ("describe again", "404"), ("no such address", "404")))
def http_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = {"name": "nation", "columns": [{"name": n, "type": t} for n, t in _NATION]}
    with _served(http.serve(Engine(spark))) as base:
        api = f"{base}/api"
        out = [("create", _call("POST", f"{api}/tables", table)[0]), ("create again", _call("POST", f"{api}/tables", table)[0])]
        out.append(("load", _call("POST", f"{api}/tables/load", *_form({"tableName": b"nation", "fileFormat": b"PARQUET"}, _upload(spark, sf_dir, "nation")))[1]["rowsLoaded"]))
        out.append(("list", " ".join(f"{t['name']} {t['rowCount']}" for t in _call("GET", f"{api}/tables")[1])))
        out.append(("describe", len(_call("GET", f"{api}/tables/nation")[1]["columns"])))
        got = _call("POST", f"{api}/query/select", {"tableName": "nation", "select": ["n_name"], "where": "n_regionkey = 1", "orderBy": "n_nationkey", "orderDirection": "DESC"})[1]
        out.append(("select", ",".join(r["n_name"] for r in got["data"])))
        out.append(("no such column", _call("POST", f"{api}/query/select", {"tableName": "nation", "where": "nope = 1"})[0]))
        out.append(("delete", _call("DELETE", f"{api}/tables/nation")[0]))
        out.append(("describe again", _call("GET", f"{api}/tables/nation")[0]))
        out.append(("no such address", _call("GET", f"{api}/nope")[0]))
    return _figures(spark, out)


@query("load_url", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def load_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over a redirect, from a host that is allowed."""
    data = _upload(spark, sf_dir, "nation")

    class Files(BaseHTTPRequestHandler):
        def do_GET(self):
            moved = self.path != "/nation"
            self.send_response(302 if moved else 200)
            if moved:
                self.send_header("Location", "/nation")
            self.end_headers()
            self.wfile.write(b"" if moved else data)

        def log_message(self, *args):
            pass

    engine = Engine(spark)
    engine.create_table("nation", _NATION)
    with _served(ThreadingHTTPServer(("127.0.0.1", 0), Files)) as base:
        engine.load_url("nation", f"{base}/moved", "PARQUET", hosts=["127.0.0.1"])
    return engine.table("nation")


# Benchmarks.
@query("bench_ladder", "SELECT * FROM (VALUES (100, 'LOAD PARQUET', 100), (100, 'CACHE', 100), (100, 'GROUP', 3), (100, 'BAD', 0), (1000, 'LOAD PARQUET', 1000), (1000, 'CACHE', 1000), (1000, 'GROUP', 3), (1000, 'BAD', 0)) AS t(scale, operation, n)")
def bench_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = {"GROUP": QueryRequest("t", ["COUNT(*)"], group_by=["l_returnflag"]), "BAD": QueryRequest("t", group_by=["nope"])}
    got = benchmarks.ladder(spark, f"{sf_dir}/lineitem.parquet", [1000, 100, 1 << 40], asked)
    return spark.createDataFrame([(s, m.operation, m.rows) for s, metrics in got.items() for m in metrics], "scale int, operation string, n int")


@query("bench_demo", " UNION ALL ".join(["SELECT 'LOAD PARQUET' AS operation, count(*) - 1000 AS n FROM lineitem", "SELECT 'CACHE', count(*) FROM lineitem", "SELECT 'R1', count(DISTINCT l_linenumber) FROM lineitem", "SELECT 'R2', count(DISTINCT l_linenumber) FROM lineitem WHERE l_discount > 0 AND l_tax > 0", "SELECT 'R3', count(DISTINCT l_suppkey) FROM lineitem WHERE l_discount > 0", "SELECT 'R4', count(DISTINCT l_linenumber) FROM lineitem", "SELECT 'R5', count(DISTINCT l_returnflag) FROM lineitem WHERE l_discount > 0", "SELECT 'S1', count(*) FROM lineitem", "SELECT 'S2', count(*) FROM lineitem WHERE l_quantity > 10 AND l_tax > 0", "SELECT 'S3', 10"]))
def bench_demo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads into one table, the second all that the first left; rows of the requests after the second."""
    path = f"{sf_dir}/lineitem.parquet"
    got = benchmarks.demo(spark, path, [1000, parquet.count_rows(spark, path)])
    return spark.createDataFrame([(m.operation, m.rows) for m in got[max(got)]], "operation string, n long")


@query("bench_rows", _values(("LOAD CSV", "SELECT count(*) FROM orders"), ("ADD_ROWS", "2"), ("SELECT", "SELECT count(*) + 2 FROM orders"), ("WHERE", "SELECT count(*) FROM orders WHERE o_totalprice > 200000"), ("GROUP_BY", "SELECT count(DISTINCT o_orderstatus) + 1 FROM orders")))
def bench_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark)
    engine.create_table("orders", [Column(*c) for c in _ORDERS])
    metrics = [benchmarks.timed_load(engine, "orders", _orders_csv(spark, sf_dir, 2), "CSV"), benchmarks.timed_add(engine, "orders", [(1, "X", 0.0, 0, 0)] * 2)]
    metrics += [benchmarks.timed_select(engine, QueryRequest("orders", ["O_OrderKey", "o_totalprice"])), benchmarks.timed_select(engine, QueryRequest("orders", ["O_OrderKey"], "o_totalprice > 200000"), "WHERE"), benchmarks.timed_group(engine, QueryRequest("orders", ["COUNT(*)"], group_by=["o_orderstatus"]))]
    return _figures(spark, [(m.operation, m.error or m.rows) for m in metrics])
