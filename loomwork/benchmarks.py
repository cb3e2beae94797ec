"""Timed loads and requests, a ladder of scales, and a run of incremental loads."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .engine import Engine
from .errors import LoadError
from .plans.request import QueryRequest
from .sources import parquet
from .types import Profile, infer

# Scales and requests that clients of the HTTP face rely on where they name none.
PATH_SCALES = "100000,500000,1000000,2000000,4000000,10000000,50000000"
UPLOAD_SCALES = "100000,500000,1000000,2000000,4000000"
DEFAULT_REQUESTS = {
    "SELECT": QueryRequest("bench", ["fare_amount", "total_amount"]),
    "WHERE_SIMPLE": QueryRequest("bench", ["fare_amount", "total_amount"], "fare_amount>10"),
    "WHERE_COMPLEX": QueryRequest("bench", ["passenger_count", "trip_distance"], "payment_type=1"),
    "GROUP_BY_SIMPLE": QueryRequest("bench", ["VendorID", "SUM(total_amount)"], None, ["VendorID"]),
    "GROUP_BY_COMPLEX": QueryRequest("bench", ["passenger_count", "COUNT(VendorID)", "SUM(trip_distance)", "SUM(total_amount)", "SUM(tip_amount)"], None, ["passenger_count"]),
}

#: The eight requests of the demo run, over lineitem: payment type is the line number, drop-off place the supplier, tip the discount.
REQUESTS = {
    "R1": QueryRequest("lineitem", ["COUNT(l_quantity)", "SUM(l_extendedprice)", "AVG(l_quantity)", "MIN(l_quantity)", "MAX(l_tax)"], None, ["l_linenumber"], "SUM(l_extendedprice)", "DESC"),
    "R2": QueryRequest("lineitem", ["COUNT(l_quantity)", "AVG(l_quantity)", "AVG(l_discount)", "SUM(l_extendedprice)"], "l_discount > 0 AND l_tax > 0", ["l_linenumber"], "SUM(l_extendedprice)", "DESC"),
    "R3": QueryRequest("lineitem", ["COUNT(l_quantity)", "SUM(l_discount)", "AVG(l_discount)", "MAX(l_extendedprice)"], "l_discount > 0", ["l_suppkey"], "SUM(l_discount)", "DESC"),
    "R4": QueryRequest("lineitem", ["SUM(l_extendedprice)"], None, ["l_linenumber"], "SUM(l_extendedprice)", "DESC"),
    "R5": QueryRequest("lineitem", ["COUNT(*)", "AVG(l_extendedprice)", "AVG(l_quantity)", "SUM(l_extendedprice)", "MIN(l_extendedprice)", "MAX(l_extendedprice)"], "l_discount > 0 AND l_extendedprice > 0", ["l_returnflag"], "SUM(l_extendedprice)", "DESC"),
    "S1": QueryRequest("lineitem", ["l_linenumber", "l_extendedprice", "l_tax"]),
    "S2": QueryRequest("lineitem", ["l_quantity", "l_tax", "l_extendedprice"], "l_quantity > 10 AND l_tax > 0"),
    "S3": QueryRequest("lineitem", ["l_orderkey", "l_partkey", "l_extendedprice", "l_tax", "l_quantity"], None, (), "l_extendedprice", "DESC", 10),
}


@dataclass(frozen=True)
class Metric:
    operation: str
    rows: int
    elapsed_ns: int
    error: str | None = None


def timed(operation: str, run: Callable[[], int]) -> Metric:
    """Errors are kept with the metric, so that one failure doesn't end a ladder."""
    began = time.perf_counter_ns()
    try:
        rows, error = run(), None
    except Exception as e:  # noqa: BLE001
        rows, error = 0, f"{type(e).__name__}: {e}"
    return Metric(operation, rows, time.perf_counter_ns() - began, error)


def materialised(df: DataFrame) -> int:
    """Cached in executors' memory, as a loaded table is; returns its rows."""
    return df.cache().count()


def timed_load(engine: Engine, table: str, path: str, form: str, max_rows: int | None = None, skip_rows: int | None = None) -> Metric:
    return timed(f"LOAD {form.upper()}", lambda: engine.load(table, path, form, max_rows, skip_rows))


def timed_add(engine: Engine, table: str, rows: list[tuple]) -> Metric:
    return timed("ADD_ROWS", lambda: engine.add_rows(table, rows))


def timed_select(engine: Engine, request: QueryRequest, operation: str = "SELECT") -> Metric:
    return timed(operation, lambda: engine.scan_count(request.table, request.select, request.where))


def timed_group(engine: Engine, request: QueryRequest, operation: str = "GROUP_BY") -> Metric:
    return timed(operation, lambda: len(engine.query(request).collect()))


def timed_request(engine: Engine, request: QueryRequest, operation: str) -> Metric:
    """Grouped and sorted requests are delivered, others scanned and counted."""
    return (timed_group if request.group_by or request.order_by else timed_select)(engine, request, operation)


def _on(table: str, r: QueryRequest) -> QueryRequest:
    return QueryRequest(table, r.select, r.where, r.group_by, r.order_by, r.direction, r.limit)


def ladder(spark: SparkSession, path: str, scales: list[int], requests: Mapping[str, QueryRequest], profile: Profile = Profile.STRICT) -> dict[int, list[Metric]]:
    """For each scale the file has rows for: load that many rows, keep them in memory, time all requests, drop them."""
    total, columns = parquet.count_rows(spark, path), infer(spark.read.parquet(path).schema)
    out: dict[int, list[Metric]] = {}
    for scale in sorted(s for s in scales if 0 < s <= total):
        engine = Engine(spark, profile)
        engine.create_table("bench", columns)
        metrics = [timed_load(engine, "bench", path, "PARQUET", scale, 0), timed("CACHE", lambda e=engine: materialised(e.table("bench")))]
        metrics += [timed_request(engine, _on("bench", request), operation) for operation, request in requests.items()]
        engine.drop_table("bench")
        out[scale] = metrics
    return out


def report(spark: SparkSession, path: str, file: str, scales: list[int], requests: Mapping[str, QueryRequest] | None = None, profile: Profile = Profile.STRICT) -> dict:
    """A ladder as one JSON object: file, totalRowsInFile, columnsDetected and a result for each scale."""
    try:
        total, columns = parquet.count_rows(spark, path), infer(spark.read.parquet(path).schema)
    except Exception as e:
        raise LoadError(f"no Parquet file: {str(e).partition(chr(10))[0]}") from e
    shown = lambda m: {"status": "error", "message": m.error} if m.error else {"rowCount": m.rows, "elapsedMs": m.elapsed_ns // 1_000_000, "status": "ok"}
    got = ladder(spark, path, scales, requests or DEFAULT_REQUESTS, profile)
    results = [{"scale": scale, "LOAD": shown(load)} | {m.operation: shown(m) for m in rest} for scale, (load, *rest) in got.items()]
    return {"file": file, "totalRowsInFile": total, "columnsDetected": len(columns), "results": results}


def demo(spark: SparkSession, path: str, scales: list[int], requests: Mapping[str, QueryRequest] = REQUESTS, profile: Profile = Profile.STRICT) -> dict[int, list[Metric]]:
    """One table that grows from scale to scale by slices of the file; after each load all requests are timed on it."""
    total, columns = parquet.count_rows(spark, path), infer(spark.read.parquet(path).schema)
    engine = Engine(spark, profile)
    engine.create_table("demo", columns)
    out: dict[int, list[Metric]] = {}
    loaded = 0
    for scale in sorted({min(s, total) for s in scales if s > 0}):
        if scale == loaded:
            continue
        load = timed_load(engine, "demo", path, "PARQUET", scale - loaded, loaded)
        loaded = scale
        out[scale] = [load, timed("CACHE", lambda: engine.cache("demo")), *(timed_request(engine, _on("demo", r), k) for k, r in requests.items())]
    engine.drop_table("demo")
    return out
