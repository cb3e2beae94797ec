"""Queries of the engine by name, with the SQL that gives the same rows.

Sums, means and products of doubles are rounded to 4 places on both sides:
their last bits depend on the order of summation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import benchmarks
from .functions.dialect import name
from .operators.scan import append, placed, renamed, scanned
from .plans.compiler import compile_request
from .plans.request import QueryRequest
from .session import shared_folder
from .sources import csv, parquet
from .types import Column, Profile

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: What the queries that are one request each ask for.
REQUESTED: dict[str, QueryRequest] = {}


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select([(F.round(name(f.name), 4) if isinstance(f.dataType, T.DoubleType) else name(f.name)).alias(f.name) for f in df.schema.fields])


def request(key: str, sql: str | None, table: str, select=None, where=None, group_by=(), order_by=None, direction="ASC", limit=None, aliases=None, profile=Profile.STRICT, place=False):
    """A request on a table as a query; with `place`, the order of its rows is a column of the result."""
    asked = QueryRequest(table, select, where, group_by, order_by, direction, limit)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = compile_request(_read(spark, sf_dir, table), asked, profile)
        if place:
            df = placed(df)
        return renamed(_rounded(df) if group_by else df, aliases or {})

    QUERIES[key], REQUESTED[key] = run, asked
    if sql:
        ORACLE_SQL[key] = sql


def query(key: str, sql: str | None = None):
    def add(run):
        QUERIES[key] = run
        if sql:
            ORACLE_SQL[key] = sql
        return run

    return add


# Projection and scans.
request("scan_all", "SELECT * FROM region", "region", ["*"])
request("scan_all_by_default", "SELECT * FROM nation", "nation")
request("project", "SELECT o_orderkey, o_totalprice FROM orders", "orders", ["o_orderkey", "o_totalprice"])
request("project_unknown_dropped", "SELECT n_name FROM nation", "nation", ["n_name", "nope", "n_name"])
request("project_aliased", "SELECT n_name AS name, n_regionkey AS region FROM nation", "nation", ["n_name", "n_regionkey"], aliases={"n_name": "name", "n_regionkey": "region"})

# Comparisons of numbers and text.
for _key, _op in (("eq", "="), ("neq", "!="), ("lt", "<"), ("lte", "<="), ("gt", ">"), ("gte", ">=")):
    request(f"where_num_{_key}", f"SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity {_op} 25", "lineitem", ["l_orderkey", "l_partkey", "l_quantity"], f"l_quantity {_op} 25")
    request(f"where_int_{_key}", f"SELECT p_partkey, p_size FROM part WHERE p_size {_op} 20", "part", ["p_partkey", "p_size"], f"p_size{_op}20")
request("where_num_fraction", "SELECT p_partkey FROM part WHERE p_size > 20.5", "part", ["p_partkey"], "p_size > 20.5")
request("where_str_eq_ci", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'", "customer", ["c_custkey"], "c_mktsegment = building")
request("where_str_neq_ci", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) <> 'building'", "customer", ["c_custkey"], "c_mktsegment != 'Building'")
request("where_str_range", "SELECT c_custkey FROM customer WHERE c_mktsegment >= 'FURNITURE'", "customer", ["c_custkey"], "c_mktsegment >= 'FURNITURE'")
request("where_str_range_compat", "SELECT c_custkey FROM customer WHERE false", "customer", ["c_custkey"], "c_mktsegment >= 'FURNITURE'", profile=Profile.COMPAT)
request("where_text_vs_number_compat", "SELECT p_partkey FROM part", "part", ["p_partkey"], "p_size != large", profile=Profile.COMPAT)
request("like_contains", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%a%'", "part", ["p_partkey", "p_name"], "p_name LIKE %a%")
request("like_prefix", "SELECT o_orderkey FROM orders WHERE o_orderpriority ILIKE '1-%'", "orders", ["o_orderkey"], "o_orderpriority like '1-%'")
request("like_suffix", "SELECT p_partkey, p_type FROM part WHERE p_type ILIKE '%S'", "part", ["p_partkey", "p_type"], "p_type LIKE %s")
request("like_exact", "SELECT n_nationkey FROM nation WHERE n_name ILIKE (SELECT min(n_name) FROM nation)", "nation", ["n_nationkey"], "n_name LIKE nation_0")
request("like_inner_literal", "SELECT p_partkey FROM part WHERE strpos(lower(p_name), 'a%b_') > 0", "part", ["p_partkey"], "p_name LIKE %a%b_%")
request("like_all", "SELECT n_nationkey FROM nation WHERE n_name IS NOT NULL", "nation", ["n_nationkey"], "n_name LIKE %")
request("like_on_number", "SELECT o_orderkey FROM orders WHERE CAST(o_orderkey AS VARCHAR) LIKE '12%'", "orders", ["o_orderkey"], "o_orderkey LIKE 12%")
request("where_and", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_quantity > 30 AND l_discount > 0.05 AND lower(l_returnflag) = 'r'", "lineitem", ["l_orderkey", "l_partkey"], "l_quantity > 30 AND l_discount > 0.05 and l_returnflag = r")
request("where_or", "SELECT o_orderkey FROM orders WHERE lower(o_orderstatus) = 'f' OR o_totalprice > 400000", "orders", ["o_orderkey"], "o_orderstatus = F OR o_totalprice > 400000")
request("where_and_or_precedence", "SELECT o_orderkey FROM orders WHERE (o_totalprice > 300000 AND lower(o_orderstatus) = 'f') OR o_custkey < 50", "orders", ["o_orderkey"], "o_totalprice > 300000 AND o_orderstatus = F OR o_custkey < 50")
request("where_quoted_words", "SELECT c_custkey FROM customer WHERE lower(c_name) = 'a and b' OR c_custkey <= 10", "customer", ["c_custkey"], "c_name = 'a AND b' OR c_custkey <= 10")
request("where_blank", "SELECT r_regionkey FROM region", "region", ["r_regionkey"], "   ")

# Grouping.
_PRICE = {f: f"{f}(l_extendedprice)" for f in ("COUNT", "SUM", "AVG", "MIN", "MAX")}
for _f, _label in _PRICE.items():
    _value = f"round({_label}, 4)" if _f != "COUNT" else _label
    request(f"group_{_f.lower()}", f"SELECT l_returnflag, {_value} AS x FROM lineitem GROUP BY l_returnflag", "lineitem", [_label], group_by=["l_returnflag"], aliases={_label: "x"})
request("group_count_star", "SELECT l_linestatus, count(*) AS n FROM lineitem GROUP BY 1", "lineitem", ["l_linestatus", "count(*)"], group_by=["l_linestatus"], aliases={"count(*)": "n"})
request("group_numeric_key", "SELECT l_linenumber, round(sum(l_quantity), 4) AS s FROM lineitem GROUP BY 1", "lineitem", ["SUM(l_quantity)"], group_by=["l_linenumber"], aliases={"SUM(l_quantity)": "s"})
request("group_text_key", "SELECT o_orderstatus, round(avg(o_totalprice), 4) AS a FROM orders GROUP BY 1", "orders", ["AVG(o_totalprice)"], group_by=["o_orderstatus"], aliases={"AVG(o_totalprice)": "a"})
request("group_multi_key", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_tax), 4) AS t FROM lineitem GROUP BY 1, 2", "lineitem", ["COUNT(*)", "SUM(l_tax)"], group_by=["l_returnflag", "l_linestatus"], aliases={"COUNT(*)": "n", "SUM(l_tax)": "t"})
request("group_all_aggregates", "SELECT l_suppkey, count(*) AS n, round(sum(l_quantity), 4) AS s, round(avg(l_quantity), 4) AS a, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1", "lineitem", ["COUNT(*)", "SUM(l_quantity)", "AVG(l_quantity)", "MIN(l_quantity)", "MAX(l_quantity)"], group_by=["l_suppkey"], aliases={"COUNT(*)": "n", "SUM(l_quantity)": "s", "AVG(l_quantity)": "a", "MIN(l_quantity)": "lo", "MAX(l_quantity)": "hi"})
request("group_keys_only", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", "lineitem", ["l_tax"], group_by=["l_returnflag", "l_linestatus"])
request("group_where", "SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_discount >= 0.05 GROUP BY 1", "lineitem", ["COUNT(*)"], "l_discount >= 0.05", ["l_suppkey"], aliases={"COUNT(*)": "n"})
request("group_order", "SELECT o_orderpriority, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC) AS place FROM orders GROUP BY 1", "orders", ["COUNT(*)"], group_by=["o_orderpriority"], order_by="COUNT(*)", direction="DESC", aliases={"COUNT(*)": "n"}, place=True)
request("group_order_limit", "SELECT l_suppkey, round(sum(l_extendedprice), 4) AS revenue, row_number() OVER (ORDER BY sum(l_extendedprice) DESC NULLS FIRST) AS place FROM lineitem GROUP BY 1 ORDER BY sum(l_extendedprice) DESC NULLS FIRST LIMIT 10", "lineitem", ["SUM(l_extendedprice)"], group_by=["l_suppkey"], order_by="SUM(l_extendedprice)", direction="desc", limit=10, aliases={"SUM(l_extendedprice)": "revenue"}, place=True)
request("group_sum_of_int", "SELECT p_brand, sum(p_size)::DOUBLE AS s FROM part GROUP BY 1", "part", ["sum(p_size)"], group_by=["p_brand"], aliases={"sum(p_size)": "s"})
request("group_text_sum_compat", "SELECT n_regionkey, 0.0::DOUBLE AS s FROM nation GROUP BY 1", "nation", ["SUM(n_name)"], group_by=["n_regionkey"], aliases={"SUM(n_name)": "s"}, profile=Profile.COMPAT)


@query("agg_boolean", "SELECT l_linenumber, sum(CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END)::DOUBLE AS s, round(avg(CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END), 4) AS a FROM lineitem GROUP BY 1")
def agg_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _read(spark, sf_dir, "lineitem").select("l_linenumber", (F.col("l_quantity") > 25).alias("large"))
    df = compile_request(df, QueryRequest("t", ["SUM(large)", "AVG(large)"], group_by=["l_linenumber"]))
    return renamed(_rounded(df), {"SUM(large)": "s", "AVG(large)": "a"})


@query("where_boolean", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_quantity > 25")
def where_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", (F.col("l_quantity") > 25).alias("large"))
    return compile_request(df, QueryRequest("t", ["l_orderkey", "l_partkey"], "large = TRUE"))


@query("total", "SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS s, max(l_quantity) AS hi FROM lineitem")
def total(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = compile_request(_read(spark, sf_dir, "lineitem"), QueryRequest("lineitem", ["COUNT(*)", "SUM(l_extendedprice)", "MAX(l_quantity)"]))
    return renamed(df.withColumn("SUM(l_extendedprice)", F.round(name("SUM(l_extendedprice)"), 2)), {"COUNT(*)": "n", "SUM(l_extendedprice)": "s", "MAX(l_quantity)": "hi"})


# Sorting and limits.
request("sort_asc", "SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY o_orderkey) AS place FROM orders", "orders", ["o_orderkey", "o_orderstatus"], order_by="o_orderkey", place=True)
request("sort_desc", "SELECT c_name, row_number() OVER (ORDER BY c_custkey DESC) AS place FROM customer", "customer", ["c_name"], order_by="c_custkey", direction="DESC", place=True)
request("sort_text", "SELECT c_name, row_number() OVER (ORDER BY c_name) AS place FROM customer", "customer", ["c_name"], order_by="c_name", place=True)
request("sort_unknown_ignored", "SELECT n_name FROM nation", "nation", ["n_name"], order_by="nope", direction="DESC")
request("topn", "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey DESC) AS place FROM orders ORDER BY o_orderkey DESC LIMIT 10", "orders", ["o_orderkey", "o_totalprice"], order_by="o_orderkey", direction="DESC", limit=10, place=True)
request("topn_where", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS place FROM orders WHERE lower(o_orderstatus) = 'f' ORDER BY o_orderkey LIMIT 10", "orders", ["o_orderkey"], "o_orderstatus = F", order_by="o_orderkey", limit=10, place=True)
request("limit_nonpositive", "SELECT n_nationkey FROM nation", "nation", ["n_nationkey"], limit=0)


@query("limit_only", "SELECT 5::BIGINT AS n")
def limit_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rows a limit without an order gives is open; how many is not."""
    return compile_request(_read(spark, sf_dir, "orders"), QueryRequest("orders", limit=5)).agg(F.count("*").alias("n"))


# Counting, slices and files.
@query("scan_count", "SELECT count(*) AS n FROM lineitem WHERE l_quantity > 10 AND l_tax > 0")
def scan_count_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(_read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_quantity", "l_tax"], "l_quantity > 10 AND l_tax > 0")


@query("parquet_count", "SELECT count(*) AS n FROM lineitem")
def parquet_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(parquet.count_rows(spark, f"{sf_dir}/lineitem.parquet"),)], "n long")


_ORDERS = [Column("O_ORDERKEY", "LONG"), Column("o_totalprice", "DOUBLE"), Column("o_orderstatus", "STRING"), Column("o_orderdate", "LONG"), Column("missing", "INTEGER")]


@query("parquet_slice", "SELECT o_orderkey AS O_ORDERKEY, o_totalprice, o_orderstatus, epoch(o_orderdate)::BIGINT AS o_orderdate, NULL::INT AS missing FROM orders LIMIT 100 OFFSET 100")
def parquet_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet.read_slice(spark, f"{sf_dir}/orders.parquet", _ORDERS, 100, 100)


@query("parquet_prefix", "SELECT 250::BIGINT AS n")
def parquet_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet.read(spark, f"{sf_dir}/orders.parquet", _ORDERS, max_rows=250).agg(F.count("*").alias("n"))


@query("append_slices", "SELECT count(*) AS n, count(DISTINCT o_orderkey) AS keys FROM (SELECT * FROM orders LIMIT 300)")
def append_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda skip, n: parquet.read_slice(spark, f"{sf_dir}/orders.parquet", _ORDERS, skip, n)
    return append(part(0, 120), part(120, 180)).agg(F.count("*").alias("n"), F.countDistinct("O_ORDERKEY").alias("keys"))


@query("compat_store", "SELECT o_orderkey, o_totalprice::FLOAT::DOUBLE AS o_totalprice, 0 AS missing FROM orders")
def compat_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [Column("o_orderkey", "LONG"), Column("o_totalprice", "DOUBLE"), Column("missing", "INTEGER")]
    return parquet.read(spark, f"{sf_dir}/orders.parquet", columns, Profile.COMPAT)


@query("csv_roundtrip", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS s, min(epoch(o_orderdate))::BIGINT AS first FROM orders GROUP BY 1")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "csv")
    out = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.date_format(F.col("o_orderdate"), "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"))
    out.write.option("header", "true").option("escape", '"').csv(folder)
    columns = [Column("O_OrderStatus", "STRING"), Column("o_totalprice", "DOUBLE"), Column("o_orderdate", "LONG")]
    df = csv.read(spark, folder, columns)
    return df.groupBy(F.col("O_OrderStatus").alias("o_orderstatus")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("s"), F.min("o_orderdate").alias("first"))


# The requests of the demo run, over lineitem.
def _headline(key: str, sql: str, aliases: dict[str, str]):
    asked = benchmarks.REQUESTS[key]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return renamed(_rounded(compile_request(_read(spark, sf_dir, "lineitem"), asked)), aliases)

    key = f"ref_{key.lower()}"
    QUERIES[key], ORACLE_SQL[key], REQUESTED[key] = run, sql, asked


_headline("R1", "SELECT l_linenumber, count(*) AS n, round(sum(l_extendedprice), 4) AS total, round(avg(l_quantity), 4) AS mean, min(l_quantity) AS low, max(l_tax) AS high FROM lineitem GROUP BY 1 ORDER BY total DESC", {"COUNT(l_quantity)": "n", "SUM(l_extendedprice)": "total", "AVG(l_quantity)": "mean", "MIN(l_quantity)": "low", "MAX(l_tax)": "high"})
_headline("R2", "SELECT l_linenumber, count(*) AS n, round(avg(l_quantity), 4) AS quantity, round(avg(l_discount), 4) AS discount, round(sum(l_extendedprice), 4) AS total FROM lineitem WHERE l_discount > 0 AND l_tax > 0 GROUP BY 1 ORDER BY total DESC", {"COUNT(l_quantity)": "n", "AVG(l_quantity)": "quantity", "AVG(l_discount)": "discount", "SUM(l_extendedprice)": "total"})
_headline("R3", "SELECT l_suppkey, count(*) AS n, round(sum(l_discount), 4) AS total, round(avg(l_discount), 4) AS mean, max(l_extendedprice) AS high FROM lineitem WHERE l_discount > 0 GROUP BY 1 ORDER BY total DESC", {"COUNT(l_quantity)": "n", "SUM(l_discount)": "total", "AVG(l_discount)": "mean", "MAX(l_extendedprice)": "high"})
_headline("R4", "SELECT l_linenumber, round(sum(l_extendedprice), 4) AS total FROM lineitem GROUP BY 1 ORDER BY total DESC", {"SUM(l_extendedprice)": "total"})
_headline("R5", "SELECT l_returnflag, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(avg(l_quantity), 4) AS quantity, round(sum(l_extendedprice), 4) AS total, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem WHERE l_discount > 0 AND l_extendedprice > 0 GROUP BY 1 ORDER BY total DESC", {"COUNT(*)": "n", "AVG(l_extendedprice)": "mean", "AVG(l_quantity)": "quantity", "SUM(l_extendedprice)": "total", "MIN(l_extendedprice)": "low", "MAX(l_extendedprice)": "high"})


@query("ref_s1", "SELECT count(*) AS n FROM lineitem")
def ref_s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(_read(spark, sf_dir, "lineitem"), benchmarks.REQUESTS["S1"].select)


@query("ref_s2", "SELECT count(*) AS n FROM lineitem WHERE l_quantity > 10 AND l_tax > 0")
def ref_s2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(_read(spark, sf_dir, "lineitem"), benchmarks.REQUESTS["S2"].select, benchmarks.REQUESTS["S2"].where)


@query("ref_s3", "SELECT l_extendedprice, row_number() OVER (ORDER BY l_extendedprice DESC) AS place FROM lineitem ORDER BY l_extendedprice DESC LIMIT 10")
def ref_s3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five columns are asked for and written; which rows come last among equal prices is open, so prices and places are compared."""
    return placed(compile_request(_read(spark, sf_dir, "lineitem"), benchmarks.REQUESTS["S3"])).select("l_extendedprice", "place")


REQUESTED["ref_s3"] = benchmarks.REQUESTS["S3"]
