"""Requests on the ten users: projection, filters, grouping, sorting, limits."""

import math

import pytest

from loomwork.engine import Engine
from loomwork.errors import InvalidQueryError, TableNotFoundError
from loomwork.plans.compiler import compile_request
from loomwork.plans.predicate import parse
from loomwork.plans.request import QueryRequest
from loomwork.types import Profile


def rows(engine, **kw):
    return [r.asDict() for r in engine.query(QueryRequest("users", **kw)).collect()]


def ids(engine, where):
    return sorted(r["id"] for r in rows(engine, select=["id"], where=where))


def test_projection(engine):
    assert list(rows(engine)[0]) == ["id", "nom", "age", "ville", "salaire"]
    assert list(rows(engine, select=["nom", "nope", "nom"])[0]) == ["nom"]
    assert len(list(rows(engine, select=["id", "*"])[0])) == 5
    with pytest.raises(InvalidQueryError):
        rows(engine, select=["nope"])


@pytest.mark.parametrize(
    ("where", "want"),
    [
        ("age > 18", [1, 2, 4, 5, 6, 7, 8, 9]),
        ("age<=20", [3, 8, 10]),
        ("age = 25", [2]),
        ("age != 25", [1, 3, 4, 5, 6, 7, 8, 9, 10]),
        ("age >= 41", [4, 7]),
        ("age < 16.5", [10]),
        ("ville = paris", [1, 3, 6, 9]),
        ("ville = 'PARIS'", [1, 3, 6, 9]),
        ("ville != Paris", [2, 4, 5, 7, 8, 10]),
        ("nom LIKE A%", [1]),
        ("nom like '%E'", [1, 3, 5, 7]),
        ("nom LIKE %ra%", [7]),
        ("nom LIKE eve", [5]),
        ("nom LIKE %", list(range(1, 11))),
        ("nom LIKE %r%c%", []),
        ("salaire LIKE 4%", [1, 9]),
        ("age > 18 AND ville = Paris", [1, 6, 9]),
        ("age > 18 AND ville = Paris OR salaire > 70000", [1, 4, 6, 7, 9]),
        ("age > 18 and ville = Paris and salaire > 46000", [6, 9]),
        ("nom = 'a AND b' or id = 1", [1]),
        ("nom = '<=' OR id <= 2", [1, 2]),
        ("nom >= 'Iris'", [9, 10]),
        ("  ", list(range(1, 11))),
        ("age = NaN", []),
        ("age != NaN", list(range(1, 11))),
    ],
)
def test_where(engine, where, want):
    assert ids(engine, where) == want


@pytest.mark.parametrize("where", ["nope = 1", "age", "= 3", "age > old", "age > 1 AND", "age > 3 OR nope < 2"])
def test_where_errors(engine, where):
    with pytest.raises(InvalidQueryError):
        ids(engine, where)


def test_parser_keeps_quoted_words():
    (first,), (second,) = parse("a = 'x OR y <= z' OR b LIKE \"%q AND%\"")
    assert (first.literal, second.op, second.literal) == ("x OR y <= z", "LIKE", "%q AND%")
    assert parse("a = it's AND b = 2")[0][0].literal == "it's"
    assert parse(None) == []


def test_grouping(engine):
    got = {r["ville"]: r for r in rows(engine, select=["COUNT(*)", "SUM(salaire)", "avg(age)", "MIN(age)", "MAX(age)", "nom"], group_by=["ville"])}
    assert {k: v["COUNT(*)"] for k, v in got.items()} == {"Paris": 4, "Lyon": 3, "Marseille": 3}
    assert {k: v["SUM(salaire)"] for k, v in got.items()} == {"Paris": 168000.0, "Lyon": 118000.0, "Marseille": 161000.0}
    assert got["Paris"]["avg(age)"] == 28.75 and isinstance(got["Paris"]["MAX(age)"], float)
    assert list(got["Lyon"]) == ["ville", "COUNT(*)", "SUM(salaire)", "avg(age)", "MIN(age)", "MAX(age)"]
    assert len(rows(engine, group_by=["ville"])) == 3
    top = rows(engine, select=["COUNT(id)"], group_by=["ville"], order_by="COUNT(id)", direction="desc", limit=1)
    assert top == [{"ville": "Paris", "COUNT(id)": 4}]
    for bad in ({"group_by": ["nope"]}, {"group_by": ["ville"], "select": ["SUM(nope)"]}, {"group_by": ["ville"], "select": ["SUM(nom)"]}):
        with pytest.raises(InvalidQueryError):
            rows(engine, **bad)


def test_total_without_groups(engine):
    assert rows(engine, select=["COUNT(*)", "MAX(age)"], where="ville = Lyon") == [{"COUNT(*)": 3, "MAX(age)": 28.0}]


def test_sorting_and_limits(engine):
    assert [r["salaire"] for r in rows(engine, order_by="salaire", direction="DESC", limit=3)] == [80000, 72000, 64000]
    assert [r["nom"] for r in rows(engine, select=["nom"], order_by="age", limit=2)] == ["Jack", "Charlie"]
    assert len(rows(engine, limit=0)) == len(rows(engine, limit=-3)) == 10
    assert len(rows(engine, limit=4)) == 4
    assert len(rows(engine, order_by="nope")) == 10
    assert [r["nom"] for r in rows(engine, order_by="nom", direction="up", limit=1)] == ["Alice"]


def test_nulls_and_nan(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", math.nan, None), ("a", None, 3), ("b", math.nan, None), (None, math.inf, 2**53 + 1)], "k string, x double, n long")
    ask = lambda profile=Profile.STRICT, **kw: [tuple(r) for r in compile_request(df, QueryRequest("t", **kw), profile).collect()]
    got = {r[0]: r[1:] for r in ask(select=["COUNT(x)", "SUM(x)", "AVG(x)", "MIN(x)"], group_by=["k"])}
    assert got == {"a": (2, 1.0, 1.0, 1.0), "b": (1, 0.0, None, None), None: (1, math.inf, math.inf, math.inf)}
    got = {r[0]: r[1:] for r in ask(Profile.COMPAT, select=["COUNT(x)", "AVG(x)", "SUM(k)"], group_by=["k"])}
    assert got["a"] == (3, 1 / 3, 0.0) and got["b"] == (1, 0.0, 0.0)
    assert [r[0] for r in ask(select=["n"], where="x > 0")] == [1, 2**53 + 1]
    assert [r[0] for r in ask(select=["n"], order_by="n")] == [1, 3, 2**53 + 1, None, None]
    assert [r[0] for r in ask(select=["n"], order_by="n", direction="DESC")][:2] == [None, None]
    assert ask(select=["n"], where=f"n = {2**53}") == []
    assert ask(Profile.COMPAT, select=["n"], where="k < z") == []


def test_group_keys_do_not_collide(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "x"), ("null", "x")], "p string, q string")
    assert compile_request(df, QueryRequest("t", group_by=["p", "q"])).count() == 4


def test_odd_names(spark):
    df = spark.createDataFrame([(1, 2)], "`a.b` int, `c d` int")
    assert compile_request(df, QueryRequest("t", ["c d", "SUM(a.b)"], "a.b = 1 AND c d > 1", ["c d"])).collect()[0]["SUM(a.b)"] == 1.0


def test_requests_are_checked():
    for bad in ({"tableName": ""}, {"tableName": "t", "select": "x"}, {"tableName": "t", "limit": "3"}):
        with pytest.raises(InvalidQueryError):
            QueryRequest.from_json(bad)
    with pytest.raises(TableNotFoundError):
        Engine(None).query({"tableName": "none"})


def test_pushdown(spark, tmp_path):
    spark.range(100).selectExpr("id", "id * 2 AS x", "'t' AS s").write.parquet(str(tmp_path / "p"))
    df = compile_request(spark.read.parquet(str(tmp_path / "p")), QueryRequest("t", ["id"], "x > 50 AND s = T"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(x,50)" in plan and "ReadSchema: struct<id:bigint,x:bigint,s:string>" in plan
