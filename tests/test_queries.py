"""Every query of the registry against its SQL, and random requests against DuckDB."""

import random
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from loomwork import registry, registry_engine
from loomwork.plans.compiler import compile_request
from loomwork.plans.request import QueryRequest

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem".split()
pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="test data is not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return [names[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("key", sorted(registry_engine.QUERIES))
def test_query(spark, duck, key):
    got = registry.QUERIES[key](spark, DATA)
    want = duck.execute(registry.ORACLE_SQL[key])
    assert canonical(got.columns, got.collect()) == canonical([d[0] for d in want.description], want.fetchall())


def test_random_requests(spark, duck):
    rng = random.Random(7)
    df = spark.read.parquet(f"{DATA}/lineitem.parquet").cache()
    numbers, keys = ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber"], ["l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey"]
    for _ in range(25):
        terms = [(rng.choice(numbers), rng.choice(["=", "!=", "<", "<=", ">", ">="]), round(rng.choice([1, 5, 0.05, 20, 1000]), 2), rng.choice(["AND", "OR"])) for _ in range(rng.randint(0, 3))]
        where = "".join(f"{c} {op} {v}" + (f" {link} " if i + 1 < len(terms) else "") for i, (c, op, v, link) in enumerate(terms))
        by = rng.sample(keys, rng.randint(1, 2))
        asked = [("COUNT(*)", "count(*)")] + [(f"{f}({c})", f"round({f}({c}::DOUBLE), 4)") for f, c in {(rng.choice(["SUM", "AVG", "MIN", "MAX"]), rng.choice(numbers)) for _ in range(2)}]
        got = registry._rounded(compile_request(df, QueryRequest("lineitem", [a for a, _ in asked], where, by)))
        sql = f"SELECT {', '.join(by)}, " + ", ".join(f'{s} AS "{a}"' for a, s in asked) + " FROM lineitem" + (f" WHERE {where.replace('!=', '<>')}" if where else "") + f" GROUP BY {', '.join(by)}"
        want = duck.execute(sql)
        assert canonical(got.columns, got.collect()) == canonical([d[0] for d in want.description], want.fetchall()), sql
    df.unpersist()


def test_entry_without_training_operators(tmp_path):
    """The rest imports and lists its queries where that subpackage and the pipeline are gone."""
    root = Path(__file__).resolve().parent.parent
    (tmp_path / "loomwork").symlink_to(tmp_path / "copy")
    import shutil

    shutil.copytree(root / "loomwork", tmp_path / "copy", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'ref_r1' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) == set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path), "HOME": str(tmp_path)})
