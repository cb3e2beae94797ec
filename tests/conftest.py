import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(Path(__file__).resolve().parent))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def users_csv(tmp_path_factory):
    from cases import USER_COLUMNS, USERS

    path = tmp_path_factory.mktemp("users") / "users.csv"
    path.write_text("\n".join([",".join(n for n, _ in USER_COLUMNS), *(",".join(map(str, r)) for r in USERS)]) + "\n")
    return str(path)


@pytest.fixture()
def engine(spark, users_csv):
    from cases import USER_COLUMNS

    from loomwork.engine import Engine

    engine = Engine(spark)
    engine.create_table("users", USER_COLUMNS)
    assert engine.load("users", users_csv, "CSV") == 10
    return engine
