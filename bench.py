"""Headline queries on $BENCH_SF_DIR over local[$BENCH_CPUS]; prints one JSON line.

Two kinds of times, in seconds, best of 3 each: `ref_r1` and so on read the
Parquet files of $BENCH_SF_DIR; `r1_4000000_rows_resident` and so on run on a
do, of that many rows (lineitem repeated; $BENCH_SCALES, separated by commas).
`value` is the sum of the first kind.
"""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
HEADLINE = ["ref_r1", "ref_r2", "ref_r3", "ref_r4", "ref_r5", "ref_s1", "ref_s2", "ref_s3", "group_order_limit", "topn_where", "where_and_or_precedence", "like_contains"]


def best(run, times: int = 3) -> float:
    taken = []
    for _ in range(times):
        began = time.perf_counter()
        run()
        taken.append(time.perf_counter() - began)
    return round(min(taken), 4)


def resident(spark, sf_dir: str, rows: int, cpus: int) -> dict[str, float]:
    """The eight requests on an engine's cached table of so many rows; its load takes one run."""
    from pyspark.sql import functions as F

    from loomwork import benchmarks
    from loomwork.engine import Engine

    base = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", F.col("_metadata.row_index").alias("row"))
    whole, rest = divmod(rows, base.count())
    # Whole copies of the one file, and the first rows of another.
    copies = base.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(whole)))).where((F.col("copy") < whole) | (F.col("row") < rest))
    df = copies.drop("row", "copy").repartition(max(cpus, -(-rows // 2_000_000)))
    engine, out = Engine(spark), {}
    engine.register("lineitem", df)
    out[f"load_{rows}_rows"] = best(lambda: engine.cache("lineitem"), 1)
    engine.analyze("lineitem", ["l_linenumber", "l_suppkey", "l_returnflag"])
    for key, request in benchmarks.REQUESTS.items():
        got = []
        out[f"{key.lower()}_{rows}_rows_resident"] = best(lambda: got.append(benchmarks.timed_request(engine, request, key)))  # noqa: B023
        assert not any(m.error for m in got), got
    engine.drop_table("lineitem")
    return out


def main() -> None:
    from pyspark.sql import SparkSession

    from loomwork import registry
    from loomwork.plans.compiler import compile_request

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    scales = [int(x) for x in os.environ.get("BENCH_SCALES", "4000000,20000000").split(",") if x]
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")

    def run(q: str) -> None:
        # Requests are timed as they are, without the place of each row that the query of that name adds for its test.
        asked = registry.REQUESTED.get(q)
        df = compile_request(spark.read.parquet(f"{sf_dir}/{asked.table}.parquet"), asked) if asked else registry.QUERIES[q](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()

    run(HEADLINE[0])  # the session's start is no query's time
    times = {q: best(lambda: run(q)) for q in HEADLINE}  # noqa: B023
    value = round(sum(times.values()), 4)
    for rows in scales:
        times |= resident(spark, sf_dir, rows, int(cpus))
    print(json.dumps({"metric": "total seconds of the headline queries on files, best of 3 each", "value": value, "unit": "sec", "queries": times, "sf": Path(sf_dir).name}))
    spark.stop()


if __name__ == "__main__":
    main()
