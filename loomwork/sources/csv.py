"""CSV with a header line in each file, bound to declared columns by name."""

from __future__ import annotations

import csv
import io

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import LoadError
from ..functions.dialect import parse_text, stored
from ..types import DECLARED, Profile
from ..types import Column as Declared

_OPTIONS = {"quote": '"', "escape": '"', "sep": ",", "multiLine": "false", "mode": "PERMISSIVE"}


def header(line: str) -> list[str]:
    return [x.strip() for x in next(csv.reader(io.StringIO(line)), [])]


def _first_line(lines: DataFrame) -> str:
    first = lines.where(F.trim("value") != "").limit(1).collect()
    if not first:
        raise LoadError("the file is empty")
    return first[0]["value"].removeprefix("﻿")


def bound(names: list[str], cells: list[Column], columns: list[Declared], profile: Profile) -> list[Column]:
    """The declared columns: the last file column of the same name, in any case, or null."""
    at = {n.lower(): i for i, n in enumerate(names)}
    out = []
    for c in columns:
        i = at.get(c.name.lower())
        value = parse_text(cells[i], c.type) if i is not None else F.lit(None).cast("string").cast(DECLARED[c.type])
        out.append(stored(value, c.type, profile).alias(c.name))
    return out


def read(spark: SparkSession, path: str, columns: list[Declared], profile: Profile = Profile.STRICT, max_rows: int | None = None) -> DataFrame:
    """A whole file or folder, or its first max_rows rows. Blank lines are no rows; short records leave columns null."""
    if max_rows and max_rows > 0:
        return read_slice(spark, path, columns, 0, max_rows, profile)
    names = header(_first_line(spark.read.text(path)))
    raw = spark.read.options(**_OPTIONS, header="true").schema(T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])).option("enforceSchema", "true").csv(path)
    cells = [F.col(x) for x in raw.columns]
    # Spark drops empty lines; a line of spaces is one cell of spaces and no more.
    rest = F.coalesce(*cells[1:]) if len(cells) > 1 else F.lit(None)
    raw = raw.where(~(rest.isNull() & cells[0].isNotNull() & (F.trim(cells[0]) == "")))
    return raw.select(bound(names, cells, columns, profile))


def _placed(lines: DataFrame, skip_headers: bool) -> DataFrame:
    """lines (value, file_path, start, id) with their place from 0 in file order; headers are left out if asked.

    ids are consecutive inside a split, so a place is the id plus the lines of
    the splits before. The driver gets one row per split, as it holds one for
    every scan anyway.
    """
    some = F.when(F.trim("value") != "", F.col("id"))
    splits = sorted(lines.groupBy("file_path", "start").agg(F.min("id").alias("low"), F.min(some).alias("head"), F.count("*").alias("n")).collect(), key=lambda r: (r.file_path, r.start))
    rows, at = [], 0
    for r in splits:
        heads = (r.n if r.head is None else r.head - r.low + 1) if skip_headers and r.start == 0 else 0
        rows.append((r.file_path, r.start, at - r.low - heads, r.low + heads))
        at += r.n - heads
    table = lines.sparkSession.createDataFrame(rows, "file_path string, start long, shift long, least long")
    return lines.join(F.broadcast(table), ["file_path", "start"]).where("id >= least").withColumn("place", F.col("id") + F.col("shift")).drop("shift", "least")


def read_slice(spark: SparkSession, path: str, columns: list[Declared], skip_rows: int, max_rows: int | None = None, profile: Profile = Profile.STRICT) -> DataFrame:
    """max_rows rows (all, if None) behind the first skip_rows lines after the header; blank lines count when skipped, not as rows.

    Lines are numbered inside their split as it is read, so nothing is sorted
    or shuffled: one pass counts the lines of each split, and another the rows
    behind the skipped lines, where a limit needs them.
    """
    text = spark.read.text(path)
    names = header(_first_line(text))
    lines = text.select("value", "_metadata.file_path", F.col("_metadata.file_block_start").alias("start")).withColumn("id", F.monotonically_increasing_id())
    rows = _placed(lines, True).where(F.col("place") >= skip_rows)
    rows = rows.where(F.trim("value") != "").select("value", "file_path", "start").withColumn("id", F.monotonically_increasing_id())
    if max_rows is not None:
        rows = _placed(rows, False).where(F.col("place") < max_rows)
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    rows = rows.select(F.from_csv("value", F.lit(schema), _OPTIONS).alias("r"))
    return rows.select(bound(names, [F.col(f"r.c{i}") for i in range(len(names))], columns, profile))
