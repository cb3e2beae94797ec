"""Parquet, bound to declared columns by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import convert, name, stored
from ..types import DECLARED, Profile, infer
from ..types import Column as Declared


def bound(df: DataFrame, columns: list[Declared], profile: Profile) -> DataFrame:
    """The declared columns: the first file column of the same name, in any case, or null."""
    have: dict[str, str] = {}
    for c in df.columns:
        have.setdefault(c.lower(), c)
    out = []
    for c in columns:
        file = have.get(c.name.lower())
        value = F.lit(None) if file is None else convert(name(file), df.schema[file].dataType, c.type, profile)
        out.append(stored(value.cast(DECLARED[c.type]), c.type, profile).alias(c.name))
    return df.select(out)


def read(spark: SparkSession, path: str, columns: list[Declared] | None = None, profile: Profile = Profile.STRICT, max_rows: int | None = None) -> DataFrame:
    """A whole file or folder, or its first max_rows rows; columns are inferred if none are declared."""
    if max_rows and max_rows > 0:
        return read_slice(spark, path, columns, 0, max_rows, profile)
    df = spark.read.parquet(path)
    return bound(df, columns or infer(df.schema), profile)


def read_slice(spark: SparkSession, path: str, columns: list[Declared] | None, skip_rows: int, max_rows: int | None = None, profile: Profile = Profile.STRICT) -> DataFrame:
    """Exactly the rows from skip_rows on, max_rows of them (all, if None), in the order of files by name and rows in them.

    Row numbers come from the scan. Of several files the driver gets one count
    each, read from the footers; the test names the first and the last file of
    the slice only, and files outside are not opened.
    """
    df = spark.read.parquet(path)
    kept = [*df.columns]
    files = _counts(df)
    end = None if max_rows is None else skip_rows + max_rows
    wanted, at = [], 0
    for file, n in files:
        low, high = max(0, skip_rows - at), n if end is None else min(n, end - at)
        if low < high:
            wanted.append((file, low, high))
        at += n
    if not wanted:
        return bound(df.limit(0), columns or infer(df.schema), profile)
    (first, low, _), (last, _, high) = wanted[0], wanted[-1]
    file, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    test = (file >= first) & (file <= last) & ((file > first) | (row >= low)) & ((file < last) | (row < high))
    rows = df.where(test).select([name(c) for c in kept])
    return bound(rows, columns or infer(rows.schema), profile)


def _counts(df: DataFrame) -> list[tuple[str, int]]:
    """(file, rows) by name; no column is read."""
    return sorted((r.file_path, r["count"]) for r in df.groupBy("_metadata.file_path").count().collect())


def count_rows(spark: SparkSession, path: str) -> int:
    """Rows by the footers; no column is read."""
    return spark.read.parquet(path).count()
