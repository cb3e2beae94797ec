"""Scans that deliver counts, and unions that append."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import name
from ..plans.compiler import filtered, projected
from ..session import cut
from ..types import Profile


def scan_count(df: DataFrame, select=None, where: str | None = None, profile: Profile = Profile.STRICT) -> DataFrame:
    """One row: how many rows match, and a checksum that makes the scan read the selected columns."""
    rows, names = filtered(df, where, profile), projected(df, select)
    checksum = F.sum(F.xxhash64(*map(name, names)).cast("decimal(38,0)")) if names else F.lit(None).cast("decimal(38,0)")
    return rows.agg(F.count("*").alias("n"), checksum.alias("checksum"))


def scanned(df: DataFrame, select=None, where: str | None = None, profile: Profile = Profile.STRICT) -> DataFrame:
    """The count alone, as `n`. It depends on the checksum, so no column of the scan can be pruned."""
    return scan_count(df, select, where, profile).where("checksum is not null or n = 0").select("n")


def renamed(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Display names for result labels; labels without one stay."""
    return df.select([name(c).alias(aliases.get(c, c)) for c in df.columns])


def append(table: DataFrame, more: DataFrame) -> DataFrame:
    return table.unionByName(more)


def placed(df: DataFrame, label: str = "place") -> DataFrame:
    """df, which has an order, with the place of each row in it, 1 and up.

    The ordered rows are written once, so that the count of each partition and
    the rows agree; the driver gets one count per partition.
    """
    rows = cut(df.withColumn("__at", F.monotonically_increasing_id()))
    counts = sorted(rows.groupBy(F.shiftright("__at", 33).alias("part")).count().collect())
    before, at = [], 1
    for part, n in counts:
        before.append((part, at))
        at += n
    shift = df.sparkSession.createDataFrame(before, "__part long, __before long")
    inside = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    rows = rows.join(F.broadcast(shift), F.shiftright("__at", 33) == F.col("__part"))
    return rows.select([name(c) for c in df.columns] + [(F.col("__before") + inside).alias(label)])
