"""Casts, aggregates and orderings whose results differ from Spark's defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidQueryError
from ..types import FLOATING, NUMERIC, Profile


def name(column: str) -> Column:
    """The column of exactly this name, dots and spaces included."""
    return F.col("`" + column.replace("`", "``") + "`")


def kind(df: DataFrame, column: str) -> T.DataType:
    return df.schema[column].dataType


def number(df: DataFrame, column: str) -> Column:
    """The column as double; booleans count 0 and 1."""
    c = name(column)
    return (c.cast("int") if isinstance(kind(df, column), T.BooleanType) else c).cast("double")


def parse_text(value: Column, declared: str) -> Column:
    """A CSV cell as the declared type; blank or unreadable cells are null.

    LONG also reads `yyyy-MM-dd HH:mm:ss` as seconds since 1970 in UTC,
    whatever the session's time zone. BOOLEAN is true for `true` in any case.
    """
    text = F.trim(value)
    text = F.when(text != "", text)
    if declared == "INTEGER":
        return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("int"))
    if declared == "LONG":
        part = lambda i, n: F.substring(text, i, n).try_cast("long")
        clock = text.rlike(r"^\d{4}-\d{2}-\d{2} ([01]\d|2[0-3]):[0-5]\d:[0-5]\d$")
        seconds = F.unix_date(F.substring(text, 1, 10).try_cast("date")).cast("long") * 86400 + part(12, 2) * 3600 + part(15, 2) * 60 + part(18, 2)
        return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("long")).when(clock, seconds)
    if declared == "DOUBLE":
        return text.try_cast("double")
    if declared == "BOOLEAN":
        return F.lower(text) == "true"
    return text


def convert(column: Column, have: T.DataType, declared: str, profile: Profile) -> Column:
    """A file column of type `have` as the declared type; what doesn't fit is null.

    Timestamps in a LONG are seconds since 1970 in UTC, as in CSV files; the
    compat profile keeps microseconds.
    """
    if isinstance(have, T.StringType) and declared not in ("STRING", "VARCHAR", "DATE"):
        return parse_text(column, declared)
    if declared in ("STRING", "VARCHAR", "DATE"):
        return F.to_json(column) if isinstance(have, (T.StructType, T.ArrayType, T.MapType)) else column.cast("string")
    if isinstance(have, (T.TimestampType, T.TimestampNTZType)):
        micros = F.unix_micros(column) if isinstance(have, T.TimestampType) else F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), column)
        if declared != "LONG":
            return F.lit(None)
        return micros if profile is Profile.COMPAT else F.floor(micros / 1_000_000).cast("long")
    if not isinstance(have, NUMERIC):
        return F.lit(None)
    if declared == "BOOLEAN":
        return column.cast("boolean")
    if isinstance(have, T.BooleanType):
        column = column.cast("int")
    if declared in ("INTEGER", "LONG") and isinstance(have, FLOATING):
        column = F.when(~F.isnan(column), column)
    return column.try_cast({"INTEGER": "int", "LONG": "bigint", "DOUBLE": "double"}[declared])


def stored(column: Column, declared: str, profile: Profile) -> Column:
    """What the store keeps of a value: in the compat profile null numbers become 0 and doubles lose what a float can't hold."""
    if profile is Profile.COMPAT:
        if declared == "DOUBLE":
            return F.coalesce(column.cast("float").cast("double"), F.lit(0.0))
        if declared in ("INTEGER", "LONG"):
            return F.coalesce(column, F.lit(0))
        if declared == "BOOLEAN":
            return F.coalesce(column, F.lit(False))
    return column


def aggregate(df: DataFrame, function: str, column: str, profile: Profile) -> Column:
    """COUNT, SUM, AVG, MIN or MAX; NaN is left out of the last four, which give doubles, and a SUM of nothing is 0."""
    if function == "COUNT":
        if profile is Profile.COMPAT or column == "*":
            return F.count("*")
        if column not in df.columns:
            raise InvalidQueryError(f"unknown column {column}")
        return F.count(name(column))
    if column not in df.columns:
        raise InvalidQueryError(f"unknown column {column}")
    if not isinstance(kind(df, column), NUMERIC):
        if profile is Profile.STRICT:
            raise InvalidQueryError(f"{function} needs numbers, and {column} has none")
        return F.max(F.lit(0.0))
    x = number(df, column)
    some = F.when(~F.isnan(x), x) if isinstance(kind(df, column), FLOATING) else x
    if function == "SUM":
        return F.coalesce(F.sum(some), F.lit(0.0))
    if function == "AVG":
        return F.coalesce(F.sum(some), F.lit(0.0)) / F.count("*") if profile is Profile.COMPAT else F.avg(some)
    return F.min(some) if function == "MIN" else F.max(some)


def ordering(column: str, descending: bool) -> Column:
    """Nulls last going up and first going down."""
    return name(column).desc_nulls_first() if descending else name(column).asc_nulls_last()
