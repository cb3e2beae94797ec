"""Compiles a request into one lazy DataFrame plan; Catalyst does the rest."""

from __future__ import annotations

from collections.abc import Mapping
from math import prod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidQueryError
from ..functions import dialect
from ..types import Profile
from .predicate import condition
from .request import QueryRequest

#: Grouped results of fewer rows by measure are sorted in one task, without a range shuffle and its sampling job.
FEW_GROUPS = 10_000
FUNCTIONS = ("COUNT", "SUM", "AVG", "MIN", "MAX")


def call(item: str) -> tuple[str, str] | None:
    """Function and argument of an aggregate item; names of functions have no case, arguments do."""
    for function in FUNCTIONS:
        if item.upper().startswith(f"{function}("):
            inner = item[len(function) + 1 :]
            return function, (inner[: inner.index(")")] if ")" in inner else inner).strip()
    return None


def filtered(df: DataFrame, where: str | None, profile: Profile) -> DataFrame:
    test = condition(df, where, profile)
    return df if test is None else df.where(test)


def projected(df: DataFrame, select) -> list[str]:
    """Known names in the order asked for, each once; all without a list or with a star in it."""
    if not select or "*" in select:
        return df.columns
    return [c for c in dict.fromkeys(select) if c in df.columns]


def distinct_counts(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Estimated distinct values (nulls as one more) of columns, in one pass."""
    if not columns:
        return {}
    return {c: n + 1 for c, n in zip(columns, df.agg(*(F.approx_count_distinct(dialect.name(c)).alias(f"n{i}") for i, c in enumerate(columns))).first(), strict=True)}


def compile_request(df: DataFrame, request: QueryRequest, profile: Profile = Profile.STRICT, distinct: Mapping[str, int] | None = None) -> DataFrame:
    """The plan of a request on df. `distinct` are measured numbers of values by column; they change plans, not results."""
    rows = filtered(df, request.where, profile)
    if request.group_by:
        rows = grouped(rows, request, profile)
        if request.order_by in rows.columns:
            if distinct and prod(distinct.get(k, FEW_GROUPS) for k in set(request.group_by)) < FEW_GROUPS:
                rows = rows.coalesce(1)
            rows = rows.orderBy(dialect.ordering(request.order_by, request.descending))
        return limited(rows, request.limit)
    names = projected(df, request.select)
    if not names and request.select:
        if all(call(x) for x in request.select):
            return total(rows, request, profile)
        if profile is Profile.STRICT:
            raise InvalidQueryError(f"none of {list(request.select)} is a column")
    # Sorted before projecting: the sort column need not be selected.
    if request.order_by in df.columns:
        rows = rows.orderBy(dialect.ordering(request.order_by, request.descending))
    return limited(rows, request.limit).select([dialect.name(c) for c in names])


def grouped(rows: DataFrame, request: QueryRequest, profile: Profile) -> DataFrame:
    keys = list(dict.fromkeys(request.group_by))
    for key in keys:
        if key not in rows.columns:
            raise InvalidQueryError(f"unknown column {key}")
    labels = [x for x in dict.fromkeys(request.select or ()) if call(x)]
    by = [dialect.name(k) for k in keys]
    if not labels:
        return rows.select(by).distinct()
    return rows.groupBy(*by).agg(*(dialect.aggregate(rows, *call(x), profile).alias(x) for x in labels))


def total(rows: DataFrame, request: QueryRequest, profile: Profile) -> DataFrame:
    """Aggregates of all rows: one row, beyond what grouped requests can say."""
    return rows.agg(*(dialect.aggregate(rows, *call(x), profile).alias(x) for x in dict.fromkeys(request.select)))


def limited(rows: DataFrame, limit: int | None) -> DataFrame:
    return rows.limit(limit) if limit is not None and limit > 0 else rows
