"""The same requests over a folder that files keep arriving in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..errors import InvalidQueryError
from ..plans.compiler import compile_request
from ..plans.request import QueryRequest
from ..sources.parquet import bound
from ..types import Column, Profile, schema_of


def follow(spark: SparkSession, folder: str, columns: list[Column], profile: Profile = Profile.STRICT) -> DataFrame:
    """Parquet files with the declared columns, as a stream."""
    return bound(spark.readStream.schema(schema_of(columns)).parquet(folder), columns, profile)


def running(stream: DataFrame, request: QueryRequest, profile: Profile = Profile.STRICT) -> DataFrame:
    """A filter, projection or grouping that is kept up to date; a grouping is written in `complete` or `update` mode."""
    if (request.order_by or request.limit) and not request.group_by:
        raise InvalidQueryError("a stream of rows has no order and no end")
    return compile_request(stream, request, profile)
