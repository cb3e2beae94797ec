"""What the operators need from the session (see the module of the same name beside this subpackage) and from inputs."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, discard, remove, shared_folder


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores as make it none of df's columns in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_text(df: DataFrame) -> tuple[DataFrame, int]:
    """df and the place of its texts as strings: that of its own column text, or of one added behind all others if that has another type."""
    own = [k for k, c in enumerate(df.schema) if c.name.lower() == "text"]
    if len(own) == 1 and isinstance(df.schema[own[0]].dataType, T.StringType):
        return df, own[0]
    return df.select("*", F.col("text").cast("string").alias(free_name(df, "whole"))), len(df.columns)


__all__ = ["cut", "discard", "free_name", "remove", "shared_folder", "with_text"]
