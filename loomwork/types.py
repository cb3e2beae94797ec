"""Declared column types and how they map to Spark types."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import types as T

from .errors import InvalidQueryError

#: Declared types; DATE holds text, as VARCHAR does.
DECLARED: dict[str, T.DataType] = {"STRING": T.StringType(), "VARCHAR": T.StringType(), "DATE": T.StringType(), "INTEGER": T.IntegerType(), "LONG": T.LongType(), "DOUBLE": T.DoubleType(), "BOOLEAN": T.BooleanType()}
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.BooleanType)
FLOATING = (T.FloatType, T.DoubleType)


class Profile(Enum):
    """STRICT follows SQL where the request language leaves it open; COMPAT keeps the zero-for-null store."""

    STRICT = "strict"
    COMPAT = "compat"


@dataclass(frozen=True)
class Column:
    name: str
    type: str

    def __post_init__(self):
        if not self.name or not self.name.strip():
            raise InvalidQueryError("a column needs a name")
        if self.type.upper() not in DECLARED:
            raise InvalidQueryError(f"unknown type {self.type}")
        object.__setattr__(self, "name", self.name.strip())
        object.__setattr__(self, "type", self.type.upper())


def schema_of(columns: list[Column]) -> T.StructType:
    return T.StructType([T.StructField(c.name, DECLARED[c.type], True) for c in columns])


def declared_for(kind: T.DataType) -> str:
    """The declared type that a file column of this Spark type gets by inference."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.LongType)):
        return "LONG"
    if isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
        return "INTEGER"
    if isinstance(kind, FLOATING):
        return "DOUBLE"
    return "BOOLEAN" if isinstance(kind, T.BooleanType) else "STRING"


def infer(schema: T.StructType) -> list[Column]:
    return [Column(f.name, declared_for(f.dataType)) for f in schema.fields]
