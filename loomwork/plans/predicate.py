"""The filter language: comparisons and LIKE under AND and OR, AND binding tighter.

The text is read once from left to right. The leftmost operator of a
comparison counts; a literal that begins with a quote ends at the quote before
the next AND, OR or the end, so it may hold any of these words and operators.
"""

from __future__ import annotations

import math
import operator
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidQueryError
from ..functions.dialect import kind, name
from ..types import FLOATING, NUMERIC, Profile

_OPERATOR = re.compile(r"<=|>=|!=|<|>|=|\s+like\s+", re.I)
_NEXT = re.compile(r"\s+(and|or)\s+", re.I)
_NUMBER = re.compile(r"[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|NaN|Infinity)")


@dataclass(frozen=True)
class Comparison:
    column: str
    op: str
    literal: str
    quoted: bool = False


def parse(text: str | None) -> list[list[Comparison]]:
    """Alternatives of conjunctions; none at all for a blank text, which filters nothing."""
    if text is None or not text.strip():
        return []
    out: list[list[Comparison]] = [[]]
    at = 0
    while True:
        found = _OPERATOR.search(text, at)
        if not found:
            raise InvalidQueryError(f"no operator in {text[at:].strip()!r}")
        column, op = text[at : found.start()].strip(), found.group().strip().upper()
        if not column:
            raise InvalidQueryError(f"no column before {op}")
        begin = found.end() + len(text[found.end() :]) - len(text[found.end() :].lstrip())
        literal, quoted, end = _literal(text, begin)
        out[-1].append(Comparison(column, op, literal, quoted))
        link = _NEXT.match(text, end)
        if not link:
            return out
        if link.group(1).upper() == "OR":
            out.append([])
        at = link.end()


def _literal(text: str, begin: int) -> tuple[str, bool, int]:
    if text[begin : begin + 1] in ("'", '"') and text[begin:]:
        end = begin
        while (end := text.find(text[begin], end + 1)) >= 0:
            if not text[end + 1 :].strip() or _NEXT.match(text, end + 1):
                return text[begin + 1 : end], True, end + 1
    link = _NEXT.search(text, max(begin - 1, 0))
    end = link.start() if link else len(text)
    return text[begin:end].strip(), False, end


def condition(df: DataFrame, text: str | None, profile: Profile = Profile.STRICT) -> Column | None:
    """The filter as one column expression over df, or None if there is nothing to filter."""
    parts = parse(text)
    return reduce(operator.or_, (reduce(operator.and_, (compare(df, c, profile) for c in p)) for p in parts)) if parts else None


_COMPARE = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def compare(df: DataFrame, c: Comparison, profile: Profile) -> Column:
    if c.column not in df.columns:
        raise InvalidQueryError(f"unknown column {c.column}")
    column, have = name(c.column), kind(df, c.column)
    if c.op == "LIKE":
        return like(column if isinstance(have, T.StringType) else column.cast("string"), c.literal)
    if isinstance(have, NUMERIC):
        return _compare_number(column, have, c, profile)
    if isinstance(have, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return _COMPARE[c.op](column, F.lit(c.literal).try_cast(have))
    text = column if isinstance(have, T.StringType) else column.cast("string")
    if c.op in ("=", "!="):
        return _COMPARE[c.op](F.lower(text), F.lower(F.lit(c.literal)))
    return F.lit(False) if profile is Profile.COMPAT else _COMPARE[c.op](text, F.lit(c.literal))


def _compare_number(column: Column, have: T.DataType, c: Comparison, profile: Profile) -> Column:
    if isinstance(have, T.BooleanType):
        if c.literal.lower() in ("true", "false") and c.op in ("=", "!="):
            return _COMPARE[c.op](column, F.lit(c.literal.lower() == "true"))
        column = column.cast("int")
    if not _NUMBER.fullmatch(c.literal):
        if profile is Profile.STRICT:
            raise InvalidQueryError(f"{c.column} holds numbers; {c.literal!r} is none")
        same = F.lower(column.cast("string")) == c.literal.lower()
        return F.coalesce(same, F.lit(False)) if c.op == "=" else ~F.coalesce(same, F.lit(False)) if c.op == "!=" else F.lit(False)
    value = float(c.literal)
    if math.isnan(value):
        return column.isNotNull() & F.lit(c.op == "!=")
    whole = re.fullmatch(r"[+-]?\d+", c.literal) and abs(int(c.literal)) < 1 << 63
    # Whole numbers are compared as such: a double can't hold every long.
    exact = int(c.literal) if whole and not isinstance(have, FLOATING) and profile is Profile.STRICT else value
    if not isinstance(exact, int) and not isinstance(have, FLOATING):
        column = column.cast("double")
    test = _COMPARE[c.op](column, F.lit(exact).cast("bigint" if isinstance(exact, int) else "double"))
    return test & ~F.isnan(column) if c.op in (">", ">=") and isinstance(have, FLOATING) else test


def like(text: Column, pattern: str) -> Column:
    """Without regard to case; only a percent sign at either end is a wildcard, and a lone one matches all but null."""
    low = F.lower(text)
    if pattern == "%":
        return text.isNotNull()
    first, last = pattern.startswith("%"), pattern.endswith("%")
    inner = F.lower(F.lit(pattern[first : len(pattern) - last]))
    if first and last:
        return low.contains(inner)
    return low.endswith(inner) if first else low.startswith(inner) if last else low == inner
