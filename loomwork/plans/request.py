"""The request: all that a query can ask for."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from ..errors import InvalidQueryError


@dataclass(frozen=True)
class QueryRequest:
    table: str
    select: tuple[str, ...] | None = None
    where: str | None = None
    group_by: tuple[str, ...] = ()
    order_by: str | None = None
    direction: str = "ASC"
    limit: int | None = None

    def __post_init__(self):
        if not self.table or not self.table.strip():
            raise InvalidQueryError("a request needs a table")
        for field in ("select", "group_by"):
            value = getattr(self, field)
            if isinstance(value, str):
                raise InvalidQueryError(f"{field} is a list of names")
            object.__setattr__(self, field, None if value is None and field == "select" else tuple(value or ()))

    @classmethod
    def from_json(cls, body: Mapping) -> QueryRequest:
        """From a decoded JSON object with tableName, select, where, groupBy, orderBy, orderDirection and limit."""
        limit = body.get("limit")
        if limit is not None and (isinstance(limit, bool) or not isinstance(limit, int)):
            raise InvalidQueryError("limit is a whole number")
        return cls(body.get("tableName") or "", body.get("select"), body.get("where"), body.get("groupBy") or (), body.get("orderBy"), body.get("orderDirection") or "ASC", limit)

    @property
    def descending(self) -> bool:
        return (self.direction or "").strip().upper() == "DESC"
