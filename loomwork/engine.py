"""The engine: a catalog of declared tables, loads into them and requests on them."""

from __future__ import annotations

import threading
from collections.abc import Iterable, Mapping
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession

from . import session
from .errors import InvalidQueryError, LoadError, TableExistsError, TableNotFoundError
from .operators import scan
from .plans.compiler import compile_request, distinct_counts
from .plans.request import QueryRequest
from .sources import csv, parquet, remote
from .types import Column, Profile, infer, schema_of


class Engine:
    """Tables are lazy plans over their files; `cache` keeps one in executors' memory, `analyze` measures its keys."""

    def __init__(self, spark: SparkSession, profile: Profile = Profile.STRICT):
        self.spark, self.profile = spark, profile
        self._tables: dict[str, tuple[list[Column], DataFrame]] = {}
        self._spooled: dict[str, list[str]] = {}
        self._distinct: dict[str, dict[str, int]] = {}
        self._rows: dict[str, int] = {}
        self._lock = threading.Lock()

    def create_table(self, name: str, columns: Iterable[Column | tuple[str, str]]) -> None:
        name = (name or "").strip()
        columns = [c if isinstance(c, Column) else Column(*c) for c in columns]
        if not name or not columns:
            raise InvalidQueryError("a table needs a name and a column")
        empty = self.spark.createDataFrame([], schema_of(columns))
        with self._lock:
            if name in self._tables:
                raise TableExistsError(name)
            self._tables[name], self._rows[name] = (columns, empty), 0

    def _of(self, name: str) -> tuple[list[Column], DataFrame]:
        try:
            return self._tables[name.strip()]
        except KeyError:
            raise TableNotFoundError(name) from None

    def table(self, name: str) -> DataFrame:
        return self._of(name)[1]

    def columns(self, name: str) -> list[Column]:
        return self._of(name)[0]

    def list_tables(self) -> list[str]:
        return sorted(self._tables)

    def table_count(self) -> int:
        return len(self._tables)

    def table_exists(self, name: str) -> bool:
        return name.strip() in self._tables

    def drop_table(self, name: str) -> bool:
        """Whether there was such a table; files that uploads left for it go too."""
        with self._lock:
            gone = self._tables.pop(name.strip(), None)
            files = self._spooled.pop(name.strip(), [])
            self._distinct.pop(name.strip(), None)
            self._rows.pop(name.strip(), None)
        if gone:
            gone[1].unpersist()
        for path in files:
            session.remove(self.spark, path)
        return gone is not None

    def describe(self, name: str) -> dict:
        """Name, columns and rows, as counted by the loads; a registered DataFrame is counted once."""
        columns, df = self._of(name)
        rows = self._rows.get(name.strip())
        if rows is None:
            rows = self._rows[name.strip()] = df.count()
        return {"name": name.strip(), "columns": [{"name": c.name, "type": c.type} for c in columns], "rowCount": rows}

    def view(self, name: str, alias: str | None = None) -> None:
        """Make a table known to Spark SQL."""
        self.table(name).createOrReplaceTempView(alias or name)

    def cache(self, name: str) -> int:
        """Keep a table in executors' memory until it is dropped or loaded into; its rows."""
        return self.table(name).cache().count()

    def analyze(self, name: str, columns: Iterable[str] | None = None) -> dict[str, int]:
        """Estimate the distinct values of columns (all, if none are named); they tell how grouped results are sorted."""
        df = self.table(name)
        counts = distinct_counts(df, list(columns) if columns is not None else df.columns)
        with self._lock:
            self._distinct[name.strip()] = {**self._distinct.get(name.strip(), {}), **counts}
        return counts

    def _append(self, name: str, more: DataFrame, spooled: str | None = None) -> int:
        """Loads add to what is there; returns the rows added. A load that can't be read changes nothing."""
        try:
            rows = more.count()
            with self._lock:
                columns, df = self._of(name)
                self._tables[name.strip()] = (columns, scan.append(df, more))
                self._distinct.pop(name.strip(), None)
                if name.strip() in self._rows:
                    self._rows[name.strip()] += rows
                if spooled:
                    self._spooled.setdefault(name.strip(), []).append(spooled)
        except BaseException:
            if spooled:
                session.remove(self.spark, spooled)
            raise
        df.unpersist()
        return rows

    def load(self, name: str, path: str, form: str, max_rows: int | None = None, skip_rows: int | None = None) -> int:
        """A CSV or PARQUET file: whole, its first max_rows rows, or max_rows rows (all, if None) behind skip_rows."""
        source, columns = _source(form), self.columns(name)
        most = max_rows if max_rows and max_rows > 0 else None
        if skip_rows is not None:
            return self._append(name, source.read_slice(self.spark, path, columns, max(0, skip_rows), most, self.profile))
        return self._append(name, source.read(self.spark, path, columns, self.profile, most))

    def load_bytes(self, name: str, data: bytes | BinaryIO | Iterable[bytes], form: str, max_rows: int | None = None) -> int:
        """A file that comes as bytes, a stream or chunks; it is kept in the shared folder until the table is dropped."""
        source, columns = _source(form), self.columns(name)
        chunks = [data] if isinstance(data, bytes) else session.pieces(data) if hasattr(data, "read") else data
        path, size = session.spool(self.spark, chunks, "upload")
        if not size:
            session.remove(self.spark, path)
            raise LoadError("the file is empty")
        return self.adopt(name, path, form, max_rows)

    def adopt(self, name: str, path: str, form: str, max_rows: int | None = None) -> int:
        """Load a spooled file, which then goes with the table."""
        try:
            more = _source(form).read(self.spark, path, self.columns(name), self.profile, max_rows)
        except BaseException:
            session.remove(self.spark, path)
            raise
        return self._append(name, more, path)

    def load_url(self, name: str, url: str, form: str, max_rows: int | None = None, hosts: list[str] | None = None) -> int:
        _source(form)
        self.columns(name)
        return self.load_bytes(name, remote.fetch(url, hosts=hosts), form, max_rows)

    def add_rows(self, name: str, rows: Iterable[tuple]) -> int:
        return self._append(name, self.spark.createDataFrame(list(rows), schema_of(self.columns(name))))

    def register(self, name: str, df: DataFrame) -> None:
        """A table over any DataFrame, with its own column types."""
        with self._lock:
            if name.strip() in self._tables:
                raise TableExistsError(name)
            self._tables[name.strip()] = (infer(df.schema), df)

    def query(self, request: QueryRequest | Mapping) -> DataFrame:
        request = request if isinstance(request, QueryRequest) else QueryRequest.from_json(request)
        return compile_request(self.table(request.table), request, self.profile, self._distinct.get(request.table.strip()))

    def scan_count(self, name: str, select=None, where: str | None = None) -> int:
        return scan.scan_count(self.table(name), select, where, self.profile).first()["n"]


def _source(form: str):
    try:
        return {"CSV": csv, "PARQUET": parquet}[(form or "").upper()]
    except KeyError:
        raise LoadError(f"unknown format {form}") from None
