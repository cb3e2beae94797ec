"""What goes wrong with requests, each with the HTTP status it maps to."""

from __future__ import annotations


class EngineError(Exception):
    status = 500


class TableNotFoundError(EngineError):
    status = 404


class TableExistsError(EngineError):
    status = 409


class InvalidQueryError(EngineError):
    status = 400


class LoadError(EngineError):
    status = 400


class TooLargeError(EngineError):
    status = 413
