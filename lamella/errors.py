"""Errors that the scan layer raises itself; others are Spark's own."""

from __future__ import annotations


class LamellaError(Exception):
    """Base of this package's errors."""


class ColumnNotFound(LamellaError, KeyError):
    """A projected or filtered column that the file does not have; names are matched exactly."""

    def __str__(self) -> str:
        return f"column {self.args[0]!r} is not in the schema: {', '.join(self.args[1])}"


class NotParquet(LamellaError, ValueError):
    """A file without a readable Parquet footer."""


class BackwardRead(LamellaError, ValueError):
    """A reader was asked for rows before its position."""


class BridgeTypeError(LamellaError, TypeError):
    """A typed result was asked for values of another type."""
