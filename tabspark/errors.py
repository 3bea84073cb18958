"""Exceptions."""

from __future__ import annotations

from dataclasses import dataclass


class TabError(Exception):
    """Base of all errors of this package."""


class FileClosed(TabError):
    pass


class NoHeader(TabError):
    pass


class OutOfRange(TabError, IndexError):
    pass


class InvalidReference(TabError, ValueError):
    pass


class UnsupportedFormat(TabError):
    pass


class SqlError(TabError):
    pass


class MissingColumn(TabError, KeyError):
    def __init__(self, column: str) -> None:
        super().__init__(column)
        self.column = column

    def __str__(self) -> str:
        return f"no column {self.column!r}"


class ParseError(TabError):
    """Where and why delimited text can't be read."""

    def __init__(self, reason: str, line: int = 0, column: int = 0, offset: int = 0) -> None:
        super().__init__(f"line {line}, column {column}: {reason}")
        self.reason, self.line, self.column, self.offset = reason, line, column, offset


class CellError(TabError):
    def __init__(self, ref: str, value: str, wanted: str) -> None:
        super().__init__(f"{ref}: {value!r} is no {wanted}")
        self.ref, self.value, self.wanted = ref, value, wanted


@dataclass(frozen=True)
class FieldError:
    """One violation: 0-based data row, field, value, rule and what is wrong."""

    row: int
    field: str
    value: str
    rule: str
    error: str


class ValidationError(TabError):
    def __init__(self, errors: list[FieldError]) -> None:
        first = errors[0]
        super().__init__(f"{len(errors)} violations, first: row {first.row}, {first.field}: {first.error}")
        self.errors = errors
