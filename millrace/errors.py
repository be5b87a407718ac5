"""Errors that carry an SQLSTATE."""

from __future__ import annotations

SYNTAX, UNSUPPORTED, NO_TABLE, NO_COLUMN, AMBIGUOUS, READ_ONLY, CONFLICT, OTHER = "42601", "0A000", "42P01", "42703", "42702", "25006", "40001", "58000"


class SqlError(Exception):
    """message, sqlstate."""

    def __init__(self, message: str, sqlstate: str = OTHER):
        super().__init__(message)
        self.message, self.sqlstate = message, sqlstate


def translated(error: Exception) -> SqlError:
    """An SqlError for an error of Spark's parser, analyser or execution."""
    if isinstance(error, SqlError):
        return error
    condition = getattr(error, "getCondition", getattr(error, "getErrorClass", lambda: None))() or ""
    text = str(error).split("\n")[0][:500]
    if "TABLE_OR_VIEW_NOT_FOUND" in condition:
        return SqlError(text, NO_TABLE)
    if condition.startswith("UNRESOLVED_COLUMN") or "FIELD_NOT_FOUND" in condition:
        return SqlError(text, NO_COLUMN)
    if condition.startswith("AMBIGUOUS_REFERENCE"):
        return SqlError(text, AMBIGUOUS)
    if condition.startswith("PARSE_SYNTAX_ERROR"):
        return SqlError(text, SYNTAX)
    if condition.startswith(("UNSUPPORTED", "UNRESOLVED_ROUTINE")):
        return SqlError(text, UNSUPPORTED)
    return SqlError(text, OTHER)
