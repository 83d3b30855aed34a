"""Helpers for writing Spark SQL expression text."""

from __future__ import annotations


def quote(text: str) -> str:
    """A Spark SQL string literal for ``text`` (backslash escapes)."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def string_array(values) -> str:
    return f"array({', '.join(quote(v) for v in values)})"
