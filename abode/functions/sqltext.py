"""Helpers for writing Spark SQL expression text (parsed once on the JVM,
instead of hundreds of small Column calls)."""

from __future__ import annotations


def q(s: str) -> str:
    """Spark SQL string literal (backslash escapes)."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def arr(vals) -> str:
    return "array(" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in vals) + ")"
