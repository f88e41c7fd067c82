"""SQL text of literals.  Wide expressions are built as one SQL string: one parse instead of thousands of calls."""

from __future__ import annotations


def sql_text(value: str) -> str:
    """A string as a Spark SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_array(values) -> str:
    return "array(" + ", ".join(sql_text(v) if isinstance(v, str) else repr(v) + ("D" if isinstance(v, float) else "") for v in values) + ")"


def starts_with_any(text: str, prefixes: list[str]) -> str:
    return "(" + " or ".join(f"startswith({text}, {sql_text(p)})" for p in prefixes) + ")"


def one_of(text: str, values: list[str]) -> str:
    return f"{text} in (" + ", ".join(sql_text(v) for v in values) + ")"


def host_under_sql(host: str, domains: list[str]) -> str:
    """Is the host one of the domains or below one of them?"""
    ends = " or ".join(f"endswith({host}, {sql_text('.' + d)})" for d in domains)
    return f"({one_of(host, domains)} or {ends})"
