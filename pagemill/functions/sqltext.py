"""Small builders for Spark SQL expression text."""

from __future__ import annotations

from collections.abc import Iterable, Mapping


def quote(value: str) -> str:
    """String literal that needs no escaping rules: all but ASCII letters, digits,
    space and underscore are written as code units."""
    units = value.encode("utf-16-be")
    out = []
    for i in range(0, len(units), 2):
        code = units[i] * 256 + units[i + 1]
        ch = chr(code)
        out.append(ch if code < 127 and (ch.isalnum() or ch in " _") else f"\\u{code:04x}")
    return "'" + "".join(out) + "'"


def string_array(values: Iterable[str]) -> str:
    items = ", ".join(quote(v) for v in values)
    return f"array({items})" if items else "cast(array() as array<string>)"


def lookup(table: Mapping[str, str], key: str, default: str) -> str:
    """Value of ``key`` in a table of SQL literals."""
    entries = ", ".join(f"{quote(k)}, {v}" for k, v in table.items())
    return f"coalesce(try_element_at(map({entries}), {key}), {default})"


def let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is evaluated once.

    A fold over nothing: the start value goes straight to the finish step. (A
    one-element ``transform`` would do too, but copies its result.)
    """
    return f"aggregate(cast(array() as array<int>), {value}, ({name}, _unused) -> {name}, {name} -> {body})"
