"""Small tables that queries and their SQL share."""

from __future__ import annotations


def sql_value(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(sql_value, v)) + "]"
    if isinstance(v, float):
        return f"CAST({v!r} AS DOUBLE)"
    if isinstance(v, int):
        return str(v)
    return "'" + str(v).replace("'", "''") + "'"


def sql_values(rows: list[tuple], names: str) -> str:
    """A parenthesised VALUES list with an alias, for a FROM clause."""
    body = ", ".join("(" + ", ".join(map(sql_value, r)) + ")" for r in rows)
    return f"(VALUES {body}) AS v({names})"
