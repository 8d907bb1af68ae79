"""Puts named SQL fragments together: each query gets the CTEs it mentions, in order."""

from __future__ import annotations

import re

WORD = re.compile(r"[a-z_][a-z0-9_]*")


def compose(sql: str, ctes: dict[str, str]) -> str:
    needed: set[str] = set()
    todo = [sql]
    while todo:
        for word in set(WORD.findall(todo.pop())):
            if word in ctes and word not in needed:
                needed.add(word)
                todo.append(ctes[word])
    if not needed:
        return sql
    parts = [f"{name} AS MATERIALIZED (\n{body.strip()}\n)" for name, body in ctes.items() if name in needed]
    return "WITH " + ",\n".join(parts) + "\n" + sql.strip()


def when(rules: list[tuple[str, str]], otherwise: str) -> str:
    """CASE from (condition, text) rules."""
    body = " ".join(f"WHEN {condition} THEN {_quote(text)}" for condition, text in rules)
    return f"CASE {body} ELSE {_quote(otherwise)} END"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def among(*labels: str) -> str:
    return "(" + ", ".join(_quote(x) for x in labels) + ")"


def money(x: str) -> str:
    return (
        f"CASE WHEN ({x}) IS NULL THEN '' WHEN abs({x}) >= 1e9 THEN '$' || printf('%.2f', ({x})/1e9) || 'B' "
        f"WHEN abs({x}) >= 1e6 THEN '$' || printf('%.2f', ({x})/1e6) || 'M' "
        f"WHEN abs({x}) >= 1e3 THEN '$' || printf('%.0f', ({x})/1e3) || 'K' "
        f"ELSE '$' || format('{{:,.0f}}', ({x})::DOUBLE) END"
    )


def count_text(x: str) -> str:
    return f"coalesce(format('{{:,.0f}}', ({x})::DOUBLE), '')"


def percent(x: str) -> str:
    return f"coalesce(printf('%.2f', ({x})*100.0::DOUBLE) || '%', '')"


def times(x: str) -> str:
    return f"coalesce(printf('%.2f', ({x})::DOUBLE) || 'x', '')"


def fixed(x: str, decimals: int) -> str:
    return f"printf('%.{decimals}f', ({x})::DOUBLE)"
