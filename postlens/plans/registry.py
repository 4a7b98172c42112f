"""Queries by name, and the DuckDB SQL that gives the same rows.

A query function takes the logical tables (`Tables`); its SQL may name the same tables, which are put in
front of it as common table expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from postlens.sources.bindings import CTES, Tables

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def with_tables(body: str) -> str:
    """body behind the definitions of the logical tables that it names, directly or not."""
    needed: list[str] = []
    seen: set[str] = set()

    def add(text: str) -> None:
        for name in re.findall(r"(?<!')\b[a-z_]+\b(?!')", text):
            if name in CTES and name not in seen:
                seen.add(name)
                add(CTES[name])
                needed.append(name)

    add(body)
    heads = ", ".join(f"{n} as ({CTES[n]})" for n in needed)
    text = body.strip()
    if not needed:
        return text
    return f"with {heads}, {text[5:]}" if text.lower().startswith("with ") else f"with {heads} {text}"


def query(sql: str | None = None):
    def put(f):
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[name] = with_tables(sql)
        return f

    return put
