"""All registered queries over the operators, and their SQL counterparts."""

from __future__ import annotations

from . import base, delivery, edges, flagship, messages, streams, web  # noqa: F401  importing registers


def queries() -> dict[str, base.Query]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
