"""All registered queries outside the training-data subpackage, with their SQL twins."""

from __future__ import annotations

from lanternmill.plans import archive, retrieval

_MODULES = (retrieval, archive)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
