"""All queries outside the text subpackage, by name."""

from __future__ import annotations

from loamgraph.plans import catalog, code, index, problems

FLAGSHIP = "m6_hybrid"


def queries() -> dict:
    return catalog.QUERIES | code.QUERIES | index.QUERIES | problems.QUERIES


def oracle_sql() -> dict[str, str]:
    return catalog.ORACLE | code.ORACLE | index.ORACLE | problems.ORACLE
