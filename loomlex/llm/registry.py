"""Queries of the subpackage and their SQL."""

from __future__ import annotations

from loomlex.llm import language, mixture, mojibake, names, packing, reflink, scans, spam, termcount

MODULES = (language, mojibake, names, reflink, scans, termcount, packing, mixture, spam)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
