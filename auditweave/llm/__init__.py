"""Operators for preparing training data; nothing else in the library depends on them."""

from __future__ import annotations


def queries():
    from auditweave.llm.registered import QUERIES

    return dict(QUERIES)


def oracle_sql():
    from auditweave.llm.registered import ORACLE

    return dict(ORACLE)
