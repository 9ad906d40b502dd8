"""Named queries. Each module lists ``QUERIES`` and, where SQL can say it, ``ORACLE``."""

from __future__ import annotations

from convlens.plans import learning, quality, reporting, segments

_MODULES = [segments, quality, learning, reporting]


def queries():
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
