"""The registry behind ``__spark_entry__``: every query key and its SQL oracle."""

from __future__ import annotations

from . import q_eval, q_io, q_prep, q_runs, q_select

MODULES = [q_select, q_prep, q_eval, q_runs, q_io]


def all_queries() -> dict:
    out: dict = {}
    for m in MODULES:
        out.update(m.QUERIES)
    return out


def all_oracles() -> dict:
    out: dict = {}
    for m in MODULES:
        out.update(m.ORACLE)
    return out
