"""Queries of the reference's own operators, and the SQL that checks them."""

from __future__ import annotations

import importlib

from docketry.plans.base import ORACLES, QUERIES

for _name in ("tenancy", "relational", "evaluation", "retrieval", "citations", "chunks", "dialogue", "parsing", "runs", "streams"):
    importlib.import_module(f"docketry.plans.{_name}")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
