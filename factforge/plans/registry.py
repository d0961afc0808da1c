"""All registered queries over the reference data model, and their DuckDB twins."""

from __future__ import annotations

from factforge.plans import calculation, checking, flows, fusion, pages, past, preparation  # noqa: F401
from factforge.plans.base import ORACLE_SQL, QUERIES  # noqa: F401
