"""Registry of the core queries and of the SQL that must give the same rows."""

from __future__ import annotations

from hirelake.functions import timestamps
from hirelake.plans.oracles import ORACLES
from hirelake.plans.queries import QUERIES, Query, flagship  # noqa: F401


def queries() -> dict[str, Query]:
    return {"p5_found": timestamps.p5_found, **QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
