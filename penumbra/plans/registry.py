"""All queries of the reference's operators and their SQL."""

from __future__ import annotations

from penumbra.plans import aggregates, demand, evaluation, joins, networks, rasters, rows, scalars, shapes, streams, windows  # noqa: F401
from penumbra.plans.base import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
