"""Every query of the engine: importing the modules registers them."""

from __future__ import annotations

from lectern.plans import agreement, logs, markup, metrics, profile, raster, review, truth  # noqa: F401
from lectern.plans.registry import BUILDERS, SQL, Builder


def queries() -> dict[str, Builder]:
    return dict(BUILDERS)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
