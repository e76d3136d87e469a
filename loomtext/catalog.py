"""Every query of the library by name, with the SQL that it must match."""

from __future__ import annotations

from .plans import catalogues, concordance, exports, reuse, scoring, titles  # noqa: F401  they register their queries
from .plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return QUERIES


def oracles() -> dict[str, str]:
    return ORACLES
