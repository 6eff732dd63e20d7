"""All queries of the library but the training-text ones."""

from __future__ import annotations

from brightfield.plans import crawl, entities, evidence, front, ledgers, normal, places, records, rules, search, streams, supply  # noqa: F401
from brightfield.registry import ORACLES, QUERIES, Query

FLAGSHIP = "e4_city_radius_search"


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
