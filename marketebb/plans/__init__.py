"""Named queries over the test tables, each with comparison SQL."""

from __future__ import annotations

from marketebb.plans import registry


def _load() -> None:
    from marketebb.plans import market, operations, streams  # noqa: F401


def queries() -> dict[str, registry.Query]:
    _load()
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(registry.ORACLES)
